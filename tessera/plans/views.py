"""The test tables as linkage inputs, in Spark and in SQL.

A record is a web page: its title is the name, its URL the address (none on an advertiser's host), its language the
country, and the ending of its host the source.  Titles and URLs are taken whole.  Fixed values stand here a second time,
for SQL, so that a slip in either place shows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import retrieval
from tessera.sources.scratch import Scratch

_SHARED: dict[tuple[str, str, str], DataFrame] = {}


def shared(spark: SparkSession, d: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, written once a session and read by every query that needs it; tables at a path are taken not to change."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _SHARED:
        _SHARED[key] = Scratch(spark, name).save(make(), name)
    return _SHARED[key]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, bucket, country, business_name, business_address."""
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    b = F.when(host.endswith(".com"), 1).when(host.endswith(".net"), 2).otherwise(3)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        F.concat(F.lit("S"), b, F.lit("-"), "page_id").alias("entity_id"), b.alias("bucket"), F.regexp_extract("html", '<html lang="([a-z]*)"', 1).alias("country"),
        F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("business_name"), F.when(F.col("url").contains("ads-track"), "").otherwise(F.col("url")).alias("business_address"), "page_id",
    )


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).where("bucket = 1").select(F.col("entity_id").alias("s1_id"))


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, o_custkey and a made-up address with premise numbers, a state and a postal code."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    state = F.element_at(F.array(*[F.lit(x) for x in ("CT", "FL", "NE", "XX", "ON")]), (c % 5 + 1).cast("int"))
    parts = [F.lit("Plot No. "), k % 997, F.lit("/"), c % 89, F.lit(", "), c % 4000, F.lit(" Main St, h.no "), k % 71, F.lit(", "), state, F.lit(" "), (F.lit(10000) + c).cast("string")]
    return o.select("o_orderkey", "o_custkey", F.concat(*[p.cast("string") for p in parts]).alias("address"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s1_id, target_id): pages of one title and language; those of the targets are dealt to those of the reference in turn."""
    e = entities(spark, sf_dir).withColumn("target", F.col("bucket") > 1)
    place = F.row_number().over(Window.partitionBy("target", "country", "business_name").orderBy("page_id")) - 1
    placed = e.withColumn("place", place)
    a = placed.where("NOT target").select(F.col("entity_id").alias("s1_id"), "country", "business_name", "place")
    sizes = a.groupBy("country", "business_name").agg(F.count("*").alias("n"))
    t = placed.where("target").join(sizes, ["country", "business_name"]).select(F.col("entity_id").alias("target_id"), "country", "business_name", (F.col("place") % F.col("n")).cast("int").alias("place"))
    return a.join(t, ["country", "business_name", "place"]).select("s1_id", "target_id")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with their preprocessed columns."""
    return shared(spark, sf_dir, "records", lambda: T.preprocess(entities(spark, sf_dir)))


def prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Reference and targets as (country, id, x)."""
    p = records(spark, sf_dir).select("bucket", "country", F.col("entity_id").alias("id"), F.col("clean_joint").alias("x"))
    return p.where("bucket = 1").drop("bucket"), p.where("bucket > 1").drop("bucket")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s1_id, target_id, score, rank) of the shortlist's pairs that share an n-gram."""
    return shared(spark, sf_dir, "scored", lambda: retrieval.rescored(*prepared(spark, sf_dir)))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s1_id, target_id, score, rank): two-stage retrieval, computed once a session."""
    return shared(spark, sf_dir, "candidates", lambda: retrieval.candidates(*prepared(spark, sf_dir)))


# SQL.  Fixed values: as in the text functions.
LEGAL = (
    "private\\s+limited|pvt\\s+ltd|incorporated|corporation|enterprises|associates|industries|solutions|services|limited|company|pvt|ltd|inc|corp|l\\s+l\\s+c|llc|l\\s+l\\s+p|llp|pllc"
    "|s\\s+a\\s+r\\s+l|sarl|s\\s+a\\s+s\\s+u|sasu|e\\s+u\\s+r\\s+l|eurl|s\\s+a\\s+s|sas|gmbh|s\\s+a|sa|sci|snc|gie|c\\s+o|co"
)
CONTRACTIONS = (
    "rd=road st=street ave=avenue av=avenue blvd=boulevard bvd=boulevard bd=boulevard dr=drive ln=lane ct=court pkwy=parkway pkg=parking hwy=highway rte=route r=rue opp=opposite b/h=behind nr=near"
    " apt=apartment flt=flat ste=suite bldg=building fl=floor h\\.?no\\.?=house_number hno=house_number n=north s=south e=east w=west ne=northeast nw=northwest se=southeast sw=southwest"
)
STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY".split()
STOP = ["the", "a", "an", "of", "and", "&", "or", "for", "in", "at", "to", "by", "le", "la", "les", "de", "du", "des"]
STOP_FORMS = [*STOP, "pvt", "ltd", "llc", "inc", "corp", "co"]
TLD = "co\\.in|org\\.in|com|in|org|fr|net|co|io|biz|info|gov|edu|eu|us"
URL = f"(?i)((?:https?://)?(?:www\\d*\\.)?[a-zA-Z0-9][-a-zA-Z0-9.]*\\.(?:{TLD})\\b(?:/[^\\s]*)?)"
PREMISE = "(?i)\\b(?:plot|polt|h\\.?no|house|flat|f\\.?no|d\\.?no|door|unit|shop|suite|ste|apt|bldg)\\b(?:\\s*no\\.?)?\\s*[:#-]?\\s*([a-zA-Z0-9/-]+)"
NUMBERED = "(?i)\\bno\\.?\\s*[:#-]?\\s*([0-9]+[a-zA-Z0-9/-]*)"
LEADING = "(?:^|,\\s*)([0-9]{1,5}[a-zA-Z]?)\\b"
COMPOUND = "\\b([0-9]{1,4}[-/][0-9]{1,4}(?:[-/][0-9]{1,4})?)\\b"
PRIMARY = "(?i)\\b(?:no\\.?|h\\.?no\\.?|flat|door|ews|unit|suite|ste|apt|n°)?\\s*[:#-]?\\s*([0-9]+)"


def fold(x: str) -> str:
    return f"replace(lower(strip_accents({x})), '&', ' and ')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def normalize(x: str) -> str:
    return squeeze(f"regexp_replace({fold(x)}, '[^a-z0-9\\s]', ' ', 'g')")


def legal(x: str) -> str:
    return squeeze(f"regexp_replace({x}, '\\b(?:{LEGAL})\\b', ' ', 'g')")


def expand(x: str) -> str:
    for pair in CONTRACTIONS.split():
        short, long = pair.split("=")
        x = f"regexp_replace({x}, '\\b{short}\\b', '{long.replace('_', ' ')}', 'g')"
    return x


def stem(x: str) -> str:
    """Brand label of the first URL-like token of a column."""
    url = f"regexp_replace(regexp_extract(trim({x}), '{URL}', 1), '(?i)^(?:https?://)?(?:www\\d*\\.)?', '')"
    host = f"regexp_replace(split_part(split_part({url}, '/', 1), '?', 1), '(?i)\\.(?:{TLD})$', '')"
    return f"trim(regexp_replace(lower(string_split({host}, '.')[-1]), '[^a-z0-9-]', '', 'g'), '-')"


def found(x: str, pattern: str) -> str:
    return f"list_distinct(regexp_extract_all({x}, '{pattern}'))"


def numbers(x: str) -> str:
    return found(x, "\\b[0-9]+\\b")


def pins(x: str) -> str:
    return found(x, "\\b[0-9]{5,6}\\b")


def premises(x: str) -> str:
    """House, plot and flat numbers."""

    def valued(pattern: str, digits: bool) -> str:
        tidy = f"list_transform(regexp_extract_all({x}, '{pattern}', 1), v -> trim(lower(v), '.-#/ '))"
        some = f"list_filter({tidy}, v -> {'regexp_matches(v, chr(91) || $$0-9$$ || chr(93))' if digits else 'length(v) > 0'})"
        return f"list_concat({some}, flatten(list_transform({some}, v -> regexp_extract_all(v, '[0-9]+'))))"

    lead = f"list_transform(regexp_extract_all({x}, '{LEADING}', 1), v -> lower(v))"
    bare = f"list_transform({lead}, v -> coalesce(nullif(ltrim(v, $$0$$), $$$$), $$0$$))"
    return f"list_distinct(list_concat({valued(PREMISE, True)}, {valued(NUMBERED, False)}, {lead}, {bare}, {valued(COMPOUND, False)}))"


def state(x: str) -> str:
    return f"coalesce(list_filter(regexp_extract_all(upper({x}), '\\b[A-Za-z][A-Za-z]\\b'), t -> list_contains({STATES}, t))[1], '')"


def number(x: str) -> str:
    return f"TRY_CAST(regexp_extract({x}, '{PRIMARY}', 1) AS HUGEINT)"


def words(x: str) -> str:
    return f"list_filter(list_distinct(string_split({x}, ' ')), t -> t <> '')"


def sorted_words(x: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split({x}, ' '), t -> t <> '')), ' ')"


def set_parts(a: str, b: str) -> tuple[str, str, str]:
    """Words of both, of the first alone and of the second alone, sorted, as strings."""
    x, y = words(a), words(b)
    only = lambda p, q: f"array_to_string(list_sort(list_filter({p}, t -> NOT list_contains({q}, t))), ' ')"
    return f"array_to_string(list_sort(list_intersect({x}, {y})), ' ')", only(x, y), only(y, x)


def subsequences(pairs: str) -> str:
    """CTEs that end in lcs(a, b, l): the longest common subsequence of each pair (a, b), rows of its table as bits of a number."""
    hit = "(row & list_sum(list_transform(range(length(a)), j -> CASE WHEN a[j + 1] = b[i + 1] THEN 1::HUGEINT << CAST(j AS INT) ELSE 0::HUGEINT END))::HUGEINT)"
    return f"""prs AS (SELECT DISTINCT a, b FROM ({pairs}) WHERE length(a) > 0),
stp AS (SELECT a, b, 0 AS i, (1::HUGEINT << length(a)) - 1 AS row FROM prs
 UNION ALL SELECT a, b, i + 1, ((row + h) | (row - h)) & ((1::HUGEINT << length(a)) - 1) FROM (SELECT *, {hit} AS h FROM stp WHERE i < length(b))),
lcs AS (SELECT a, b, length(a) - bit_count(row) AS l FROM stp WHERE i = length(b))"""


def ratio(a: str, b: str, l: str) -> str:  # noqa: E741
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 1 ELSE 2 * coalesce({l}, 0) / (length({a}) + length({b})) END"


def set_ratio(both: str, left: str, right: str, l: str) -> str:  # noqa: E741
    n, one, two = f"length({both})", f"(length({both}) + 1 + length({left}))", f"(length({both}) + 1 + length({right}))"
    return f"""CASE WHEN {n} + length({left}) = 0 OR {n} + length({right}) = 0 THEN 0 WHEN {n} > 0 AND (length({left}) = 0 OR length({right}) = 0) THEN 1 WHEN {n} = 0 THEN {ratio(left, right, l)}
 ELSE greatest(2 * ({n} + 1 + coalesce({l}, 0)) / ({one} + {two}), 2 * {n} / ({n} + {one}), 2 * {n} / ({n} + {two})) END"""


ENTITIES = """ent AS (SELECT 'S' || b || '-' || page_id AS entity_id, * FROM (SELECT page_id, CASE WHEN ends_with(host, '.com') THEN 1 WHEN ends_with(host, '.net') THEN 2 ELSE 3 END AS b, country, name, addr
 FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS country, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS name,
 CASE WHEN contains(url, 'ads-track') THEN '' ELSE url END AS addr FROM pages)))"""
ADDRESSES = """adr AS (SELECT o_orderkey, o_custkey, 'Plot No. ' || (o_orderkey % 997) || '/' || (o_custkey % 89) || ', ' || (o_custkey % 4000) || ' Main St, h.no ' || (o_orderkey % 71)
 || ', ' || ['CT','FL','NE','XX','ON'][o_custkey % 5 + 1] || ' ' || (10000 + o_custkey) AS address FROM orders)"""
TRUTH = """plc AS (SELECT *, row_number() OVER (PARTITION BY b > 1, country, name ORDER BY page_id) - 1 AS i, count(*) OVER (PARTITION BY b > 1, country, name) AS n FROM ent),
tru AS (SELECT a.entity_id AS s1_id, t.entity_id AS target_id FROM plc a JOIN plc t ON a.country = t.country AND a.name = t.name AND a.b = 1 AND t.b > 1 AND t.i % a.n = a.i)"""
MISSING = "CASE WHEN lower(trim(coalesce(addr, ''))) IN ('', 'nan') THEN 1 ELSE 0 END"
# What is not ASCII after folding is a letter in these tables; RE2 would see a word's end there, so an underscore stands for it.
PREPARED = f"""pre AS (SELECT *, {squeeze("clean_name || ' ' || clean_name || ' ' || clean_addr")} AS x FROM (SELECT *, {legal(normalize("name"))} AS clean_name, {MISSING} AS miss, coalesce(nullif({stem("name")}, ''), {stem("addr")}) AS stem,
 CASE WHEN {MISSING} = 1 THEN '' ELSE {squeeze(f"regexp_replace({expand(f"regexp_replace({fold('addr')}, '[^\x00-\x7F]', '_', 'g')")}, '[^a-z0-9\\s]', ' ', 'g')")} END AS clean_addr FROM ent))"""
WORDS = "list_concat(w, list_transform(range(1, len(w)), i -> w[i] || ' ' || w[i + 1]))"


def weights(max_df: float, terms: str, name: str, source: str, limit: str = "") -> str:
    """CTEs {name}_w (weights of targets) and {name}_q (of queries) over `source`(b, country, id, w or ts)."""
    return f"""
{name}_tf AS (SELECT b > 1 AS t, country, id, term, count(*) AS tf FROM (SELECT b, country, id, unnest({terms}) AS term FROM {source}) GROUP BY ALL),
{name}_n AS (SELECT country, count(*) AS n FROM {source} WHERE b > 1 GROUP BY country),
{name}_v AS (SELECT country, term, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT country, term, count(*) AS df FROM {name}_tf WHERE t GROUP BY ALL) JOIN {name}_n USING (country)
 WHERE df >= CASE WHEN n < 2 THEN 1 ELSE 2 END AND df <= CASE WHEN n * {max_df} < 2 THEN n ELSE n * {max_df} END),
{name}_r AS (SELECT t, country, id, term, (1 + ln(tf)) * idf AS raw FROM {name}_tf JOIN {name}_v USING (country, term)),
{name}_s AS (SELECT t, country, id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY t, id)) AS w FROM {name}_r),
{name}_c AS (SELECT q.id AS s1_id, t.id AS target_id, round(sum(q.w * t.w), 6) AS score FROM {name}_s q JOIN {name}_s t ON q.country = t.country AND q.term = t.term AND NOT q.t AND t.t {limit} GROUP BY ALL)"""


WORD_STAGE = f"""{ENTITIES}, {PREPARED},
src AS (SELECT b, country, entity_id AS id, list_filter(string_split(x, ' '), t -> length(t) >= 2) AS w, x FROM pre), {weights(0.02, WORDS, "wd", "src")},
short AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, target_id) AS rank FROM wd_c) WHERE rank <= 300)"""
GRAMS = "list_transform(range(1, greatest(length(p) - {n} + 2, 1)), i -> substr(p, i, {n}))"
CHARS = f"""pad AS (SELECT b, country, id, ' ' || unnest(list_filter(string_split(x, ' '), t -> t <> '')) || ' ' AS p FROM src),
grs AS (SELECT b, country, id, flatten(list(CASE WHEN length(p) <= 3 THEN [p] ELSE list_concat({GRAMS.format(n=3)}, {GRAMS.format(n=4)}) END)) AS g FROM pad GROUP BY ALL)"""
CHAR_STAGE = f"""{WORD_STAGE}, {CHARS}, {weights(0.25, "g", "ch", "grs", "JOIN short h ON h.s1_id = q.id AND h.target_id = t.id")},
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, target_id) AS rank FROM ch_c WHERE score >= 0.10) WHERE rank <= 20)"""
EXACT = """exa AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, target_id) AS rank FROM
 (SELECT q.id AS s1_id, t.id AS target_id, round(sum(q.w * t.w), 6) AS score FROM ch_s q JOIN ch_s t ON q.country = t.country AND q.term = t.term AND NOT q.t AND t.t GROUP BY ALL) WHERE score >= 0.10) WHERE rank <= 20)"""
