"""Registered queries and their DuckDB equivalents."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import fuzzy
from tessera.functions import text as T
from tessera.operators import decide, evaluate, features, model, retrieval, sampling, validate
from tessera.plans import views as V
from tessera.sources import linkage

FLAGSHIP = "decide_margin_cap"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = re.sub(r"\b([a-z]) -> ", r"lambda \1: ", sql)
        return f

    return add


def _sorted(x) -> F.Column:
    return F.array_join(F.array_sort(F.array_distinct(x)), ",")


def _list(x: str) -> str:
    return f"array_to_string(list_sort(list_distinct({x})), ',')"


# Text functions ---------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, md5({V.normalize('text')}) AS digest FROM documents")
def normalize_text(spark, d):
    return V.documents(spark, d).select("doc_id", F.md5(T.normalize_text(F.col("text")).cast("binary")).alias("digest"))


@query(f"SELECT doc_id, md5({V.legal(V.normalize('text'))}) AS digest FROM documents")
def legal_suffix_strip(spark, d):
    return V.documents(spark, d).select("doc_id", F.md5(T.clean_name(F.col("text")).cast("binary")).alias("digest"))


@query(f"WITH {V.ADDRESSES} SELECT o_orderkey, {V.squeeze(f"regexp_replace({V.expand(V.fold('address'))}, '[^a-z0-9\\s]', ' ', 'g')")} AS clean FROM adr")
def address_expand(spark, d):
    return V.addresses(spark, d).select("o_orderkey", T.clean_address(F.col("address")).alias("clean"))


@query(f"SELECT page_id, {V.stem('url')} AS stem FROM pages")
def domain_stem(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", T.domain_stem(F.col("url")).alias("stem"))


@query(f"WITH {V.ENTITIES}, {V.PREPARED} SELECT entity_id, clean_name, clean_addr, stem AS domain_stem, x AS clean_joint, miss AS is_addr_missing, strlen(name) <> length(name) AS has_non_ascii FROM pre")
def preprocess_entities(spark, d):
    return T.preprocess(V.entities(spark, d)).select("entity_id", "clean_name", "clean_addr", "domain_stem", "clean_joint", "is_addr_missing", "has_non_ascii")


@query(f"WITH {V.ENTITIES}, {V.PREPARED} SELECT entity_id, clean_name AS norm_business_name, clean_addr AS norm_business_address, x AS norm_joint FROM pre")
def normalize_records(spark, d):
    return T.normalize_records(V.entities(spark, d)).select("entity_id", "norm_business_name", "norm_business_address", "norm_joint")


@query(f"WITH {V.ADDRESSES} SELECT o_orderkey, {_list(V.numbers('address'))} AS numbers, {_list(V.pins('address'))} AS pins FROM adr")
def numeric_and_pin_tokens(spark, d):
    a = F.col("address")
    return V.addresses(spark, d).select("o_orderkey", _sorted(T.numeric_tokens(a)).alias("numbers"), _sorted(T.pin_tokens(a)).alias("pins"))


@query(f"WITH {V.ADDRESSES} SELECT o_orderkey, {_list(V.premises('address'))} AS premises FROM adr")
def premise_tokens(spark, d):
    return V.addresses(spark, d).select("o_orderkey", _sorted(T.premise_tokens(F.col("address"))).alias("premises"))


@query(f"WITH {V.ADDRESSES} SELECT o_orderkey, {_list(f"list_concat({V.pins('address')}, {V.premises('address')})")} AS codes, {_list(V.found('address', '\\b[0-9]+(?:[/-][0-9]+)?\\b'))} AS houses FROM adr")
def code_and_house_tokens(spark, d):
    a = F.col("address")
    return V.addresses(spark, d).select("o_orderkey", _sorted(T.pin_premise_tokens(a)).alias("codes"), _sorted(T.house_tokens(a)).alias("houses"))


@query(
    f"""WITH {V.ADDRESSES} SELECT o_orderkey, {V.state('address')} AS state, CAST({V.number('address')} AS BIGINT) AS door,
coalesce(nullif(regexp_extract(address, '\\b([0-9]{{6}})\\b', 1), ''), nullif(regexp_extract(address, '\\b([0-9]{{5}})(?:-[0-9]{{4}})?\\b', 1), '')) AS code FROM adr"""
)
def state_door_code(spark, d):
    a = F.col("address")
    return V.addresses(spark, d).select("o_orderkey", T.state_token(a).alias("state"), T.primary_number(a).cast("long").alias("door"), T.pincode(a).alias("code"))


_TOKENS = f"list_filter(list_distinct(string_split(clean_name, ' ')), t -> length(t) > 2 AND NOT list_contains({V.STOP_FORMS}, t))"


@query(f"WITH {V.ENTITIES}, {V.PREPARED} SELECT entity_id, array_to_string(list_sort({_TOKENS}), ' ') AS tokens FROM pre")
def name_tokens(spark, d):
    return V.entities(spark, d).select("entity_id", F.array_join(F.array_sort(T.name_tokens(F.col("business_name"))), " ").alias("tokens"))


# Sources, sinks, relational verbs ---------------------------------------------------------------------------------


@query(f"WITH {V.ENTITIES}, {V.TRUTH} SELECT * FROM tru")
def truth_edges(spark, d):
    return V.truth(spark, d)


_TRUE_LISTS = "lst AS (SELECT entity_id AS s1_id, coalesce(list(target_id ORDER BY target_id) FILTER (target_id IS NOT NULL), []) AS ids FROM ent LEFT JOIN tru ON s1_id = entity_id WHERE b = 1 GROUP BY entity_id)"


@query(f"WITH {V.ENTITIES}, {V.TRUTH}, {_TRUE_LISTS} SELECT s1_id, array_to_string(ids, ',') AS ids FROM lst")
def match_list_sink(spark, d):
    return linkage.to_lists(V.truth(spark, d).withColumn("rank", F.lit(1)), V.reference(spark, d))


@query(
    f"""WITH {V.ENTITIES}, {V.TRUTH}, {_TRUE_LISTS} SELECT s1_id, array_to_string(list_filter(ids, x -> starts_with(x, 'S2-')), ',') AS s2_ids, array_to_string(list_filter(ids, x -> starts_with(x, 'S3-')), ',') AS s3_ids,
len(ids) = 0 AS singleton FROM lst"""
)
def truth_by_source(spark, d):
    lists = linkage.to_lists(V.truth(spark, d).withColumn("rank", F.lit(1)), V.reference(spark, d))
    out = linkage.by_source(lists.select("s1_id", linkage.id_list(F.col("ids")).alias("ids")))
    return out.select("s1_id", F.array_join("s2_ids", ",").alias("s2_ids"), F.array_join("s3_ids", ",").alias("s3_ids"), "singleton")


@query("SELECT c_nationkey AS s1_id, 'S2-' || c_custkey AS target_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rank FROM customer QUALIFY rank <= 20")
def candidate_explode(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("c_custkey")), lambda x: F.concat(F.lit(" S2-"), x, F.lit(" "))), ",,")
    lists = c.groupBy(F.col("c_nationkey").alias("s1_id")).agg(linkage.id_list(ids).alias("ids"))
    return linkage.edges(lists, 20)


@query(f"WITH {V.ENTITIES}, {V.TRUTH} SELECT b, count(*) AS n, count(*) FILTER (entity_id IN (SELECT target_id FROM tru)) AS wanted FROM ent WHERE b > 1 GROUP BY b")
def semi_and_anti_targets(spark, d):
    t = V.entities(spark, d).where("bucket > 1").select("entity_id", "bucket")
    wanted = V.truth(spark, d).select(F.col("target_id").alias("entity_id")).distinct()
    hit, rest = t.join(wanted, "entity_id", "left_semi"), t.join(wanted, "entity_id", "left_anti")
    both = hit.withColumn("w", F.lit(1)).unionByName(rest.withColumn("w", F.lit(0)))
    return both.groupBy(F.col("bucket").alias("b")).agg(F.count("*").alias("n"), F.sum("w").alias("wanted"))


@query(f"WITH {V.ENTITIES} SELECT entity_id, country FROM ent QUALIFY row_number() OVER (PARTITION BY country ORDER BY entity_id) <= 25")
def stratified_sample(spark, d):
    return sampling.stratified(V.entities(spark, d).select("entity_id", "country"), "country", "entity_id", 25, seed=None)


@query(f"WITH {V.ENTITIES} SELECT page_id FROM ent QUALIFY row_number() OVER (PARTITION BY country, name ORDER BY page_id) = 1")
def first_by_key(spark, d):
    return sampling.first_by_key(V.entities(spark, d), ["country", "business_name"], "page_id").select("page_id")


@query(
    f"""WITH {V.ENTITIES}, {V.TRUTH} SELECT entity_id, country FROM ent WHERE entity_id IN (SELECT target_id FROM tru) UNION ALL
(SELECT entity_id, country FROM ent WHERE b > 1 AND entity_id NOT IN (SELECT target_id FROM tru) ORDER BY entity_id LIMIT 100)"""
)
def distractor_sample(spark, d):
    t = V.entities(spark, d).where("bucket > 1").select("entity_id", "country")
    return sampling.with_distractors(t, V.truth(spark, d).select(F.col("target_id").alias("entity_id")).distinct(), 100, seed=None)


# Retrieval --------------------------------------------------------------------------------------------------------


@query(f"WITH {V.WORD_STAGE} SELECT country, term, round(idf, 6) AS idf FROM wd_v")
def word_vocabulary(spark, d):
    _, t = V.prepared(spark, d)
    return retrieval.weigh(t, retrieval.word_terms(F.col("x")))[0].withColumn("idf", F.round("idf", 6))


@query(f"WITH {V.CHAR_STAGE} SELECT country, term, round(idf, 6) AS idf FROM ch_v")
def char_vocabulary(spark, d):
    _, t = V.prepared(spark, d)
    return retrieval.weigh(t, retrieval.char_terms(F.col("x")), max_df=0.25)[0].withColumn("idf", F.round("idf", 6))


@query(f"WITH {V.CHAR_STAGE} SELECT country, term, round(idf, 6) AS idf FROM ch_v JOIN (SELECT country, term, sum(tf) AS n FROM ch_tf WHERE t GROUP BY ALL) USING (country, term) QUALIFY row_number() OVER (PARTITION BY country ORDER BY n DESC, term) <= 200")
def char_vocabulary_limited(spark, d):
    """The most frequent n-grams only, by the operator's max_features."""
    _, t = V.prepared(spark, d)
    return retrieval.weigh(t, retrieval.char_terms(F.col("x")), max_df=0.25, max_features=200)[0].withColumn("idf", F.round("idf", 6))


_NATIONS = "nat AS (SELECT 2 AS b, 'r' || n_regionkey AS country, n_nationkey AS id, lower(n_name) AS x FROM nation UNION ALL SELECT 2, 'one ' || r_regionkey, r_regionkey, lower(r_name) FROM region)"


@query(
    f"""WITH {_NATIONS}, src AS (SELECT b, country, id, x FROM nat), {V.CHARS}, {V.weights(0.02, "g", "ch", "grs")} SELECT country, term, round(idf, 6) AS idf FROM ch_v"""
)
def small_corpus_vocabulary(spark, d):
    """Corpora of a few rows and of a single one, where the bounds on document frequency give way."""
    n, r = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "region"))
    x = n.select(F.concat(F.lit("r"), "n_regionkey").alias("country"), F.col("n_nationkey").alias("id"), F.lower("n_name").alias("x"))
    x = x.unionByName(r.select(F.concat(F.lit("one "), "r_regionkey").alias("country"), F.col("r_regionkey").alias("id"), F.lower("r_name").alias("x")))
    return retrieval.weigh(x, retrieval.char_terms(F.col("x")))[0].withColumn("idf", F.round("idf", 6))


@query(f"WITH {V.WORD_STAGE} SELECT s1_id, target_id, score, rank FROM short")
def tfidf_word_topk(spark, d):
    return retrieval.shortlist(*V.prepared(spark, d)).select("s1_id", "target_id", "score", "rank")


@query(f"WITH {V.CHAR_STAGE} SELECT s1_id, target_id, score, rank FROM cand")
def two_stage_candidates(spark, d):
    """Both stages from the prepared records on, in one plan."""
    return retrieval.candidates(*V.prepared(spark, d))


_LISTED = "list(target_id ORDER BY rank)"


@query(
    f"""WITH {V.CHAR_STAGE}, {V.EXACT}, l AS (SELECT coalesce(a, []) AS a, coalesce(e, []) AS e FROM ent LEFT JOIN (SELECT s1_id, {_LISTED} AS a FROM cand GROUP BY 1) x ON x.s1_id = entity_id
 LEFT JOIN (SELECT s1_id, {_LISTED} AS e FROM exa GROUP BY 1) y ON y.s1_id = entity_id WHERE b = 1),
m AS (SELECT a, e, len(list_intersect(a, e)) AS shared, len(list_distinct(list_concat(a, e))) AS either FROM l)
SELECT count(*) AS queries, round(100 * avg(CASE WHEN len(e) > 0 THEN shared / len(e) ELSE 1 END), 6) AS recall, round(100 * avg(CASE WHEN either > 0 THEN shared / either ELSE 1 END), 6) AS jaccard,
round(100 * avg(CASE WHEN a = e THEN 1 ELSE 0 END), 6) AS same FROM m"""
)
def two_stage_against_exact(spark, d):
    return retrieval.compare(V.candidates(spark, d), retrieval.exact_candidates(*V.prepared(spark, d)), V.reference(spark, d))


@query(
    f"""WITH {V.CHAR_STAGE}, {V.TRUTH} SELECT n_true, captured, avg_candidates, singletons, without, CASE WHEN n_true = 0 THEN 100 ELSE round(100 * captured / n_true, 6) END AS recall
FROM (SELECT count(*) AS n_true, count(c.s1_id) AS captured FROM tru LEFT JOIN cand c USING (s1_id, target_id)),
(SELECT round(avg(coalesce(n, 0)), 6) AS avg_candidates, count(*) FILTER (entity_id NOT IN (SELECT s1_id FROM tru)) AS singletons, count(*) FILTER (n IS NULL) AS without
 FROM ent LEFT JOIN (SELECT s1_id, count(*) AS n FROM cand GROUP BY 1) ON s1_id = entity_id WHERE b = 1)"""
)
def recall_ceiling(spark, d):
    return retrieval.recall_report(V.candidates(spark, d), V.truth(spark, d), V.reference(spark, d))


@query(f"WITH {V.ADDRESSES}, c AS (SELECT o_orderkey AS id, regexp_extract(address, '\\b([0-9]{{5}})\\b', 1) AS code FROM adr) SELECT a.id AS s1_id, b.id AS target_id FROM c a JOIN c b USING (code) WHERE a.id % 100 = 0 AND a.id <> b.id")
def pincode_augment(spark, d):
    """The query set (ids divisible by 100) against all rows but itself."""
    c = V.addresses(spark, d).select(F.col("o_orderkey").alias("id"), T.pincode(F.col("address")).alias("code"))
    return retrieval.augment_by_code(c.where("id % 100 = 0"), c).where("s1_id <> target_id")


_SHARED = f"""tok AS (SELECT entity_id AS id, b, {_TOKENS} AS ts FROM pre), fl AS (SELECT id, b, unnest(ts) AS t FROM tok WHERE b > 1 OR len(ts) >= 2),
hit AS (SELECT a.id AS s1_id, t.id AS target_id, count(*) AS shared FROM fl a JOIN fl t ON a.t = t.t AND a.b = 1 AND t.b > 1 GROUP BY ALL HAVING count(*) >= 2)"""


@query(f"WITH {V.ENTITIES}, {V.PREPARED}, {_SHARED} SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY shared DESC, target_id) <= 60")
def token_overlap_augment(spark, d):
    t = V.entities(spark, d).select(F.col("entity_id").alias("id"), "bucket", T.name_tokens(F.col("business_name")).alias("tokens"))
    return retrieval.augment_by_tokens(t.where("bucket = 1"), t.where("bucket > 1"))


@query(
    f"""WITH {V.CHAR_STAGE}, {V.TRUTH}, mk AS (SELECT c.*, t.s1_id IS NOT NULL AS hit FROM ch_c c LEFT JOIN tru t USING (s1_id, target_id) WHERE score >= 0.10),
bud AS (SELECT entity_id AS s1_id, CASE WHEN n IS NULL THEN 4 ELSE greatest(0, least(20 - coalesce(p, 0), greatest(3, round_even(3.5 * n, 0)))) END AS budget FROM ent
 LEFT JOIN (SELECT s1_id, count(*) AS n FROM tru GROUP BY 1) x ON x.s1_id = entity_id LEFT JOIN (SELECT s1_id, count(*) FILTER (hit) AS p FROM mk GROUP BY 1) y ON y.s1_id = entity_id WHERE b = 1)
SELECT s1_id, target_id FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY CASE WHEN score BETWEEN 0.35 AND 0.65 THEN 0 ELSE 1 END, target_id) AS place FROM mk WHERE NOT hit) JOIN bud USING (s1_id) WHERE place <= budget"""
)
def hard_negatives(spark, d):
    return retrieval.hard_negatives(V.scored(spark, d), V.truth(spark, d), V.reference(spark, d))


# Pair features ----------------------------------------------------------------------------------------------------


def _name_pairs(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.lower("p_name").alias("a"))
    return p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b")), "p_partkey")


_PAIRS = "pr AS (SELECT p.p_partkey, lower(p.p_name) AS a, lower(q.p_name) AS b FROM part p JOIN part q ON q.p_partkey - 1 = p.p_partkey)"


@query(f"WITH {_PAIRS} SELECT p_partkey, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS lev, round(CASE WHEN a = '' OR b = '' THEN 0 ELSE jaro_winkler_similarity(a, b) END, 6) AS jw FROM pr")
def levenshtein_and_jaro(spark, d):
    a, b = F.col("a"), F.col("b")
    return _name_pairs(spark, d).select("p_partkey", F.round(fuzzy.levenshtein_norm(a, b), 6).alias("lev"), F.round(fuzzy.similarities(a, b, "jw")["jw"], 6).alias("jw"))


_PARTS = V.set_parts("a", "b")


@query(
    f"""WITH RECURSIVE {_PAIRS}, fz AS (SELECT p_partkey, {V.sorted_words("a")} AS sa, {V.sorted_words("b")} AS sb, {_PARTS[0]} AS shared, {_PARTS[1]} AS l, {_PARTS[2]} AS r FROM pr),
{V.subsequences("SELECT sa AS a, sb AS b FROM fz UNION ALL SELECT l, r FROM fz")}
SELECT p_partkey, round({V.ratio("sa", "sb", "m.l")}, 6) AS sort, round({V.set_ratio("shared", "fz.l", "r", "n.l")}, 6) AS "set" FROM fz LEFT JOIN lcs m ON m.a = sa AND m.b = sb LEFT JOIN lcs n ON n.a = fz.l AND n.b = r"""
)
def token_ratios(spark, d):
    s = fuzzy.similarities(F.col("a"), F.col("b"), "sort", "set")
    return _name_pairs(spark, d).select("p_partkey", F.round(s["sort"], 6).alias("sort"), F.round(s["set"], 6).alias("set"))


@query(
    f"""WITH {V.ADDRESSES}, nb AS (SELECT a.o_orderkey, a.address AS x, b.address AS y FROM adr a JOIN adr b ON b.o_orderkey = a.o_orderkey + 1),
f AS (SELECT *, {V.numbers("x")} AS u, {V.numbers("y")} AS v, {V.number("x")} AS p, {V.number("y")} AS q, {V.state("x")} AS s, {V.state("y")} AS t FROM nb)
SELECT o_orderkey, round(CASE WHEN len(u) = 0 OR len(v) = 0 THEN 0 ELSE len(list_intersect(u, v)) / len(list_distinct(list_concat(u, v))) END, 6) AS jaccard,
round(abs(length(x) - length(y)) / greatest(length(x), length(y), 1), 6) AS len_diff, CASE WHEN s <> '' AND t <> '' AND s <> t THEN 1::DOUBLE ELSE 0::DOUBLE END AS state,
CASE WHEN p <> q AND abs(p - q) > 1 AND NOT starts_with(CAST(p AS VARCHAR), CAST(q AS VARCHAR)) AND NOT starts_with(CAST(q AS VARCHAR), CAST(p AS VARCHAR)) THEN 1::DOUBLE ELSE 0::DOUBLE END AS door FROM f"""
)
def address_pair_features(spark, d):
    a = V.addresses(spark, d)
    j = a.select("o_orderkey", F.col("address").alias("x")).join(a.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("address").alias("y")), "o_orderkey")
    x, y = F.col("x"), F.col("y")
    return j.select(
        "o_orderkey", F.round(features.numeric_jaccard(T.numeric_tokens(x), T.numeric_tokens(y)), 6).alias("jaccard"), F.round(features.len_diff(x, y), 6).alias("len_diff"),
        features.state_conflict(T.state_token(x), T.state_token(y)).alias("state"), features.door_conflict(T.primary_number(x), T.primary_number(y)).alias("door"),
    )


_EXC = "len(list_filter({a}, t -> NOT list_contains({b}, t)))"


def _feature_sql(version: str) -> str:
    """The features of a version, column by column."""
    flag = lambda x: f"CASE WHEN {x} THEN 1::DOUBLE ELSE 0::DOUBLE END"
    blank = "(ca = '' OR ta = '')"
    jw = lambda a, b: f"CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE jaro_winkler_similarity({a}, {b}) END"
    apart = lambda a, b: f"abs(length({a}) - length({b})) / greatest(length({a}), length({b}), 1)"
    bare = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"
    named = version in ("v16", "v18_train")
    label = lambda s, n: f"CASE WHEN {s} <> '' THEN {s} ELSE {bare(n) if named else chr(39) * 2} END"
    sa, sb = label("sd", "cn"), label("td", "tn")
    on_address = lambda x: f"CASE WHEN {blank} THEN 0 ELSE {x} END" if named else x
    columns = {
        "name_token_sort_ratio": V.ratio("nsa", "nsb", "n1.l"), "name_token_set_ratio": V.set_ratio("nb", "nl", "nr", "n2.l"),
        "addr_token_sort_ratio": on_address(V.ratio("asa", "asb", "a1.l")), "addr_token_set_ratio": on_address(V.set_ratio("ab", "al", "ar", "a2.l")),
        "name_jaro_winkler": jw("cn", "tn"), "name_levenshtein_norm": "CASE WHEN greatest(length(cn), length(tn)) = 0 THEN 1 ELSE 1 - levenshtein(cn, tn) / greatest(length(cn), length(tn)) END",
        "addr_jaro_winkler": on_address(jw("ca", "ta")),
        "numeric_token_overlap": "CASE WHEN len(an) = 0 OR len(bn) = 0 THEN 0 ELSE len(list_intersect(an, bn)) / len(list_distinct(list_concat(an, bn))) END",
        "postal_pin_exact_match": flag("list_has_any(ap, bp)"), "numeric_pincode_match": flag("list_has_any(ac, bc)"),
        "domain_match": flag(f"(sd <> '' OR td <> '') AND {sa} <> '' AND {sa} = {sb}"), "script_mismatch": flag("rn <> '' AND rt <> '' AND (strlen(rn) <> length(rn)) <> (strlen(rt) <> length(rt))"),
        "len_diff_name": apart("cn", "tn"), "len_diff_addr": apart("ca", "ta") if version == "v18_tolerant" else f"CASE WHEN {blank} THEN 1 ELSE {apart('ca', 'ta')} END",
    }
    if version == "v16":
        columns |= {"is_addr_missing": "CAST(tm AS DOUBLE)", "blocking_rank": "CAST(rank AS DOUBLE)"}
    else:
        columns |= {"is_missing": flag("ta = ''"), "state_conflict": flag("ss <> '' AND ts <> '' AND ss <> ts")}
        stop = V.STOP_FORMS if version == "v18_batch" else V.STOP
        x, y = (f"len(list_filter({p}, t -> NOT list_contains({q}, t) AND NOT list_contains({stop}, t)))" for p, q in (("aw", "bw"), ("bw", "aw")))
        if version == "v18_train":
            columns["door_conflict"] = flag(f"coalesce(sn <> tnr AND {V.ratio('asa', 'asb', 'a1.l')} >= 0.70, false)")
            columns["extra_words"] = f"CAST({_EXC.format(a='bw', b='aw')} AS DOUBLE)"
        else:
            columns["door_conflict"] = flag("coalesce(sn <> tnr AND abs(sn - tnr) > 1 AND NOT starts_with(CAST(sn AS VARCHAR), CAST(tnr AS VARCHAR)) AND NOT starts_with(CAST(tnr AS VARCHAR), CAST(sn AS VARCHAR)), false)")
            columns["extra_words"] = f"CASE WHEN {x} > 0 AND {y} > 0 THEN least(1.0, ({x} + {y}) / greatest(len(list_distinct(list_concat(aw, bw))), 1)) ELSE 0 END"

    def side(p: str, *names: str) -> str:
        name, address, both = f"{p}.clean_name", f"{p}.clean_addr", f"{p}.clean_name || ' ' || {p}.clean_addr"
        found = [name, address, f"{p}.name", f"{p}.stem", V.numbers(both), V.pins(both), f"list_concat({V.pins(address)}, {V.premises(address)})", V.state(f"{p}.addr"), V.number(f"{p}.addr"), V.words(name)]
        return ", ".join(f"{e} AS {n}" for e, n in zip(found, names, strict=True))

    mine, theirs = side("a", "cn", "ca", "rn", "sd", "an", "ap", "ac", "ss", "sn", "aw"), side("t", "tn", "ta", "rt", "td", "bn", "bp", "bc", "ts", "tnr", "bw")
    rounded = ", ".join(f"round({e}, 6) AS {n}" for n, e in columns.items())
    names, addresses = V.set_parts("cn", "tn"), V.set_parts("ca", "ta")
    return f"""WITH RECURSIVE {V.CHAR_STAGE}, pw AS (SELECT c.s1_id, c.target_id, c.rank, t.miss AS tm, {mine}, {theirs} FROM cand c JOIN pre a ON a.entity_id = c.s1_id JOIN pre t ON t.entity_id = c.target_id),
fz AS (SELECT *, {V.sorted_words("cn")} AS nsa, {V.sorted_words("tn")} AS nsb, {names[0]} AS nb, {names[1]} AS nl, {names[2]} AS nr, {V.sorted_words("ca")} AS asa, {V.sorted_words("ta")} AS asb, {addresses[0]} AS ab, {addresses[1]} AS al, {addresses[2]} AS ar FROM pw),
{V.subsequences("SELECT nsa AS a, nsb AS b FROM fz UNION ALL SELECT nl, nr FROM fz UNION ALL SELECT asa, asb FROM fz UNION ALL SELECT al, ar FROM fz")}
SELECT s1_id, target_id, {rounded} FROM fz LEFT JOIN lcs n1 ON n1.a = nsa AND n1.b = nsb LEFT JOIN lcs n2 ON n2.a = nl AND n2.b = nr LEFT JOIN lcs a1 ON a1.a = asa AND a1.b = asb LEFT JOIN lcs a2 ON a2.a = al AND a2.b = ar"""


def _pairs_of(spark, d, version):
    e = V.entities(spark, d)
    return features.pair_features(V.candidates(spark, d), e.where("bucket = 1"), e.where("bucket > 1"), version)


def _features(version: str):
    def run(spark, d):
        columns = features.V16 if version == "v16" else features.V18
        return _pairs_of(spark, d, version).select("s1_id", "target_id", *[F.round(c, 6).alias(c) for c in columns])

    run.__name__ = f"feature_vector_{version}"
    return run


for _version in ("v16", "v18_train", "v18_tolerant", "v18_batch"):
    query(_feature_sql(_version))(_features(_version))


@query(f"WITH {V.CHAR_STAGE}, raw AS (SELECT s1_id, target_id, rank FROM cand UNION ALL SELECT s1_id, 'S9-' || target_id, rank FROM cand) SELECT s1_id, target_id, rank FROM raw WHERE target_id IN (SELECT entity_id FROM ent WHERE b > 1)")
def known_candidates(spark, d):
    """Candidates that have no record go; the others keep their rank."""
    c = V.candidates(spark, d).select("s1_id", "target_id", "rank")
    both = c.unionByName(c.withColumn("target_id", F.concat(F.lit("S9-"), "target_id")))
    e = V.entities(spark, d)
    return features.known_pairs(both, e.where("bucket = 1"), e.where("bucket > 1"))


# Decisions, evaluation, validation: the character cosine stands for a model's probability ---------------------------


def _scored(spark, d):
    return V.candidates(spark, d).withColumnRenamed("score", "prob")


_KEPT = """k AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, rank) AS place FROM (SELECT *, max(score) OVER (PARTITION BY s1_id) AS best FROM cand)
 WHERE best >= {singleton} AND score >= {link} AND score >= {margin} * best)"""
_LISTS = "SELECT entity_id AS s1_id, coalesce(string_agg(target_id, ',' ORDER BY {by}), '') AS matches FROM ent LEFT JOIN (SELECT * FROM k WHERE place <= {cap}) ON s1_id = entity_id WHERE b = 1 GROUP BY entity_id"


@query(f"WITH {V.CHAR_STAGE}, {_KEPT.format(singleton=0.3, link=0.5, margin=0)} {_LISTS.format(by='rank', cap=99999)}")
def decide_dual(spark, d):
    return decide.decide(_scored(spark, d), V.reference(spark, d), order="rank", link=0.5, singleton=0.3)


@query(f"WITH {V.CHAR_STAGE}, {_KEPT.format(singleton=0.35, link=0.45, margin=0.7)} {_LISTS.format(by='place', cap=5)}")
def decide_margin_cap(spark, d):
    return decide.decide(_scored(spark, d), V.reference(spark, d), link=0.45, singleton=0.35, margin=0.7, cap=5)


@query(f"WITH {V.CHAR_STAGE}, {_KEPT.format(singleton=0.30, link=0.70, margin=0.82)} {_LISTS.format(by='rank', cap=99999)}")
def decide_margin_in_order(spark, d):
    return decide.decide(_scored(spark, d), V.reference(spark, d), order="rank", link=0.70, singleton=0.30, margin=0.82)


@query(f"WITH {V.CHAR_STAGE}, {_KEPT.format(singleton=0, link=0.8, margin=0)} {_LISTS.format(by='rank', cap=99999)}")
def decide_single_threshold(spark, d):
    return decide.decide(_scored(spark, d), V.reference(spark, d), order="rank", link=0.8, singleton=0.0)


@query(
    f"""WITH {V.CHAR_STAGE}, j AS (SELECT c.*, {V.numbers("a.addr")} AS u, {V.numbers("t.addr")} AS v, max(score) OVER (PARTITION BY s1_id) AS best FROM cand c JOIN ent a ON a.entity_id = c.s1_id JOIN ent t ON t.entity_id = c.target_id),
k AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, rank) AS place FROM j WHERE best >= 0.35 AND score >= 0.40 AND score >= 0.75 * best AND NOT (len(u) > 0 AND len(v) > 0 AND NOT list_has_any(u, v)))
{_LISTS.format(by="place", cap=5)}"""
)
def decide_veto(spark, d):
    """Pairs whose addresses have numbers, but none in common, are ruled out."""
    e = V.entities(spark, d).select("entity_id", T.numeric_tokens(F.col("business_address")).alias("n"))
    a, t = e.select(F.col("entity_id").alias("s1_id"), F.col("n").alias("u")), e.select(F.col("entity_id").alias("target_id"), F.col("n").alias("v"))
    marked = _scored(spark, d).join(a, "s1_id").join(t, "target_id").withColumn("other_house", T.conflict(F.col("u"), F.col("v")))
    return decide.decide(marked, V.reference(spark, d), link=0.40, singleton=0.35, margin=0.75, cap=5, veto="other_house")


_QUOTA = """j AS (SELECT c.*, t.clean_addr = '' AS miss, {sim} AS sim, max(score) OVER (PARTITION BY s1_id) AS best FROM cand c JOIN pre a ON a.entity_id = c.s1_id JOIN pre t ON t.entity_id = c.target_id),
f AS (SELECT *, row_number() OVER (PARTITION BY s1_id, miss ORDER BY score DESC, rank) AS q FROM j WHERE best >= 0.2 AND score >= 0.2 AND score >= 0.5 * best AND (NOT miss OR sim >= {least})),
k AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, rank) AS place FROM f WHERE NOT miss OR q <= 1)"""
_LEV = "CASE WHEN greatest(length(a.clean_name), length(t.clean_name)) = 0 THEN 1 ELSE 1 - levenshtein(a.clean_name, t.clean_name) / greatest(length(a.clean_name), length(t.clean_name)) END"


def _with_missing(spark, d):
    p = V.records(spark, d)
    t = p.select(F.col("entity_id").alias("target_id"), (F.col("clean_addr") == "").cast("int").alias("is_missing"), F.col("clean_name").alias("t_name"))
    return _scored(spark, d).join(t, "target_id").join(p.select(F.col("entity_id").alias("s1_id"), F.col("clean_name").alias("a_name")), "s1_id")


@query(f"WITH {V.CHAR_STAGE}, {_QUOTA.format(sim='1', least=0)} {_LISTS.format(by='place', cap=99999)}")
def decide_quota(spark, d):
    return decide.decide(_with_missing(spark, d), V.reference(spark, d), link=0.2, singleton=0.2, margin=0.5, missing_quota=1)


@query(f"WITH {V.CHAR_STAGE}, {_QUOTA.format(sim=_LEV, least=0.6)} {_LISTS.format(by='place', cap=99999)}")
def decide_quota_by_name(spark, d):
    """A target without an address needs a similar name; here by edit distance, which SQL knows."""
    marked = _with_missing(spark, d).withColumn("name_sim", fuzzy.levenshtein_norm(F.col("a_name"), F.col("t_name")))
    return decide.decide(marked, V.reference(spark, d), link=0.2, singleton=0.2, margin=0.5, missing_quota=1, missing_least=0.6)


@query(f"WITH {V.CHAR_STAGE} SELECT s1_id, target_id, round((0.4 * score + 0.25 * score * score) / 0.65, 6) AS prob, round((0.35 * score + score * score) / 1.35, 6) AS other FROM cand")
def blend(spark, d):
    """Two of three models are loaded; then one that has a weight and one that has none."""
    s = _scored(spark, d).withColumn("square", F.col("prob") * F.col("prob"))
    two, odd = decide.blend_loaded({"catboost": "prob", "lightgbm": "square"}), decide.blend_loaded({"xgboost": "prob", "unknown": "square"})
    return s.select("s1_id", "target_id", F.round(two, 6).alias("prob"), F.round(odd, 6).alias("other"))


def _f(recall_wrong: str, margin: float = 0.7) -> str:
    return f"""WITH {V.CHAR_STAGE}, {V.TRUTH}, {_KEPT.format(singleton=0.35, link=0.45, margin=margin)},
c AS (SELECT entity_id, coalesce(p, 0) AS np, coalesce(t, 0) AS nt, coalesce(h, 0) AS tp FROM ent LEFT JOIN (SELECT s1_id, count(*) AS p FROM k GROUP BY 1) a ON a.s1_id = entity_id
 LEFT JOIN (SELECT s1_id, count(*) AS t FROM tru GROUP BY 1) e ON e.s1_id = entity_id LEFT JOIN (SELECT s1_id, count(*) AS h FROM tru JOIN k USING (s1_id, target_id) GROUP BY 1) g ON g.s1_id = entity_id WHERE b = 1)
SELECT round(avg(CASE WHEN np = 0 AND nt = 0 THEN 1 WHEN np = 0 OR nt = 0 OR tp = 0 THEN 0 ELSE 1.25 * (tp / np) * (tp / nt) / (0.25 * tp / np + tp / nt) END), 6) AS macro_f05,
round(avg(CASE WHEN np = 0 AND nt = 0 THEN 1 WHEN np = 0 OR nt = 0 THEN 0 ELSE tp / np END), 6) AS macro_precision,
round(avg(CASE WHEN np = 0 AND nt = 0 THEN 1 WHEN nt = 0 THEN {recall_wrong} WHEN np = 0 THEN 0 ELSE tp / nt END), 6) AS macro_recall FROM c"""


def _macro(spark, d, lenient):
    return evaluate.macro(decide.kept(_scored(spark, d), link=0.45, singleton=0.35, margin=0.7), V.truth(spark, d), V.reference(spark, d), lenient)


@query(_f("1"))
def macro_f05(spark, d):
    return _macro(spark, d, True)


@query(_f("0"))
def macro_f05_script(spark, d):
    return _macro(spark, d, False)


@query(
    f"""WITH {V.CHAR_STAGE}, {_KEPT.format(singleton=0.35, link=0.45, margin=0.7)}, n AS (SELECT (SELECT count(*) FROM k) / (SELECT count(*) FROM ent WHERE b = 1) AS a)
SELECT round(a, 6) AS avg_matches, CASE WHEN a > 4.5 THEN 'high' WHEN a < 2.0 THEN 'low' ELSE 'ok' END AS band FROM n"""
)
def match_band(spark, d):
    return evaluate.match_band(decide.kept(_scored(spark, d), link=0.45, singleton=0.35, margin=0.7), V.reference(spark, d))


_GRID = """WITH {stage}, {truth}, g AS (SELECT * FROM (SELECT unnest({s}) AS singleton), (SELECT unnest({l}) AS link), (SELECT unnest({m}) AS margin), (SELECT unnest({c}) AS cap)),
h AS (SELECT k.*, g.*, row_number() OVER (PARTITION BY s1_id, singleton, link, margin, cap, miss ORDER BY score DESC, rank) AS q FROM
 (SELECT c.*, t.clean_addr = '' AS miss, max(score) OVER (PARTITION BY s1_id) AS best FROM cand c JOIN pre t ON t.entity_id = c.target_id) k, g WHERE best >= singleton AND score >= link AND score >= margin * best),
k AS (SELECT *, row_number() OVER (PARTITION BY s1_id, singleton, link, margin, cap ORDER BY score DESC, rank) AS place FROM h WHERE NOT miss OR q <= {quota} QUALIFY place <= cap),
n AS (SELECT singleton, link, margin, cap, s1_id, count(*) AS np, count(t.target_id) AS tp FROM k LEFT JOIN tru t USING (s1_id, target_id) GROUP BY ALL),
c AS (SELECT g.*, coalesce(np, 0) AS np, coalesce(tp, 0) AS tp, coalesce(nt, 0) AS nt FROM ent CROSS JOIN g LEFT JOIN n ON n.s1_id = entity_id AND n.singleton = g.singleton AND n.link = g.link AND n.margin = g.margin AND n.cap = g.cap
 LEFT JOIN (SELECT s1_id, count(*) AS nt FROM tru GROUP BY 1) t ON t.s1_id = entity_id WHERE b = 1)
SELECT singleton, link, margin, cap, round(avg(CASE WHEN np = 0 AND nt = 0 THEN 1 WHEN np = 0 OR nt = 0 OR tp = 0 THEN 0 ELSE 1.25 * (tp / np) * (tp / nt) / (0.25 * tp / np + tp / nt) END), 6) AS macro_f05 FROM c GROUP BY ALL"""
#: Instead of no cap.
_ALL = 1 << 30


def _grid_query(name: str, singletons: list, links: list, margins: list, caps: list, quota: int | None = None):
    doubles = lambda v: "[" + ", ".join(f"{x}::DOUBLE" for x in v) + "]"

    def run(spark, d):
        scored = _with_missing(spark, d) if quota is not None else _scored(spark, d)
        return evaluate.grid(scored, V.truth(spark, d), V.reference(spark, d), links, singletons, margins, caps, missing_quota=quota).drop("visit")

    run.__name__ = name
    query(_GRID.format(stage=V.CHAR_STAGE, truth=V.TRUTH, s=doubles(singletons), l=doubles(links), m=doubles(margins), c=caps, quota=_ALL if quota is None else quota))(run)


# The surveyed grids.
_grid_query("grid_1d", [0.0], [0.70, 0.75, 0.78, 0.80, 0.82, 0.84, 0.86, 0.88, 0.90], [0.0], [_ALL])
_grid_query("grid_2d", [0.2, 0.25, 0.3, 0.35, 0.4], [0.65, 0.67, 0.69, 0.71, 0.73, 0.75, 0.77, 0.79, 0.81, 0.83, 0.85], [0.0], [_ALL])
_grid_query("grid_3d", [0.30], [0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.88, 0.90], [0.75, 0.80, 0.85, 0.88, 0.90, 0.95], [4, 5, 6, _ALL])
_grid_query("grid_4d", [0.30, 0.40, 0.50, 0.60, 0.70], [0.75, 0.80, 0.83, 0.85, 0.87, 0.88, 0.90, 0.92], [0.80, 0.85, 0.88, 0.90, 0.92, 0.95, 1.00], [4, 5, 6, 7, _ALL], quota=1)


@query(f"WITH {V.CHAR_STAGE} SELECT count(*) AS n, count(*) FILTER (score > 0.9) AS over_90, count(*) FILTER (score > 0.7) AS over_70, count(*) FILTER (score > 0.5) AS over_50, count(*) FILTER (score < 0.3) AS under_30 FROM cand")
def prob_histogram(spark, d):
    return evaluate.histogram(_scored(spark, d))


@query(f"WITH {V.CHAR_STAGE}, {V.TRUTH} SELECT s1_id, target_id, CASE WHEN t.s1_id IS NULL THEN 0::DOUBLE ELSE 1::DOUBLE END AS label FROM cand c LEFT JOIN tru t USING (s1_id, target_id)")
def label_pairs(spark, d):
    return model.label(_scored(spark, d), V.truth(spark, d)).select("s1_id", "target_id", "label")


@query("SELECT count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality = 0) AS negatives FROM labels")
def class_balance(spark, d):
    return model.balance(spark.read.parquet(f"{d}/labels.parquet").withColumn("label", F.col("quality")))


_SUBMITTED = """sub AS (SELECT 'S' || CASE WHEN c_custkey % 50 = 0 THEN '2' ELSE '1' END || '-' || (c_custkey - CASE WHEN c_custkey % 40 = 1 THEN 1 ELSE 0 END) AS s1_id,
 ['S2-' || c_custkey, CASE WHEN c_custkey % 30 = 0 THEN 'S1-1' WHEN c_custkey % 31 = 0 THEN 'X9' WHEN c_custkey % 37 = 0 THEN 'S2-' || c_custkey ELSE 'S3-1' END] AS ids FROM customer),
req AS (SELECT 'S1-' || c_custkey AS id FROM customer)"""


def _submitted(spark, d):
    k = F.col("c_custkey")
    c = spark.read.parquet(f"{d}/customer.parquet")
    first = F.concat(F.when(k % 50 == 0, "S2-").otherwise("S1-"), k - F.when(k % 40 == 1, 1).otherwise(0))
    own = F.concat(F.lit("S2-"), k)
    second = F.when(k % 30 == 0, "S1-1").when(k % 31 == 0, "X9").when(k % 37 == 0, own).otherwise("S3-1")
    return c.select(first.alias("s1_id"), F.array(own, second).alias("ids")), c.select(F.concat(F.lit("S1-"), k).alias("id"))


@query(
    f"""WITH {_SUBMITTED}, knw AS (SELECT 'S2-' || s_suppkey AS id FROM supplier UNION ALL SELECT 'S3-1'),
er AS (SELECT 'duplicate_row' AS rule, s1_id FROM sub GROUP BY s1_id HAVING count(*) > 1 UNION ALL SELECT 'duplicate_id', s1_id FROM sub WHERE len(ids) <> len(list_distinct(ids))
UNION ALL SELECT 'self_match', s1_id FROM sub WHERE len(list_filter(ids, x -> starts_with(x, 'S1-'))) > 0 UNION ALL SELECT 'bad_prefix', s1_id FROM sub WHERE len(list_filter(ids, x -> NOT regexp_matches(x, '^S[123]-'))) > 0
UNION ALL SELECT 'missing_row', id FROM req WHERE id NOT IN (SELECT s1_id FROM sub) UNION ALL SELECT DISTINCT 'extra_row', s1_id FROM sub WHERE s1_id NOT IN (SELECT id FROM req)
UNION ALL SELECT DISTINCT 'unknown_id', s1_id FROM (SELECT s1_id, unnest(ids) AS x FROM sub) WHERE x NOT IN (SELECT id FROM knw))
SELECT rule, CAST(count(*) AS BIGINT) AS n, array_to_string(list_sort(list_distinct(list(s1_id)))[1:5], ',') AS examples FROM er GROUP BY rule"""
)
def validate_report(spark, d):
    lists, required = _submitted(spark, d)
    known = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("S2-"), "s_suppkey").alias("id")).union(spark.range(1).select(F.lit("S3-1")))
    return validate.report(validate.errors(lists, required, known))


@query(f"WITH {_SUBMITTED} SELECT count(*) AS rows, count(*) FILTER (len(ids) = 0) AS empty, count(*) FILTER (len(ids) > 0) AS filled FROM (SELECT list_filter(ids, x -> NOT starts_with(x, 'S2-') AND x <> 'S3-1') AS ids FROM sub)")
def validate_counts(spark, d):
    lists, _ = _submitted(spark, d)
    return validate.counts(lists.withColumn("ids", F.filter("ids", lambda x: ~x.startswith("S2-") & (x != "S3-1"))))


@query("SELECT value FROM (SELECT CASE WHEN c_custkey % 7 = 0 THEN '  ' WHEN c_custkey % 11 = 0 THEN c_name ELSE c_name || chr(9) || 'S2-' || c_custkey END AS value FROM customer) WHERE trim(value) <> '' AND NOT contains(value, chr(9))")
def validate_lines(spark, d):
    k = F.col("c_custkey")
    value = F.when(k % 7 == 0, "  ").when(k % 11 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("\tS2-"), k))
    return validate.bad_lines(spark.read.parquet(f"{d}/customer.parquet").select(value.alias("value")))


@query(f"WITH {V.CHAR_STAGE}, {V.TRUTH}, {_KEPT.format(singleton=0.7, link=0.8, margin=0.95)} SELECT s1_id, target_id FROM k WHERE NOT EXISTS (SELECT 1 FROM tru t WHERE t.s1_id = k.s1_id AND t.target_id = k.target_id)")
def matches_outside_candidates(spark, d):
    """Of strict matches those that the truth, taken as the candidate list, lacks."""
    return validate.outside_candidates(decide.kept(_scored(spark, d), link=0.8, singleton=0.7, margin=0.95).select("s1_id", "target_id"), V.truth(spark, d))


@query(
    f"""WITH {V.ADDRESSES}, f AS (SELECT o_custkey, o_orderkey, {V.premises("address")} AS u FROM adr), p AS (SELECT u, lead(u) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS v FROM f)
SELECT round(100 * avg(CASE WHEN len(u) > 0 AND len(v) > 0 AND NOT list_has_any(u, v) THEN 1 ELSE 0 END), 6) AS conflict_share FROM p WHERE v IS NOT NULL"""
)
def house_number_conflicts(spark, d):
    """Share of true pairs (a customer's consecutive orders) whose premise tokens have nothing in common."""
    a = V.addresses(spark, d).select("o_custkey", "o_orderkey", T.premise_tokens(F.col("address")).alias("u"))
    j = a.withColumn("v", F.lead("u").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("v IS NOT NULL")
    return j.agg(F.round(100 * F.avg(F.when(T.conflict(F.col("u"), F.col("v")), 1).otherwise(0)), 6).alias("conflict_share"))


@query()
def boosted_trees(spark, d):
    """Trained on the candidates' features against the equal-title truth; scores of all candidates."""
    pairs = V.shared(spark, d, "features", lambda: _pairs_of(spark, d, "v16"))
    marked = model.split(model.label(pairs, V.truth(spark, d)))
    fitted = model.train(marked, features.V16)
    return model.score(fitted, marked).select("s1_id", "target_id", "label", F.round("prob", 6).alias("prob"))
