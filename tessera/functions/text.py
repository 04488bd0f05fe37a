"""Text, address and identifier functions as column expressions; all stay in the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a legal form, an address contraction, a state, a stop word, a URL and its endings (TLD), a premise
# word and its number (PREMISE, NUMBERED, LEADING, COMPOUND), and a primary number.  Digits are [0-9], as engines differ in \d.
LEGAL = (
    r"private\s+limited|pvt\s+ltd|incorporated|corporation|enterprises|associates|industries|solutions|services|limited|company|pvt|ltd|inc|corp"
    r"|l\s+l\s+c|llc|l\s+l\s+p|llp|pllc|s\s+a\s+r\s+l|sarl|s\s+a\s+s\s+u|sasu|e\s+u\s+r\s+l|eurl|s\s+a\s+s|sas|gmbh|s\s+a|sa|sci|snc|gie|c\s+o|co"
)
CONTRACTIONS = [
    ("rd", "road"), ("st", "street"), ("ave", "avenue"), ("av", "avenue"), ("blvd", "boulevard"), ("bvd", "boulevard"), ("bd", "boulevard"), ("dr", "drive"),
    ("ln", "lane"), ("ct", "court"), ("pkwy", "parkway"), ("pkg", "parking"), ("hwy", "highway"), ("rte", "route"), ("r", "rue"), ("opp", "opposite"),
    ("b/h", "behind"), ("nr", "near"), ("apt", "apartment"), ("flt", "flat"), ("ste", "suite"), ("bldg", "building"), ("fl", "floor"),
    (r"h\.?no\.?", "house number"), ("hno", "house number"), ("n", "north"), ("s", "south"), ("e", "east"), ("w", "west"), ("ne", "northeast"),
    ("nw", "northwest"), ("se", "southeast"), ("sw", "southwest"),
]
STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY".split()
STOP = "the a an of and & or for in at to by le la les de du des".split()
STOP_FORMS = [*STOP, "pvt", "ltd", "llc", "inc", "corp", "co"]
TLD = "co\\.in|org\\.in|com|in|org|fr|net|co|io|biz|info|gov|edu|eu|us"
URL = rf"(?i)((?:https?://)?(?:www\d*\.)?[a-zA-Z0-9][-a-zA-Z0-9.]*\.(?:{TLD})\b(?:/[^\s]*)?)"
PREMISE = r"(?i)\b(?:plot|polt|h\.?no|house|flat|f\.?no|d\.?no|door|unit|shop|suite|ste|apt|bldg)\b(?:\s*no\.?)?\s*[:#-]?\s*([a-zA-Z0-9/-]+)"
NUMBERED = r"(?i)\bno\.?\s*[:#-]?\s*([0-9]+[a-zA-Z0-9/-]*)"
LEADING = r"(?:^|,\s*)([0-9]{1,5}[a-zA-Z]?)\b"
COMPOUND = r"\b([0-9]{1,4}[-/][0-9]{1,4}(?:[-/][0-9]{1,4})?)\b"
PRIMARY = r"(?i)\b(?:no\.?|h\.?no\.?|flat|door|ews|unit|suite|ste|apt|n°)?\s*[:#-]?\s*([0-9]+)"


def _ranges(points: list[int]) -> str:
    """A character class of code points, ascending."""
    out, first = [], None
    for i, p in enumerate(points):
        first = p if first is None else first
        if i + 1 == len(points) or points[i + 1] != p + 1:
            out.append(f"\\x{{{first:x}}}-\\x{{{p:x}}}")
            first = None
    return "[" + "".join(out) + "]"


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, dict[str, str], str, str]:
    """From the Unicode tables, by full decomposition without combining marks: characters that give one ASCII letter, digit or
    ampersand, and these; those that give several characters with such a one among them, and a class of them; a class of marks.
    """
    one, plain, several, marks = [], [], {}, []
    for i in range(0x80, 0x110000):
        c = chr(i)
        if 0xAC00 <= i < 0xD7A4 or 0x20000 <= i < 0xE0000:  # hangul and ideographs give no ASCII
            continue
        if unicodedata.combining(c):
            marks.append(i)
            continue
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if not bare:
            marks.append(i)
        if not any(x.isascii() and (x.isalnum() or x == "&") for x in bare):
            continue
        if len(bare) == 1:
            one.append(c)
            plain.append(bare)
        else:
            several[c] = bare
    return "".join(one), "".join(plain), several, _ranges(sorted(map(ord, several))), _ranges(marks)


def fold_accents(x: Column) -> Column:
    """Letters without their marks, compatibility forms in full (ligatures, fractions, squared letters); ASCII text passes untouched."""
    one, plain, several, rare, marks = _folding()
    table = F.create_map(*[F.lit(v) for pair in several.items() for v in pair])
    full = F.array_join(F.transform(F.split(x, ""), lambda c: F.when(c.rlike(rare), F.element_at(table, c)).otherwise(c)), "")
    spelt = F.when(x.rlike(rare), full).otherwise(x)
    return F.when(F.octet_length(x) == F.char_length(x), x).otherwise(F.regexp_replace(F.translate(spelt, one, plain), marks, ""))


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def normalize_text(x: Column) -> Column:
    plain = F.replace(F.lower(fold_accents(F.coalesce(x, F.lit("")))), F.lit("&"), F.lit(" and "))
    return squeeze(F.regexp_replace(plain, r"[^a-z0-9\s]", " "))


def strip_legal_forms(x: Column) -> Column:
    """Of normalised text; forms go wherever they stand."""
    return squeeze(F.regexp_replace(x, rf"\b(?:{LEGAL})\b", " "))


def clean_name(x: Column) -> Column:
    return strip_legal_forms(normalize_text(x))


def expand_contractions(x: Column) -> Column:
    """In the listed order, each over the result of those before it."""
    for short, long in CONTRACTIONS:
        x = F.regexp_replace(x, rf"\b{short}\b", long)
    return x


def clean_address(x: Column) -> Column:
    plain = F.replace(F.lower(fold_accents(F.coalesce(x, F.lit("")))), F.lit("&"), F.lit(" and "))
    return squeeze(F.regexp_replace(expand_contractions(plain), r"[^a-z0-9\s]", " "))


def domain_stem(x: Column) -> Column:
    """Brand label of the first URL-like token, or an empty string."""
    url = F.regexp_extract(F.trim(F.coalesce(x, F.lit(""))), URL, 1)
    host = F.split_part(F.split_part(F.regexp_replace(url, r"(?i)^(?:https?://)?(?:www\d*\.)?", ""), F.lit("/"), F.lit(1)), F.lit("?"), F.lit(1))
    label = F.element_at(F.split(F.regexp_replace(host, rf"(?i)\.(?:{TLD})$", ""), r"\."), -1)
    return F.btrim(F.regexp_replace(F.lower(label), "[^a-z0-9-]", ""), F.lit("-"))


def is_missing(x: Column) -> Column:
    bare = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    return F.when((bare == "") | (bare == "nan"), 1).otherwise(0)


def has_non_ascii(x: Column) -> Column:
    return F.octet_length(F.coalesce(x, F.lit(""))) != F.char_length(F.coalesce(x, F.lit("")))


def _all(x: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(pattern), F.lit(group))


def numeric_tokens(x: Column) -> Column:
    return F.array_distinct(_all(x, r"\b[0-9]+\b"))


def pin_tokens(x: Column) -> Column:
    return F.array_distinct(_all(x, r"\b[0-9]{5,6}\b"))


def premise_tokens(x: Column) -> Column:
    """House, plot and flat numbers of an address."""

    def valued(found: Column, digits: bool) -> Column:
        tidy = F.transform(found, lambda v: F.btrim(F.lower(v), F.lit(".-#/ ")))
        return F.filter(tidy, lambda v: v.rlike("[0-9]") if digits else v != "")

    def with_runs(found: Column) -> Column:
        return F.concat(found, F.flatten(F.transform(found, lambda v: F.regexp_extract_all(v, F.lit("[0-9]+"), F.lit(0)))))

    lead = F.transform(_all(x, LEADING, 1), F.lower)
    bare = F.transform(lead, lambda v: F.coalesce(F.nullif(F.ltrim(v, F.lit("0")), F.lit("")), F.lit("0")))
    parts = [with_runs(valued(_all(x, PREMISE, 1), True)), with_runs(valued(_all(x, NUMBERED, 1), False)), lead, bare, with_runs(valued(_all(x, COMPOUND, 1), False))]
    return F.array_distinct(F.concat(*parts))


def pin_premise_tokens(x: Column) -> Column:
    return F.array_union(pin_tokens(x), premise_tokens(x))


def house_tokens(x: Column) -> Column:
    return F.array_distinct(_all(x, r"\b[0-9]+(?:[/-][0-9]+)?\b"))


def state_token(x: Column) -> Column:
    known = F.filter(_all(F.upper(x), r"\b[A-Za-z]{2}\b"), lambda t: t.isin(STATES))
    return F.coalesce(F.try_element_at(known, F.lit(1)), F.lit(""))


def primary_number(x: Column) -> Column:
    return F.regexp_extract(F.coalesce(x, F.lit("")), PRIMARY, 1).try_cast("decimal(38,0)")


def pincode(x: Column) -> Column:
    bare = F.coalesce(x, F.lit(""))
    six, five = F.regexp_extract(bare, r"\b([0-9]{6})\b", 1), F.regexp_extract(bare, r"\b([0-9]{5})(?:-[0-9]{4})?\b", 1)
    return F.coalesce(F.nullif(six, F.lit("")), F.nullif(five, F.lit("")))


def words(x: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.coalesce(x, F.lit("")), " ")), lambda w: w != "")


def name_tokens(x: Column) -> Column:
    """Of a raw name: words of more than two letters that are neither stop words nor legal forms."""
    return F.filter(words(clean_name(x)), lambda w: (F.length(w) > 2) & ~w.isin(STOP_FORMS))


def preprocess(df, name: str = "business_name", address: str = "business_address"):
    """df with raw_name, clean_name, clean_addr, domain_stem, clean_joint, is_addr_missing, has_non_ascii; a missing column is blank."""
    raw_name = F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")
    raw_addr = F.coalesce(F.col(address), F.lit("")) if address in df.columns else F.lit("")
    out = df.withColumns({"raw_name": raw_name, "clean_name": clean_name(raw_name), "clean_addr": F.when(is_missing(raw_addr) == 1, "").otherwise(clean_address(raw_addr))})
    return out.withColumns(
        {
            "domain_stem": F.coalesce(F.nullif(domain_stem(raw_name), F.lit("")), domain_stem(raw_addr)),
            "clean_joint": squeeze(F.concat_ws(" ", "clean_name", "clean_name", "clean_addr")),
            "is_addr_missing": is_missing(raw_addr),
            "has_non_ascii": has_non_ascii(raw_name),
        }
    )


def normalize_records(df, name: str = "business_name", address: str = "business_address", joint: bool = True):
    """preprocess() with its results under the names norm_business_name, norm_business_address and norm_joint as well."""
    out = preprocess(df, name, address).withColumns({"norm_business_name": F.col("clean_name"), "norm_business_address": F.col("clean_addr")})
    return out.withColumn("norm_joint", F.col("clean_joint")) if joint else out


def conflict(a: Column, b: Column) -> Column:
    """Both token sets known, none shared."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)
