"""Pair features: one projection over candidates joined with both sides' preprocessed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import fuzzy
from tessera.functions import text as T

# The names and order of the features.
V16 = ["name_token_sort_ratio", "name_token_set_ratio", "name_jaro_winkler", "name_levenshtein_norm", "addr_token_sort_ratio", "addr_token_set_ratio", "addr_jaro_winkler", "numeric_token_overlap",
       "postal_pin_exact_match", "numeric_pincode_match", "domain_match", "script_mismatch", "len_diff_name", "len_diff_addr", "is_addr_missing", "blocking_rank"]
V18 = [*V16[:14], "is_missing", "state_conflict", "door_conflict", "extra_words"]


def _flag(x: Column) -> Column:
    return F.when(x, 1.0).otherwise(0.0)


def numeric_jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def domain_match(d1: Column, d2: Column, n1: Column | None = None, n2: Column | None = None) -> Column:
    """Equal stems, or one side's stem equal to the other's bare name."""
    bare = lambda n: F.regexp_replace(F.lower(n), "[^a-z0-9]", "") if n is not None else F.lit("")
    a = F.when(d1 != "", d1).otherwise(bare(n1))
    b = F.when(d2 != "", d2).otherwise(bare(n2))
    return _flag(((d1 != "") | (d2 != "")) & (a != "") & (a == b))


def script_mismatch(a: Column, b: Column) -> Column:
    return _flag((a != "") & (b != "") & (T.has_non_ascii(a) != T.has_non_ascii(b)))


def len_diff(a: Column, b: Column) -> Column:
    return F.abs(F.length(a) - F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))


def state_conflict(a: Column, b: Column) -> Column:
    return _flag((a != "") & (b != "") & (a != b))


def door_conflict(a: Column, b: Column, address_sort: Column | None = None) -> Column:
    """Strict with a similarity of the addresses (0.70 or more), else tolerant: off by over one and no prefix."""
    known = a.isNotNull() & b.isNotNull() & (a != b)
    if address_sort is not None:
        return _flag(known & (address_sort >= 0.70))
    x, y = a.cast("string"), b.cast("string")
    return _flag(F.coalesce(known & (F.abs(a - b) > 1) & ~x.startswith(y) & ~y.startswith(x), F.lit(False)))


def extra_words(a: Column, b: Column, tolerant: bool = False, forms: bool = False) -> Column:
    """Words of b that a lacks; tolerant: the share of words without a counterpart if both sides have some, stop words (and, with
    `forms`, short legal forms) aside."""
    if not tolerant:
        return F.size(F.array_except(b, a)).cast("double")
    stop = F.array(*[F.lit(w) for w in (T.STOP_FORMS if forms else T.STOP)])
    x, y = (F.size(F.array_except(F.array_except(p, q), stop)) for p, q in ((a, b), (b, a)))
    return F.when((x > 0) & (y > 0), F.least(F.lit(1.0), (x + y) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))).otherwise(0.0)


def prepare(records: DataFrame, prefix: str) -> DataFrame:
    """Per-entity columns that all pairs of the entity share, computed once."""
    p = T.preprocess(records)
    numbers = F.concat_ws(" ", "clean_name", "clean_addr")
    return p.select(
        F.col("entity_id").alias(f"{prefix}id"),
        *[F.col(c).alias(f"{prefix}{c}") for c in ("raw_name", "clean_name", "clean_addr", "domain_stem", "is_addr_missing")],
        T.numeric_tokens(numbers).alias(f"{prefix}num"), T.pin_tokens(numbers).alias(f"{prefix}pin"), T.pin_premise_tokens(F.col("clean_addr")).alias(f"{prefix}codes"),
        T.state_token(F.col("business_address")).alias(f"{prefix}state"), T.primary_number(F.col("business_address")).alias(f"{prefix}door"), T.words(F.col("clean_name")).alias(f"{prefix}words"),
    )


def known_pairs(cands: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """The candidates whose records are there; the others have used up their rank."""
    return cands.join(s1.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi").join(targets.select(F.col("entity_id").alias("target_id")), "target_id", "left_semi").select(*cands.columns)


def pair_features(cands: DataFrame, s1: DataFrame, targets: DataFrame, version: str = "v16") -> DataFrame:
    """cands (s1_id, target_id, rank) with the features of version v16, v18_train, v18_tolerant or v18_batch."""
    a, b = prepare(s1, "a_"), prepare(targets, "b_")
    j = cands.join(a, F.col("s1_id") == F.col("a_id")).join(b, F.col("target_id") == F.col("b_id"))
    c = F.col
    guard = version not in ("v18_tolerant", "v18_batch")
    whole_address = version != "v18_tolerant"
    blank = (c("a_clean_addr") == "") | (c("b_clean_addr") == "")
    j = j.withColumn("n", fuzzy.similarities(c("a_clean_name"), c("b_clean_name"))).withColumn("d", fuzzy.similarities(c("a_clean_addr"), c("b_clean_addr")))
    on_address = lambda x: F.when(blank, 0.0).otherwise(x) if guard else x
    names = (c("a_clean_name"), c("b_clean_name")) if guard else (None, None)
    out = {
        "name_token_sort_ratio": c("n.sort"), "name_token_set_ratio": c("n.set"), "name_jaro_winkler": c("n.jw"), "name_levenshtein_norm": fuzzy.levenshtein_norm(c("a_clean_name"), c("b_clean_name")),
        "addr_token_sort_ratio": on_address(c("d.sort")), "addr_token_set_ratio": on_address(c("d.set")), "addr_jaro_winkler": on_address(c("d.jw")),
        "numeric_token_overlap": numeric_jaccard(c("a_num"), c("b_num")), "postal_pin_exact_match": _flag(F.arrays_overlap("a_pin", "b_pin")), "numeric_pincode_match": _flag(F.arrays_overlap("a_codes", "b_codes")),
        "domain_match": domain_match(c("a_domain_stem"), c("b_domain_stem"), *names), "script_mismatch": script_mismatch(c("a_raw_name"), c("b_raw_name")),
        "len_diff_name": len_diff(c("a_clean_name"), c("b_clean_name")), "len_diff_addr": F.when(blank, 1.0).otherwise(len_diff(c("a_clean_addr"), c("b_clean_addr"))) if whole_address else len_diff(c("a_clean_addr"), c("b_clean_addr")),
    }
    if version == "v16":
        out |= {"is_addr_missing": c("b_is_addr_missing").cast("double"), "blocking_rank": c("rank").cast("double")}
    else:
        strict = version == "v18_train"
        out |= {
            "is_missing": _flag(c("b_clean_addr") == ""), "state_conflict": state_conflict(c("a_state"), c("b_state")),
            "door_conflict": door_conflict(c("a_door"), c("b_door"), c("d.sort") if strict else None), "extra_words": extra_words(c("a_words"), c("b_words"), not strict, version == "v18_batch"),
        }
    return j.select("s1_id", "target_id", "rank", *[x.alias(k) for k, x in out.items()])
