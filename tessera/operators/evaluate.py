"""Precision-weighted evaluation and threshold search, each as one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entity_scores(tp: Column, n_pred: Column, n_true: Column, lenient: bool = True) -> dict[str, Column]:
    """f05, precision and recall of an entity; lenient: an entity without truth has recall 1 even with predictions."""
    p, r = tp / F.when(n_pred > 0, n_pred), tp / F.when(n_true > 0, n_true)
    none, wrong = (n_pred == 0) & (n_true == 0), (n_true == 0) & (n_pred > 0)
    low = 0.25 * p + r
    f = F.when(none, 1.0).when(wrong | (n_pred == 0) | (low == 0), 0.0).otherwise(1.25 * p * r / low)
    return {"f05": f, "precision": F.when(none, 1.0).when(n_pred == 0, 0.0).when(n_true == 0, 0.0).otherwise(p), "recall": F.when(none, 1.0).when(wrong, 1.0 if lenient else 0.0).otherwise(F.coalesce(r, F.lit(0.0)))}


def per_entity(predicted: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    both = predicted.select("s1_id", "target_id").distinct().withColumn("p", F.lit(1)).join(truth.select("s1_id", "target_id").distinct().withColumn("t", F.lit(1)), ["s1_id", "target_id"], "full")
    counts = both.groupBy("s1_id").agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count("p").alias("n_pred"), F.count("t").alias("n_true"))
    return entities.select("s1_id").join(counts, "s1_id", "left").na.fill(0)


def macro(predicted: DataFrame, truth: DataFrame, entities: DataFrame, lenient: bool = True) -> DataFrame:
    """One row: macro f05, precision, recall over all entities."""
    scored = entity_scores(F.col("tp"), F.col("n_pred"), F.col("n_true"), lenient)
    return per_entity(predicted, truth, entities).agg(*[F.round(F.avg(c), 6).alias(f"macro_{k}") for k, c in scored.items()])


def grid(scored: DataFrame, truth: DataFrame, entities: DataFrame, links: list[float], singletons: list[float], margins: list[float] = (0.0,), caps: list[int] = (1 << 30,), lenient: bool = True, missing_quota: int | None = None) -> DataFrame:
    """(singleton, link, margin, cap, macro_f05) of every combination; with a quota, scored has is_missing.

    Candidates of an entity are one array in order of probability, so each combination is array work on one row per
    entity, and no pair is multiplied.  The table of combinations is as large as the lists make it.
    """
    params = scored.sparkSession.range(1).select(F.lit(0).alias("visit"))
    for name, values, kind in (("singleton", singletons, "double"), ("link", links, "double"), ("margin", margins, "double"), ("cap", caps, "int")):
        each = params.select("*", F.posexplode(F.array(*[F.lit(v).cast(kind) for v in values])).alias("_at", name))
        params = each.withColumn("visit", F.col("visit") * len(values) + F.col("_at")).drop("_at")
    marked = scored.join(truth.select("s1_id", "target_id", F.lit(1).alias("t")), ["s1_id", "target_id"], "left")
    order = F.array_sort(F.collect_list(F.struct((-F.col("prob")).alias("n"), "rank", F.coalesce("t", F.lit(0)).alias("t"), (F.col("is_missing") if missing_quota is not None else F.lit(0)).alias("m"))))
    lists = marked.groupBy("s1_id").agg(order.alias("c"))
    n_true = truth.groupBy("s1_id").agg(F.count("*").alias("n_true"))
    base = entities.select("s1_id").join(lists, "s1_id", "left").join(n_true, "s1_id", "left").withColumn("n_true", F.coalesce("n_true", F.lit(0)))
    each = base.crossJoin(F.broadcast(params))
    best = -F.try_element_at("c", F.lit(1))["n"]
    fit = F.filter("c", lambda x: (-x["n"] >= F.col("link")) & (-x["n"] >= F.col("margin") * best))
    if missing_quota is not None:
        earlier = lambda i: F.size(F.filter(F.slice("f", F.lit(1), i + 1), lambda y: y["m"] == 1))
        fit = F.filter("f", lambda x, i: (x["m"] == 0) | (earlier(i) <= missing_quota))
        each = each.withColumn("f", F.filter("c", lambda x: (-x["n"] >= F.col("link")) & (-x["n"] >= F.col("margin") * best)))
    some = F.when(F.coalesce(best >= F.col("singleton"), F.lit(False)), F.slice(fit, F.lit(1), F.col("cap")))
    held = each.withColumn("k", some).select("visit", "singleton", "link", "margin", "cap", "n_true", F.coalesce(F.size("k"), F.lit(0)).alias("size"), F.size(F.filter("k", lambda x: x["t"] == 1)).alias("hit"))
    n_pred = F.greatest(F.col("size"), F.lit(0))
    f = entity_scores(F.greatest(F.col("hit"), F.lit(0)), n_pred, F.col("n_true"), lenient)["f05"]
    return held.groupBy("visit", "singleton", "link", "margin", "cap").agg(F.round(F.avg(f), 6).alias("macro_f05"))


def best(found: DataFrame, k: int = 3) -> DataFrame:
    return found.orderBy(F.desc("macro_f05"), "visit").limit(k)


def match_band(predicted: DataFrame, entities: DataFrame, low: float = 2.0, high: float = 4.5) -> DataFrame:
    """One row: matches per entity, and whether that lies in the band (low: recall may suffer, high: precision)."""
    n = predicted.agg(F.count("*").alias("n")).crossJoin(entities.agg(F.count("*").alias("entities")))
    average = F.when(F.col("entities") > 0, F.col("n") / F.col("entities")).otherwise(0.0)
    return n.select(F.round(average, 6).alias("avg_matches"), F.when(average > high, "high").when(average < low, "low").otherwise("ok").alias("band"))


def histogram(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("n"), *[F.count_if(F.col("prob") > x).alias(f"over_{int(100 * x)}") for x in (0.9, 0.7, 0.5)], F.count_if(F.col("prob") < 0.3).alias("under_30"))
