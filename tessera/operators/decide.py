"""Per-entity decisions over scored candidates, and probability blending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kept(scored: DataFrame, link: float, singleton: float, margin: float = 0.0, cap: int | None = None, missing_quota: int | None = None, missing_least: float = 0.0, veto: str | None = None) -> DataFrame:
    """Rows of scored (s1_id, target_id, rank, prob[, is_missing, name_sim, veto]) that survive, with their place.

    An entity whose best probability is under `singleton` keeps nothing.  Others keep candidates of at least `link` and
    `margin` times the best.  Rows with a missing address need `missing_least` name similarity and count against a
    quota after all other filters; the cap comes last.
    """
    best = F.max("prob").over(Window.partitionBy("s1_id"))
    out = scored.withColumn("best", best).where((F.col("best") >= singleton) & (F.col("prob") >= link) & (F.col("prob") >= margin * F.col("best")))
    if veto:
        out = out.where(~F.col(veto))
    if missing_quota is not None:
        out = out.where((F.col("is_missing") == 0) | (F.col("name_sim") >= missing_least) if missing_least else F.lit(True))
        order = Window.partitionBy("s1_id", "is_missing").orderBy(F.desc("prob"), "rank")
        out = out.withColumn("_q", F.row_number().over(order)).where((F.col("is_missing") == 0) | (F.col("_q") <= missing_quota)).drop("_q")
    out = out.withColumn("place", F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("prob"), "rank")))
    return out.where(F.col("place") <= cap) if cap else out


def decide(scored: DataFrame, entities: DataFrame, order: str = "prob", **rule) -> DataFrame:
    """(s1_id, matches): one row per entity, a comma list by probability or by candidate rank, empty without matches."""
    by = "place" if order == "prob" else "rank"
    lists = kept(scored, **rule).groupBy("s1_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "target_id"))), lambda x: x["target_id"]), ",").alias("matches"))
    return entities.select("s1_id").join(lists, "s1_id", "left").select("s1_id", F.coalesce("matches", F.lit("")).alias("matches"))


#: Weights of the models that are blended by default.
BLEND = {"catboost": 0.40, "xgboost": 0.35, "lightgbm": 0.25}


def blend(columns: dict[str, float]) -> Column:
    """Weighted mean of probability columns, over the weights given."""
    return sum((F.col(c) * w for c, w in columns.items()), F.lit(0.0)) / sum(columns.values())


def blend_loaded(columns: dict[str, str], weights: dict[str, float] | None = None) -> Column:
    """Blend of the models that are there, from model to probability column: weights (an unknown model's is 1) count among these alone."""
    if not columns:
        raise ValueError("no model to blend")
    known = BLEND if weights is None else {k: w / sum(weights.values()) for k, w in weights.items()}
    return blend({column: known.get(model, 1.0) for model, column in columns.items()})
