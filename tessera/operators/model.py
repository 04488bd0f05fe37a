"""Training, scoring and promotion of pair classifiers on Spark ML."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.linkage import first_existing
from tessera.sources.scratch import replace

#: Parameter sets of the surveyed trainers, for train(**PRESETS[name]); a positive weight of None balances the classes.
PRESETS = {
    "xgboost": {"rounds": 800, "rate": 0.04, "depth": 6, "positive_weight": 0.6},
    "catboost": {"rounds": 1000, "rate": 0.04, "depth": 6, "positive_weight": 0.6},
    "conflict": {"rounds": 600, "rate": 0.06, "depth": 6, "positive_weight": 0.7},
    "retrained": {"rounds": 1000, "rate": 0.05, "depth": 7, "positive_weight": None},
}


def label(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    hit = truth.select("s1_id", "target_id", F.lit(1.0).alias("label")).distinct()
    return pairs.join(hit, ["s1_id", "target_id"], "left").na.fill({"label": 0.0})


def split(pairs: DataFrame, share: int = 20, seed: int = 42) -> DataFrame:
    """Adds `validation`: whole entities, by a hash of their id."""
    return pairs.withColumn("validation", F.pmod(F.xxhash64("s1_id", F.lit(seed)), F.lit(100)) < share)


def balance(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"))


def train(pairs: DataFrame, features: list[str], rounds: int = 40, depth: int = 6, rate: float = 0.1, negative_weight: float = 1.0, positive_weight: float | None = 1.0, seed: int = 42) -> PipelineModel:
    """Boosted trees that stop early by the log loss of the rows marked `validation`."""
    if positive_weight is None:
        n = balance(pairs).first()
        positive_weight = n.negatives / max(n.positives, 1)
    weighed = pairs.withColumn("weight", F.when(F.col("label") == 1, float(positive_weight)).otherwise(negative_weight))
    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", validationIndicatorCol="validation", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=0.85, featureSubsetStrategy="0.85", seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), trees]).fit(weighed)


def score(model: PipelineModel, pairs: DataFrame) -> DataFrame:
    return model.transform(pairs).withColumn("prob", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def importance(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])


def save(model: PipelineModel, path: str, thresholds: dict, features: list[str]) -> None:
    """Writes beside an older model of that path, then takes its place; the older one stays as .bak."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}.tmp/model")
    spark.createDataFrame([(json.dumps({"thresholds": thresholds, "features": features}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.tmp/meta")
    replace(spark, f"{path}.tmp", path)


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    """The model and what save() was told with it."""
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/meta").first()[0])


def train_or_load(spark: SparkSession, path: str, features: list[str], fit: Callable[[], tuple[PipelineModel, dict]], force: bool = False) -> tuple[PipelineModel, dict]:
    """(model, thresholds): the one saved at path if it loads and has these features, else what fit() gives, which is saved."""
    if not force and first_existing(spark, f"{path}/meta"):
        try:
            model, meta = load(spark, path)
            if meta["features"] == features:
                return model, meta["thresholds"]
        except Exception as e:  # whatever is broken there is trained anew
            print(f"{path} does not load ({type(e).__name__}); training anew")
    model, thresholds = fit()
    save(model, path, thresholds, features)
    return model, thresholds


def promote(champion: float, challenger: float) -> str:
    """Whose macro F0.5 is better; the champion stays at a tie."""
    return "challenger" if challenger > champion else "champion"


def challenge(spark: SparkSession, path: str, challenger: PipelineModel, thresholds: dict, features: list[str], measure: Callable[[PipelineModel, dict], float]) -> tuple[str, float, float]:
    """Who wins under the same thresholds, and both scores.  A winner takes the champion's path, which keeps the old one as .bak; a
    loser is saved as .challenger."""
    champion, _ = load(spark, path)
    old, new = measure(champion, thresholds), measure(challenger, thresholds)
    winner = promote(old, new)
    save(challenger, path if winner == "challenger" else f"{path}.challenger", thresholds, features)
    return winner, old, new
