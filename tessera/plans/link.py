"""End to end: from record files to candidates, a model, matches and their checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import decide, evaluate, features, model, retrieval, sampling, validate
from tessera.sources import linkage
from tessera.sources.scratch import Scratch

#: Grid over which training picks its thresholds (fixed values), links within singletons.
SINGLETONS, LINKS = [0.20, 0.25, 0.30, 0.35, 0.40], [0.65, 0.67, 0.69, 0.71, 0.73, 0.75, 0.77, 0.79, 0.81, 0.83, 0.85]


@dataclass
class Sources:
    """Records of the reference and of the targets, written once with their preprocessed columns."""

    s1: DataFrame
    targets: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, s1: str, s2: str, s3: str, scratch: Scratch, country: str | None = None, limit: int | None = None) -> Sources:
        """From three files; country: only records of that one (in any case), limit: so many reference records of each country."""
        first = linkage.read_records(spark, s1)
        rest = linkage.union_targets(linkage.read_records(spark, s2), linkage.read_records(spark, s3))
        if country is not None:
            if first.where(F.lower("country") == country.lower()).isEmpty():
                raise ValueError(f"no reference record has the country {country!r}")
            first, rest = (x.where(F.lower("country") == country.lower()) for x in (first, rest))
        if limit is not None:
            first = sampling.stratified(first, "country", "entity_id", limit, seed=None)
        return cls(scratch.save(T.preprocess(first), "s1"), scratch.save(T.preprocess(rest), "targets"))

    def terms(self) -> tuple[DataFrame, DataFrame]:
        x = [F.col("country"), F.col("entity_id").alias("id"), F.col("clean_joint").alias("x")]
        return self.s1.select(*x), self.targets.select(*x)

    def ids(self) -> DataFrame:
        return self.s1.select(F.col("entity_id").alias("s1_id"))

    def candidates(self, top_k: int = 20, least: float = 0.10) -> DataFrame:
        return retrieval.candidates(*self.terms(), fine=top_k, least=least)


def train_on(pairs: DataFrame, truth: DataFrame, preset: str | dict = "catboost") -> tuple[PipelineModel, dict]:
    """(model, thresholds) from pairs with features: fitted on four fifths of the entities, thresholds that serve the others best."""
    marked = model.split(model.label(pairs, truth))
    fitted = model.train(marked, features.V16, **(model.PRESETS[preset] if isinstance(preset, str) else preset))
    held = model.score(fitted, marked.where("validation")).select("s1_id", "target_id", "rank", "prob")
    ids = held.select("s1_id").distinct()
    found = evaluate.best(evaluate.grid(held, truth.join(ids, "s1_id", "left_semi"), ids, LINKS, SINGLETONS), 1).first()
    return fitted, {"link": found.link, "singleton": found.singleton} if found else {"link": 0.75, "singleton": 0.30}


def link(
    spark: SparkSession, s1: str, s2: str, s3: str, matches: str, candidates: str, model_path: str, truth: str | None = None, sample: str | None = None, preset: str | dict = "catboost", top_k: int = 20,
    least: float = 0.10, country: str | None = None, limit: int | None = None, force: bool = False, buckets: int = 16,
) -> tuple[validate.Result, DataFrame | None]:
    """Reads three record files, writes the candidate and the matching file, checks both; with truth also one row of macro scores.

    The model is that of model_path; without one (or with `force`) it is trained on the folder of `sample`.  A run that was
    stopped goes on with the buckets of entities that are left.
    """
    scratch = Scratch(spark, "link")
    fitted, thresholds = model.train_or_load(spark, model_path, features.V16, lambda: _train_on_folder(spark, sample, preset, scratch), force)
    sources = Sources.read(spark, s1, s2, s3, scratch, country, limit)
    cands = scratch.save(sources.candidates(top_k, least), "candidates")
    linkage.write_lists(linkage.to_lists(cands, sources.ids()), candidates, linkage.CANDIDATES)

    def decided(ids: DataFrame) -> DataFrame:
        pairs = features.pair_features(cands.join(ids, "s1_id", "left_semi"), sources.s1, sources.targets, "v16")
        return decide.decide(model.score(fitted, pairs), ids, order="rank", **thresholds).withColumnRenamed("matches", "ids")

    linkage.run_in_buckets(sources.ids(), decided, matches, linkage.MATCHES, buckets)
    checked = validate.check(spark, matches, sources.ids().withColumnRenamed("s1_id", "id"), candidates, sources.targets.select(F.col("entity_id").alias("id")))
    if truth is None:
        return checked, None
    known = linkage.edges(linkage.read_lists(spark, truth, linkage.MATCHES)).join(sources.ids(), "s1_id", "left_semi")
    return checked, evaluate.macro(linkage.edges(linkage.read_lists(spark, matches, linkage.MATCHES)), known, sources.ids())


def _train_on_folder(spark: SparkSession, folder: str | None, preset: str | dict, scratch: Scratch) -> tuple[PipelineModel, dict]:
    if folder is None:
        raise ValueError("there is no model yet, and no sample to train one on")
    sources = Sources.read(spark, *(f"{folder}/sample_source{i}.tsv" for i in (1, 2, 3)), scratch)
    cands = linkage.candidates_or(spark, sources.candidates, f"{folder}/sample_candidate_pairs.tsv")
    pairs = scratch.save(features.pair_features(cands.join(sources.ids(), "s1_id", "left_semi"), sources.s1, sources.targets, "v16"), "pairs")
    return train_on(pairs, linkage.edges(linkage.read_lists(spark, f"{folder}/sample_ground_truth.tsv", linkage.MATCHES)), preset)


def sample(spark: SparkSession, s1: str, s2: str, s3: str, truth: str, folder: str, per_country: dict[str, int], distractors: int = 50_000, seed: int = 42) -> dict[str, int]:
    """A training sample: reference records by country, all their matches, mined negatives; returns the counts.

    Negatives are mined from the matches of the sample and `distractors` other records of each target file; only matches and
    mined records are written.
    """
    scratch = Scratch(spark, "sample")
    first = linkage.read_records(spark, s1)
    sizes = spark.createDataFrame(list(per_country.items()), "country string, most int")
    place = sampling.numbered(first, "country", "entity_id", seed)
    drawn = scratch.save(place.join(F.broadcast(sizes), "country").where("place <= most").select(*first.columns), "s1")
    ids = drawn.select(F.col("entity_id").alias("s1_id"))
    lists = scratch.save(linkage.read_lists(spark, truth, linkage.MATCHES).join(ids, "s1_id", "left_semi"), "truth")
    true = linkage.edges(lists).select("s1_id", "target_id")
    wanted = true.select(F.col("target_id").alias("entity_id")).distinct()
    pools = [scratch.save(sampling.with_distractors(linkage.read_records(spark, at), wanted, distractors, seed=seed), "pool") for at in (s2, s3)]
    sources = Sources(scratch.save(T.preprocess(drawn), "prepared"), scratch.save(T.preprocess(linkage.union_targets(*pools)), "targets"))
    scored = scratch.save(retrieval.rescored(*sources.terms()), "scored")
    mined = retrieval.hard_negatives(scored, true, ids).join(scored, ["s1_id", "target_id"])
    hit = scored.join(true, ["s1_id", "target_id"], "left_semi").where("score >= 0.10")
    pairs = scratch.save(retrieval.top(mined.select("s1_id", "target_id", "score").unionByName(hit.select("s1_id", "target_id", "score")), 20), "pairs")
    used = pairs.select(F.col("target_id").alias("entity_id")).union(wanted).distinct()
    s2_rows, s3_rows = (p.join(used, "entity_id", "left_semi") for p in pools)
    return linkage.write_sample(folder, drawn, s2_rows, s3_rows, lists, pairs)
