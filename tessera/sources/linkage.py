"""Tab-separated sources and sinks of records, truth, candidates and matches; resuming; samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import hadoop, replace

RECORD = "entity_id string, business_name string, business_address string, country string"
MATCHES, CANDIDATES = "matched_entity_ids", "candidate_entity_ids"


def read_records(spark: SparkSession, path: str, blank_as_null: bool = False) -> DataFrame:
    df = spark.read.schema(RECORD).csv(path, sep="\t", header=True, quote='"', escape='"')
    return df if blank_as_null else df.na.fill("")


def union_targets(s2: DataFrame, s3: DataFrame) -> DataFrame:
    return s2.unionByName(s3)


def id_list(x: Column) -> Column:
    """Ids of a comma list: trimmed, without blanks, once each, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda v: F.trim(v)), lambda v: v != ""))


def read_lists(spark: SparkSession, path: str, ids: str) -> DataFrame:
    """(s1_id, ids) of a truth, candidate or match file."""
    return spark.read.schema(f"source1_entity_id string, {ids} string").csv(path, sep="\t", header=True, quote='"', escape='"').select(F.col("source1_entity_id").alias("s1_id"), id_list(F.col(ids)).alias("ids"))


def read_lines(spark: SparkSession, path: str, header: str) -> DataFrame:
    """(value, s1_id, rest, ids) of all raw lines but headers, parted at the first tab only; rest is null without a tab."""
    lines = spark.read.text(path).where(F.regexp_replace("value", r"\r$", "") != header)
    at = F.instr("value", "\t")
    rest = F.when(at > 0, F.expr("substring(value, instr(value, '\t') + 1)"))
    ids = F.filter(F.transform(F.split(F.coalesce(rest, F.lit("")), ","), lambda v: F.trim(v)), lambda v: v != "")
    return lines.select("value", F.trim(F.when(at > 0, F.expr("left(value, instr(value, '\t') - 1)")).otherwise(F.col("value"))).alias("s1_id"), rest.alias("rest"), ids.alias("ids"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id) of the first column of a tab-separated file; its header and blank lines are left out."""
    first = spark.read.csv(path, sep="\t", header=True, quote="")
    return first.select(F.trim(F.col(f"`{first.columns[0]}`")).alias("id")).where("id <> ''")


def edges(lists: DataFrame, most: int | None = None) -> DataFrame:
    """(s1_id, target_id, rank) from lists; most: only the first ids."""
    ids = F.slice("ids", 1, most) if most else F.col("ids")
    return lists.select("s1_id", F.posexplode(ids).alias("pos", "target_id")).select("s1_id", "target_id", (F.col("pos") + 1).alias("rank"))


def by_source(truth: DataFrame) -> DataFrame:
    """(s1_id, s2_ids, s3_ids, singleton) of truth (s1_id, ids): its ids by the source that their prefix names."""
    of = lambda prefix: F.filter("ids", lambda v: v.startswith(prefix))
    return truth.select("s1_id", of("S2-").alias("s2_ids"), of("S3-").alias("s3_ids"), (F.size("ids") == 0).alias("singleton"))


def to_lists(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """(s1_id, ids) as a comma list by rank, a row per entity."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "target_id"))), lambda x: x["target_id"]), ",")
    return entities.select("s1_id").join(pairs.groupBy("s1_id").agg(joined.alias("ids")), "s1_id", "left").na.fill("")


def write_lists(lists: DataFrame, path: str, ids: str) -> None:
    """Parts with a header each, written beside the old output and put in its place once all are there."""
    lists.select(F.col("s1_id").alias("source1_entity_id"), F.col("ids").alias(ids)).write.mode("overwrite").option("emptyValue", "").csv(f"{path}.tmp", sep="\t", header=True, quote="")
    replace(lists.sparkSession, f"{path}.tmp", path)


def unfinished(entities: DataFrame, done: DataFrame) -> DataFrame:
    """Entities that a resumed run still has to score."""
    return entities.join(done.select("s1_id"), "s1_id", "left_anti")


def run_in_buckets(entities: DataFrame, decide: Callable[[DataFrame], DataFrame], path: str, ids: str, buckets: int = 16) -> int:
    """Matches of all entities by decide(entities) -> (s1_id, ids), bucket by bucket; returns the buckets that were done anew.

    Each bucket (by a hash of the id) is a folder of its own under {path}.parts, whole or not there, so a run that was
    stopped goes on where it left off.  A finished bucket is read and its rows are counted; if the count is wrong it
    is done again.  The output is replaced only if every entity has one row in all buckets together.
    """
    spark, anew = entities.sparkSession, 0
    marked = entities.select("s1_id").withColumn("_bucket", F.pmod(F.xxhash64("s1_id"), F.lit(buckets)))
    sizes = {r[0]: r[1] for r in marked.groupBy("_bucket").count().collect()}
    kind = f"s1_id string, {ids} string"
    parts = [f"{path}.parts/{b:05d}" for b in range(buckets)]
    for b, at in enumerate(parts):
        folder, system = hadoop(spark, at)
        mark, _ = hadoop(spark, f"{at}/_SUCCESS")
        if system.exists(mark) and spark.read.schema(kind).parquet(at).count() == sizes.get(b, 0):
            continue
        mine = marked.where(F.col("_bucket") == b).drop("_bucket")
        decide(mine).select("s1_id", F.col("ids").alias(ids)).write.mode("overwrite").parquet(at)
        anew += 1
    whole = spark.read.schema(kind).parquet(*parts).select("s1_id", F.col(ids).alias("ids"))
    rows, distinct = whole.agg(F.count("*"), F.count_distinct("s1_id")).first()
    if rows != sum(sizes.values()) or distinct != rows or not unfinished(entities, whole).isEmpty():
        raise ValueError(f"{rows} rows for {sum(sizes.values())} entities; {path} stays as it is")
    write_lists(whole, path, ids)
    folder, system = hadoop(spark, f"{path}.parts")
    system.delete(folder, True)
    return anew


def first_existing(spark: SparkSession, *paths: str | None) -> str | None:
    """The first of the paths that is there."""
    for p in paths:
        if p:
            at, system = hadoop(spark, p)
            if system.exists(at):
                return p
    return None


def candidates_or(spark: SparkSession, make: Callable[[], DataFrame], *paths: str | None) -> DataFrame:
    """(s1_id, target_id, rank) from the first candidate file that is there, else from make()."""
    found = first_existing(spark, *paths)
    return edges(read_lists(spark, found, CANDIDATES)) if found else make()


def write_sample(folder: str, s1: DataFrame, s2: DataFrame, s3: DataFrame, truth: DataFrame, pairs: DataFrame) -> dict[str, int]:
    """The five tables of a sample; returns their counts.  truth (s1_id, ids as a list), pairs (s1_id, target_id, rank)."""
    names = {"sample_source1": s1, "sample_source2": s2, "sample_source3": s3}
    for name, df in names.items():
        at = f"{folder}/{name}.tsv"
        df.select(*[c.split()[0] for c in RECORD.split(", ")]).write.mode("overwrite").option("emptyValue", "").csv(f"{at}.tmp", sep="\t", header=True, quote='"', escape='"')
        replace(df.sparkSession, f"{at}.tmp", at)
    e = s1.select(F.col("entity_id").alias("s1_id"))
    known = e.join(truth, "s1_id", "left").select("s1_id", F.coalesce(F.array_join("ids", ","), F.lit("")).alias("ids"))
    write_lists(known, f"{folder}/sample_ground_truth.tsv", MATCHES)
    write_lists(to_lists(pairs, e), f"{folder}/sample_candidate_pairs.tsv", CANDIDATES)
    n = lambda df: df.count()
    return {"s1": n(s1), "s2": n(s2), "s3": n(s3), "truth": n(known), "singletons": n(known.where("ids = ''")), "candidate_pairs": n(pairs)}
