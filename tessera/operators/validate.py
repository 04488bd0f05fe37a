"""Checks of a submission's files, lines and lists."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import linkage
from tessera.sources.scratch import hadoop

EXAMPLES = 5
MATCHING_HEADER, CANDIDATE_HEADER = "source1_entity_id\tmatched_entity_ids", "source1_entity_id\tcandidate_entity_ids"


def errors(lists: DataFrame, required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(rule, s1_id, n) of each breach in lists (s1_id, ids: array<string>); required and known have an id column.

    All rules but that on unknown ids come from one row per entity.
    """
    rules = {
        "duplicate_id": F.size("ids") != F.size(F.array_distinct("ids")),
        "self_match": F.exists("ids", lambda x: x.startswith("S1-")),
        "bad_prefix": F.exists("ids", lambda x: ~x.rlike("^S[123]-")),
    }
    per = lists.groupBy("s1_id").agg(F.count("*").alias("rows"), *[F.count_if(x).alias(k) for k, x in rules.items()])
    both = per.join(required.select(F.col("id").alias("s1_id"), F.lit(True).alias("asked")).distinct(), "s1_id", "full")
    times = {
        "duplicate_row": (F.col("rows") > 1).cast("long"), **{k: F.col(k) for k in rules},
        "missing_row": F.col("rows").isNull().cast("long"), "extra_row": F.col("asked").isNull().cast("long"),
    }
    each = F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(n, F.lit(0)).alias("n")) for k, n in times.items()])
    out = both.select("s1_id", F.explode(F.filter(each, lambda x: x["n"] > 0)).alias("x")).select("x.rule", "s1_id", "x.n")
    if known is not None:
        flat = lists.select("s1_id", F.explode("ids").alias("id"))
        unknown = flat.join(known.select("id"), "id", "left_anti").select("s1_id").distinct()
        out = out.unionByName(unknown.select(F.lit("unknown_id").alias("rule"), "s1_id", F.lit(1).cast("long").alias("n")))
    return out


def report(found: DataFrame) -> DataFrame:
    """(rule, n, examples): the number of breaches and the first few of them."""
    return found.groupBy("rule").agg(F.sum("n").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("s1_id")), 1, EXAMPLES), ",").alias("examples"))


def counts(lists: DataFrame) -> DataFrame:
    """One row: the lists, the empty ones and the others."""
    return lists.agg(F.count("*").alias("rows"), F.count_if(F.size("ids") == 0).alias("empty"), F.count_if(F.size("ids") > 0).alias("filled"))


def outside_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """A warning only: matches that are no candidates."""
    return matches.join(candidates, ["s1_id", "target_id"], "left_anti")


def bad_lines(lines: DataFrame) -> DataFrame:
    """Lines (value) that are not blank and hold no tab."""
    return lines.where((F.trim("value") != "") & (F.instr("value", "\t") == 0))


def bad_file(spark: SparkSession, path: str, header: str) -> str | None:
    """Why a file cannot be checked at all: it is missing or empty, or its header is not the one expected."""
    at, system = hadoop(spark, path)
    if not system.exists(at):
        return f"{path} is missing"
    first = spark.read.text(path).first()
    if first is None:
        return f"{path} is empty"
    if "\t" not in first[0] and "," in first[0]:
        return f"{path} is parted by commas; tabs are asked for"
    if [c.strip().lower() for c in first[0].split("\t")] != header.split("\t"):
        return f"{path} has the header {first[0]!r}; {header!r} is asked for"
    return None


@dataclass
class Result:
    """What was found; errors make the exit status 1, warnings don't."""

    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    rows: dict[str, tuple[int, int]] = field(default_factory=dict)  # file: lists, empty ones

    @property
    def status(self) -> int:
        return int(bool(self.errors))


def check(spark: SparkSession, matching: str, required: DataFrame, candidates: str | None = None, known: DataFrame | None = None) -> Result:
    """All checks of a matching file and, if it is there, a candidate file.  At most EXAMPLES of each breach reach the driver."""
    out, read = Result(), {}
    for path, header in ((matching, MATCHING_HEADER), (candidates, CANDIDATE_HEADER)):
        if path is None:
            continue
        if path == candidates and linkage.first_existing(spark, path) is None:
            out.warnings.append(f"{path} is missing; its checks are left out")
            continue
        if why := bad_file(spark, path, header):
            out.errors.append(why)
            continue
        lines = linkage.read_lines(spark, path, spark.read.text(path).first()[0])
        bad = bad_lines(lines)
        if n := bad.count():
            out.errors.append(f"{path}: no_tab: {n}, such as {[r[0] for r in bad.orderBy('value').limit(EXAMPLES).select('value').collect()]}")
        lists = read[path] = lines.where("rest IS NOT NULL").select("s1_id", "ids")
        out.errors += [f"{path}: {r.rule}: {r.n}, such as {r.examples}" for r in report(errors(lists, required, known)).orderBy("rule").collect()]
        row = counts(lists).first()
        out.rows[path] = (row.rows, row.empty)
    if matching in read and candidates in read:
        pairs = lambda p: read[p].select("s1_id", F.explode("ids").alias("target_id")).distinct()
        if n := outside_candidates(pairs(matching), pairs(candidates)).select("s1_id").distinct().count():
            out.warnings.append(f"{n} entities have matches that are no candidates")
    return out
