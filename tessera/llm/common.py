"""Scratch tables, row numbers, joins of hot keys, and the memory of Python workers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import scratch

__all__ = ["BROADCAST", "Scratch", "enter", "held", "hot_keys", "join_hot", "new_column", "numbered", "small", "table"]

#: Bytes that a broadcast table may hold, and those of a batch of rows on its way to or from Python (about, and one row at least).
BROADCAST, BATCH = 32 << 20, 4 << 20
#: A value with more than a share of 1 / HOT_KEYS of all rows (and 200 rows) is hot, so there are fewer hot ones than that.
HOT_KEYS = 20_000

_OWNER = [""]
_HELD: dict[object, object] = {}


def enter(owner: str) -> None:
    """Called first in each Python stage: what another operator left in this worker process is let go.

    Workers serve many stages in turn, so without this a vocabulary and its caches would stay beside those of the next operator.
    """
    if _OWNER[0] != owner:
        _OWNER[0] = owner
        if _HELD:
            _HELD.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)


def held(owner: str, key: object, make: Callable[[], object]):
    """What make() gave; kept in this process until another operator enters."""
    enter(owner)
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def bounded(spark: SparkSession) -> None:
    """Batches bounded by their bytes: with a bound by rows only, memory would follow the length of texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH:
        spark.conf.set(name, str(BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch(scratch.Scratch):
    """Scratch tables of a session whose batches are bounded."""

    def __init__(self, spark: SparkSession, name: str):
        bounded(spark)
        super().__init__(spark, name)


def new_column(df: DataFrame, *names: str) -> DataFrame:
    """df, if none of its columns has such a name already."""
    if taken := [n for n in names if n.lower() in {c.lower() for c in df.columns}]:
        raise ValueError(f"the table has a column {taken[0]!r} already; name the output otherwise")
    return df


def small(df: DataFrame, width: Column | int) -> DataFrame:
    """df, marked for broadcast if its rows of `width` bytes (16 more each for the table's own use) stay within BROADCAST."""
    size = df.agg(F.coalesce(F.sum(F.lit(width) if isinstance(width, int) else width), F.lit(0)) + 16 * F.count("*")).first()[0]
    return F.broadcast(df) if size <= BROADCAST else df


def numbered(rows: DataFrame, at: Scratch, pieces: int) -> DataFrame:
    """rows (key, text, ...) with doc, a row's own number, in the order of keys (nulls first, then by text).

    Whole numbers that are distinct and not null are such numbers themselves.  Otherwise the table is sorted and written once.
    """
    whole = rows.schema["key"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    if whole and rows.groupBy("key").count().where("key IS NULL OR count > 1").isEmpty():
        return rows.select(F.col("key").cast("long").alias("doc"), "*")
    # Full ties are dealt to several parts by their place in the input.
    order = ("key", "text", "tie")
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(pieces, *order).sortWithinPartitions(*order)
    # Increasing over the sorted parts; written, as another run could number the rows in another way.
    return at.save(dealt.select(F.monotonically_increasing_id().alias("doc"), *rows.columns), "numbered")


def hot_keys(per: DataFrame, on: str, rows: int, at: Scratch) -> DataFrame:
    """The values of `on` in per (on, count) that hold a large share of all rows: under HOT_KEYS of them."""
    return at.save(per.where(F.col("count") > max(200, rows // HOT_KEYS)).select(on), "hot")


def join_hot(many: DataFrame, one: DataFrame, on: str, hot: DataFrame, then: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """many with the columns of then(one), which has a row per value of `on` at most; all rows of many are kept.

    Hot values are too few to be many rows of `one`, so those are broadcast and the rows of many that have them stay where
    they are; all others are shuffled.
    """
    if hot.isEmpty():
        return many.join(then(one), on, "left")
    named = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    marked = many.join(named, on, "left")
    few = F.broadcast(then(one.join(F.broadcast(hot), on, "left_semi")))
    rest = marked.where("_hot IS NULL").drop("_hot").join(then(one.join(F.broadcast(hot), on, "left_anti")), on, "left")
    return rest.unionByName(marked.where("_hot").drop("_hot").join(few, on, "left"))
