"""Written tables in the folder that the cluster shares, and files that are replaced whole."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

__all__ = ["Scratch", "hadoop", "replace", "shared_dir"]


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def hadoop(spark: SparkSession, path: str):
    """The path and its file system, as Hadoop's objects."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a folder of this machine's own only in local mode, where that is unset (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Written tables that cut lineage: a lost executor costs a reread, never a recomputation of what came before.

    The folder goes when the session's process ends, what an operator no longer needs sooner.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._saved: list[DataFrame] = []

    def path(self, name: str) -> str:
        if not self._n:
            at, system = hadoop(self.spark, self.root)
            system.mkdirs(at)
            system.deleteOnExit(at)
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        at = self.path(name)
        # The write's own shuffle files go with it.
        old = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(at)
        finally:
            self.spark.conf.set(CLEANUP, old)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._tessera_path = at
        self._saved.append(out)
        return out

    def release(self) -> None:
        """Let go of what counts and the like have shuffled: Spark deletes that once the driver's garbage is gone."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *frames: DataFrame) -> None:
        """Delete scratch tables that no later read needs."""
        for df in frames:
            at, system = hadoop(self.spark, df._tessera_path)
            system.delete(at, True)
            self._saved = [x for x in self._saved if x is not df]

    def keep_only(self, *frames: DataFrame) -> DataFrame:
        """Delete all tables of this scratch but these; returns the first."""
        self.drop(*[x for x in self._saved if not any(x is y for y in frames)])
        self.release()
        return frames[0]


def replace(spark: SparkSession, new: str, path: str) -> None:
    """Put the written folder `new` in the place of `path`, whose old content stays beside it as .bak until the next time.

    Two renames of one file system: a reader finds the old content, for a moment none, or the new content, never parts.
    """
    to, system = hadoop(spark, path)
    old, _ = hadoop(spark, f"{path}.bak")
    fresh, _ = hadoop(spark, new)
    if not system.exists(fresh):
        raise FileNotFoundError(new)
    if system.exists(to):
        system.delete(old, True)
        if not system.rename(to, old):
            raise OSError(f"cannot move {path} aside")
    if not system.rename(fresh, to):
        system.rename(old, to)
        raise OSError(f"cannot move {new} to {path}")
