"""Decisions over a stream of scored candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import decide

PAIR = "s1_id string, target_id string, rank int, prob double"


def decide_stream(scored: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **rule) -> StreamingQuery:
    """Applies the decision rule as scored (s1_id, target_id, rank, prob) come in.

    An entity's candidates may arrive in several batches: all that came so far are kept under the checkpoint (a folder per
    batch, written anew if the batch is tried again), and the sink gets (s1_id, matches) of each entity with new candidates, by all
    of its candidates; a later row of an entity stands in the place of an earlier one.
    """
    spark, folder = scored.sparkSession, f"{checkpoint}/candidates"

    def each(batch: DataFrame, number: int) -> None:
        batch.select("s1_id", "target_id", "rank", "prob").write.mode("overwrite").parquet(f"{folder}/batch={number}")
        known = spark.read.schema(f"{PAIR}, batch bigint").parquet(folder).where(F.col("batch") <= number).drop("batch")
        new = spark.read.schema(PAIR).parquet(f"{folder}/batch={number}").select("s1_id").distinct()
        sink(decide.decide(known.join(new, "s1_id", "left_semi"), new, **rule), number)

    return scored.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
