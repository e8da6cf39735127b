"""Streams: the log as it arrives is kept by batch, and state is folded from it or held by Spark between batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_log(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Writes each micro-batch as a folder of its own, so that a batch that runs again replaces itself: rows and progress
    advance together. A failing batch stops the query and is replayed; nothing is passed over."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")).start()


def state_of(spark: SparkSession, path: str, fold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Current state: the fold of all that has arrived, in whatever order it came."""
    return fold(spark.read.parquet(path).drop("batch"))


def cursors(log: DataFrame) -> DataFrame:
    """(stream, applied): the offset up to which nothing is missing; what came beyond a hole does not count.

    An offset is the cursor if all up to it are there: the least whose next one is missing. One join on (stream, offset),
    so that no stream is one task.
    """
    have = log.select("stream", "off").filter("off > 0").distinct()
    have = have.unionByName(log.select("stream", F.lit(0).cast("long").alias("off")).distinct())
    ends = have.join(have.select("stream", (F.col("off") - 1).alias("off")), ["stream", "off"], "left_anti")
    return ends.groupBy("stream").agg(F.min("off").alias("applied"))


def latest_in_stream(stream: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """The latest row of each key, held in Spark's state; no watermark, as late rows count whenever they come."""
    return stream.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("latest"), F.max(order).alias(order)).select(*keys, order, "latest.*")


def first_in_stream(stream: DataFrame, keys: list[str]) -> DataFrame:
    """First row of each whole key; rows with a null in the key all pass, as they equal none."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return stream.filter(whole).dropDuplicates(keys).unionByName(stream.filter(~whole))


def keep_changes(state: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what each micro-batch changed of a state, in update mode, as a folder of its own: no batch writes the whole
    state again, and one that runs again replaces itself. The latest row of a key is its state."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
