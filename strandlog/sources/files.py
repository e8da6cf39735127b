"""Files of the service: day files, snapshots as JSON lines, the decision log, documents by channel and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_json

MESSAGE = "ts string, user string, bot_id string, text string, thread_ts string, reply_count bigint, latest_reply string"


def read_day_files(spark: SparkSession, path: str) -> DataFrame:
    """(channel_id, day, message fields) of ``<channel>/<day>.json``, arrays of messages. Unreadable files are passed over.

    Files under three bytes (an empty array) are not opened.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path).filter("length > 2")
    one = raw.select(F.regexp_extract("path", r"([^/]+)/[^/]+\.json\z", 1).alias("channel_id"), F.regexp_extract("path", r"([^/]+)\.json\z", 1).alias("day"), F.from_json(F.col("content").cast("string"), f"array<struct<{MESSAGE.replace(' string', ':string').replace(' bigint', ':bigint')}>>").alias("m"))
    m = one.select("channel_id", "day", F.inline("m")).filter("ts is not null")
    author = F.coalesce(F.nullif("user", F.lit("")), F.nullif("bot_id", F.lit("")), F.lit("unknown"))
    return m.withColumn("user", author).drop("bot_id")


def write_snapshot(lines: DataFrame, path: str, stream: str = "stream", payload: str = "payload", order: str = "ts") -> None:
    """One JSON object a line, keys sorted, gzip-compressed, a folder for each stream, in parts that are ranges of ``order``.

    Rows are cut by ranges of stream and order, so that a stream that holds most of them is written by many tasks. A part is
    a gzip member: a stream's parts, joined by their numbers (``snapshot_parts``), are one gzip file of its lines in order. The
    same state gives the same lines; how they are cut follows the session's sizes.
    """
    out = lines.select(F.translate(F.col(stream), ":", "_").alias("s"), order, canonical_json(F.col(payload)).alias("value"))
    out.repartitionByRange("s", order).sortWithinPartitions("s", order).select("s", "value").write.partitionBy("s").option("compression", "gzip").text(path)


def write_shared_snapshot(lines: DataFrame, path: str, stream: str = "stream", payload: str = "payload", order: str = "ts") -> None:
    """The lines of all streams together, gzip-compressed JSON, in parts that are ranges of stream and ``order``.

    For many streams of few lines each: the number of files follows the bytes, not the streams. Payloads name their stream, and
    a stream's lines stand in order, in one part or in successive ones.
    """
    out = lines.select(stream, order, canonical_json(F.col(payload)).alias("value"))
    out.repartitionByRange(stream, order).sortWithinPartitions(stream, order).select("value").write.option("compression", "gzip").text(path)


def snapshot_parts(spark: SparkSession, path: str) -> DataFrame:
    """(stream, part, bytes, file): the parts of snapshots; in order of ``part`` they hold a stream's lines in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*.gz").load(path).select("path", "length")
    return files.select(F.url_decode(F.regexp_extract("path", r"/s=([^/]+)/", 1)).alias("stream"), F.regexp_extract("path", r"/part-(\d+)", 1).cast("int").alias("part"), F.col("length").alias("bytes"), F.col("path").alias("file"))


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines of snapshots; one that does not parse fails the whole read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_decisions(decisions: DataFrame, path: str) -> None:
    decisions.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def read_decisions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that do not parse are passed over."""
    return spark.read.text(path).select(F.from_json("value", schema).alias("d"), "value").filter(F.get_json_object("value", "$").isNotNull()).select("d.*").na.drop("all")


def write_documents(docs: DataFrame, path: str, today: str | None = None) -> None:
    """(channel_id, day, document) by channel and day, a folder and a file for each; ``today`` is left out, as it is not over.

    For a tree of files that people open; ``write_day_documents`` holds many channels."""
    past = docs if today is None else docs.filter(F.col("day") < today)
    past.select("channel_id", "day", F.col("document").alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("channel_id", "day").option("lineSep", "\n\n").text(path)


def write_day_documents(docs: DataFrame, path: str, today: str | None = None) -> None:
    """(channel_id, day, document) as a folder for each day, with the documents of all channels in parts that are ranges of
    channel; ``today`` is left out, as it is not over.

    For many channels: the number of folders is that of the days, and of files that of the ranges, not of the documents. A day's
    documents are written together; a day that is written again takes the place of the former one.
    """
    past = docs if today is None else docs.filter(F.col("day") < today)
    out = past.select("day", "channel_id", "document").repartitionByRange("day", "channel_id").sortWithinPartitions("day", "channel_id")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("day").parquet(path)


def read_day_documents(spark: SparkSession, path: str) -> DataFrame:
    """(channel_id, day, document) of such folders; a filter on the day opens its folder alone, one on the channel some parts."""
    return spark.read.schema("channel_id string, document string, day string").parquet(path).select("channel_id", "day", "document")
