"""Walks that go on where they stopped, snapshots, and refreshes that are worth an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .inventory import resume_anchor
from .latest import latest_per_key


def replies_progress(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """(channel_id, thread_ts, cursor, done): of the run that each channel goes on with, where each thread's walk stopped.

    ``pages`` (channel_id, run_id, thread_ts, page, id, cursor, final): pages of replies; one without a thread counts
    for nothing, an absent cursor is empty.
    """
    own = pages.filter("thread_ts is not null").join(resume_anchor(runs), ["channel_id", "run_id"], "left_semi")
    last = latest_per_key(own, ["channel_id", "thread_ts"], [F.desc("page"), F.desc("id")])
    return last.select("channel_id", "thread_ts", F.coalesce("cursor", F.lit("")).alias("cursor"), F.coalesce("final", F.lit(False)).alias("done"))


def thread_worklist(plan: DataFrame, discovered: DataFrame) -> DataFrame:
    """(channel_id, thread_ts, cursor, reply_count, latest_reply): threads still to walk.

    ``plan`` (channel_id, thread_ts, cursor, done, reply_count, latest_reply); ``discovered`` (channel_id, thread_ts,
    reply_count, latest_reply). What is done stays out even if it is found again; what was not begun takes the fresh
    numbers; what was begun keeps its own; what is new begins.
    """
    fresh = discovered.select("channel_id", "thread_ts", F.struct("reply_count", "latest_reply").alias("fresh"))
    j = plan.withColumn("own", F.struct("reply_count", "latest_reply")).select("channel_id", "thread_ts", "cursor", "done", "own").join(fresh, ["channel_id", "thread_ts"], "full_outer")
    takes_fresh = F.col("own").isNull() | ((F.col("cursor") == "") & F.col("fresh").isNotNull())
    chosen = j.filter(~F.coalesce("done", F.lit(False))).withColumn("m", F.when(takes_fresh, F.col("fresh")).otherwise(F.col("own")))
    return chosen.select("channel_id", "thread_ts", F.coalesce("cursor", F.lit("")).alias("cursor"), "m.reply_count", "m.latest_reply")


def in_progress_of_boot(runs: DataFrame, state: DataFrame) -> DataFrame:
    """(channel_id, run_id, boot_id): channels whose latest run has no end, with the process that started it."""
    started = runs.filter("kind = 'started'").select("channel_id", "run_id", "boot_id")
    return state.filter("outcome is null").select("channel_id", "run_id").join(started, ["channel_id", "run_id"])


def snapshot_costs(log: DataFrame, lines: DataFrame, line: Column, snapshots: DataFrame) -> DataFrame:
    """(stream, at_offset, n_lines, payload_bytes, events_covered) of the snapshot that each stream would get at its head;
    none where the latest covers it already.

    ``lines`` are the snapshot's rows, ``line`` the JSON of one. The bytes of the whole are summed up line by line, with
    commas and brackets: no stream's snapshot is ever put together in one row.
    """
    heads = log.groupBy("stream").agg(F.max("off").alias("at_offset"))
    last = snapshots.groupBy("stream").agg(F.max("at_off").alias("_before"))
    sizes = lines.groupBy("stream").agg(F.count("*").alias("_n"), F.sum(F.octet_length(line)).alias("_bytes"))
    n = F.coalesce("_n", F.lit(0))
    before = F.coalesce("_before", F.lit(0))
    j = heads.join(last, "stream", "left").join(sizes, "stream", "left").filter(F.col("at_offset") > before)
    return j.select("stream", "at_offset", n.cast("bigint").alias("n_lines"), (2 + F.coalesce("_bytes", F.lit(0)) + F.greatest(n - 1, F.lit(0))).cast("bigint").alias("payload_bytes"), (F.col("at_offset") - before).alias("events_covered"))


def refreshes_to_write(fresh: DataFrame, log: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of ``fresh`` (channel_id and ``columns``) that differ in any column from the channel's latest full row, or
    whose channel has none. Nulls equal nulls."""
    known = latest_per_key(log.filter("kind in ('channel_added', 'channel_info_refreshed') and channel_id is not null"), ["channel_id"], [F.desc("off")]).select("channel_id", F.struct(*columns).alias("_known"))
    j = fresh.join(known, "channel_id", "left")
    return j.filter(F.col("_known").isNull() | ~F.struct(*columns).eqNullSafe(F.col("_known"))).select("channel_id", *columns)
