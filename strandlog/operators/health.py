"""Health of the ingesting side: its log, the state that a client derives, and when a change is worth telling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .latest import as_of
from .scan import row_before, running_sum

HEALTH_STREAM = "slurper-health"
#: The state that each kind of a health event stands for; other kinds change nothing.
STATES = {"slack_healthy": "healthy", "slack_degraded": "degraded", "socket_mode_disconnected": "disconnected", "socket_mode_reconnected": "healthy", "auth_token_invalid": "auth_failed"}


def health_log(log: DataFrame) -> DataFrame:
    """The events of the health stream."""
    return log.filter(F.col("stream") == HEALTH_STREAM)


def last_health_kind(log: DataFrame) -> DataFrame:
    """(last_event_us, last_health_kind): of all events and of those of the health stream; one row, nulls without any."""
    return log.agg(F.max("us").alias("last_event_us"), F.expr(f"max_by(kind, id) FILTER (WHERE stream = '{HEALTH_STREAM}')").alias("last_health_kind"))


def _with_state(log: DataFrame) -> DataFrame:
    table = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    return health_log(log).withColumn("state", table[F.col("kind")]).filter("state is not null")


def connection_state(log: DataFrame) -> DataFrame:
    """(health, health_us): the state that the last of the known kinds stands for, and when it came; one row."""
    return _with_state(log).agg(F.max_by("state", "id").alias("health"), F.max_by("us", "id").alias("health_us"))


def signatures(log: DataFrame, caught_up: DataFrame, polls: DataFrame, stale_us: int) -> DataFrame:
    """(poll_us, health, frame_stale, n_caught_up, max_offset, changed) for each poll: what a watcher sees then, and
    whether it differs from the poll before (the first does).

    ``caught_up`` (stream, off, us): streams that have caught up, and how far. ``polls`` (poll_us) are few: what lies
    between two of them is summed up first, and only the sums run on from poll to poll. An event's poll is found by an as-of
    join backwards in time, so that no event looks at all polls.
    """
    back = polls.select(F.lit(0).alias("_one"), (-F.col("poll_us")).alias("_poll_back"), "poll_us").distinct()

    def polled(rows: DataFrame) -> DataFrame:
        return as_of(rows.select("*", F.lit(0).alias("_one"), (-F.col("us")).alias("_back")), back, "_one", "_back", "_poll_back").filter("poll_us is not null")

    states = polled(_with_state(log))
    states = states.groupBy("poll_us").agg(F.max_by("state", "us").alias("health"), F.max("us").alias("frame_us"))
    first = caught_up.groupBy("stream").agg(F.min("us").alias("us")).transform(polled).groupBy("poll_us").agg(F.count("*").alias("n"))
    far = polled(caught_up).groupBy("poll_us").agg(F.max("off").alias("off"))
    so_far = W.orderBy("poll_us").rowsBetween(W.unboundedPreceding, 0)  # a row for each poll
    one = polls.join(states, "poll_us", "left").join(first, "poll_us", "left").join(far, "poll_us", "left")
    frame = F.last("frame_us", ignorenulls=True).over(so_far)
    seen = one.select(
        "poll_us", F.last("health", ignorenulls=True).over(so_far).alias("health"), (frame.isNull() | (F.col("poll_us") - frame > stale_us)).alias("frame_stale"),
        F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("n_caught_up"), F.coalesce(F.max("off").over(so_far), F.lit(0)).alias("max_offset"),
    )
    signature = F.struct("health", "frame_stale", "n_caught_up", "max_offset")
    return seen.withColumn("changed", ~signature.eqNullSafe(F.lag(signature).over(W.orderBy("poll_us"))))


def reconnects_to_catch_up(reconnects: DataFrame, resume: DataFrame, threshold_s: int) -> DataFrame:
    """(channel_id, gap_s, from_us): reconnects after more than the threshold, with where each channel resumes."""
    return reconnects.filter(F.col("gap_s") > threshold_s).join(resume, "channel_id").select("channel_id", "gap_s", "from_us")


def silences(frames: DataFrame, after_ms: int, now_ms: int) -> DataFrame:
    """(key, ms, silent): where keys of frames (key, ms) fell silent for more than ``after_ms``, up to ``now_ms``, and where they
    spoke again. The state that a stream with timers keeps, from a whole log; hot keys are looked through in blocks."""
    seen = row_before(frames.select("key", "ms").filter("key is not null").distinct(), "key", ["ms"], ["ms"], "before")
    gaps = seen.filter(F.col("ms") > F.col("before.ms") + after_ms)
    ended = gaps.select("key", (F.col("before.ms") + after_ms).alias("ms"), F.lit(True).alias("silent")).unionByName(gaps.select("key", "ms", F.lit(False).alias("silent")))
    last = frames.filter("key is not null").groupBy("key").agg(F.max("ms").alias("ms")).filter(F.col("ms") + after_ms < now_ms)
    return ended.unionByName(last.select("key", (F.col("ms") + after_ms).alias("ms"), F.lit(True).alias("silent")))


def outages(attempts: DataFrame, min_ms: int, now_ms: int) -> DataFrame:
    """(key, began, ms): a notice ``min_ms`` after the first failure of each run of failures of attempts (key, ms, id, ok), if
    no success came until then."""
    one = attempts.filter("key is not null").withColumn("_ok", F.col("ok").cast("int"))
    counted = running_sum(one, "key", ["ms", "id"], "_ok", "run")
    runs = counted.groupBy("key", "run").agg(F.min(F.when(~F.col("ok"), F.col("ms"))).alias("began")).filter("began is not null")
    ends = counted.filter("ok").groupBy("key", (F.col("run") - 1).alias("run")).agg(F.min("ms").alias("ended"))
    j = runs.join(ends, ["key", "run"], "left")
    return j.filter(F.coalesce("ended", F.lit(now_ms)) > F.col("began") + min_ms).select("key", "began", (F.col("began") + min_ms).alias("ms"))
