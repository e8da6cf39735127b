"""Durable queue, snapshots and replay, user changes, health: what a serving log decides from its own rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import backoff_seconds, local
from .latest import latest_per_key
from .scan import row_before, running_sum

HOUR_US = 3_600_000_000
MOST_ATTEMPTS = 12


def pending(inbox: DataFrame, now_us: int) -> DataFrame:
    """Unprocessed rows that are due and not given up, the oldest first."""
    return inbox.filter("processed_us is null and dead_us is null").filter(F.col("next_us") <= now_us).orderBy("received_us", "event_id")


def expired(inbox: DataFrame, now_us: int, hours: int = 48) -> DataFrame:
    """Processed rows past retention. What was given up is never deleted."""
    return inbox.filter("dead_us is null").filter(F.col("processed_us") < now_us - hours * HOUR_US)


def depth(inbox: DataFrame, now_us: int) -> DataFrame:
    """(n_pending, oldest_age_s): one row."""
    waiting = inbox.filter("processed_us is null and dead_us is null")
    return waiting.agg(F.count("*").alias("n_pending"), F.greatest(F.lit(0), F.floor((now_us - F.min("received_us")) / 1_000_000)).cast("bigint").alias("oldest_age_s"))


def enqueue(inbox: DataFrame, arrivals: DataFrame, now_us: int) -> DataFrame:
    """The queue with what arrived (event_id): what is there already is not put in again, nor what arrives twice."""
    new = arrivals.select("event_id").distinct().join(inbox.select("event_id"), "event_id", "left_anti")
    empty = lambda c: F.lit(None).cast("bigint").alias(c)
    return inbox.unionByName(new.select("event_id", F.lit(now_us).cast("bigint").alias("received_us"), F.lit(0).cast("bigint").alias("attempts"), empty("processed_us"), empty("dead_us"), F.lit(now_us).cast("bigint").alias("next_us")))


def settle(inbox: DataFrame, outcomes: DataFrame, now_us: int) -> DataFrame:
    """The queue after attempts (event_id, ok) at what was due: done, due again later, or given up. Others stay."""
    j = inbox.join(outcomes.select("event_id", "ok"), "event_id", "left")
    tried = F.col("ok").isNotNull() & F.col("processed_us").isNull() & F.col("dead_us").isNull() & (F.col("next_us") <= now_us)
    failed = tried & ~F.col("ok")
    attempts = F.col("attempts") + F.when(failed, 1).otherwise(0)
    dead = failed & (attempts >= MOST_ATTEMPTS)
    return j.select(
        "event_id", "received_us", attempts.alias("attempts"), F.when(tried & F.col("ok"), now_us).otherwise(F.col("processed_us")).alias("processed_us"), F.when(dead, now_us).otherwise(F.col("dead_us")).alias("dead_us"),
        F.when(failed & ~dead, F.lit(now_us) + backoff_seconds(attempts) * 1_000_000).otherwise(F.col("next_us")).alias("next_us"),
    )


def attempt_state(inbox: DataFrame) -> DataFrame:
    """(event_id, state, wait_s): after the failures so far, done, dead, or waiting for 2, 4, ... 512 seconds."""
    state = F.when(F.col("processed_us").isNotNull(), "done").when(F.col("attempts") >= MOST_ATTEMPTS, "dead").otherwise("waiting")
    return inbox.select("event_id", state.alias("state"), F.when(state == "waiting", backoff_seconds(F.col("attempts"))).alias("wait_s"))


def snapshots_due(log: DataFrame, snapshots: DataFrame, now_us: int, every: int, max_age_us: int) -> DataFrame:
    """(stream, reason): so many events, or so much time, since the last snapshot (stream, at_off, at_us); events win.

    Without a snapshot, age counts from the oldest event; a stream without new events is never due.
    """
    last = latest_per_key(snapshots, ["stream"], [F.desc("at_off")]).select("stream", "at_off", "at_us")
    new = log.join(last, "stream", "left").filter(F.col("at_off").isNull() | (F.col("off") > F.col("at_off")))
    per = new.groupBy("stream").agg((F.max("off") - F.coalesce(F.max("at_off"), F.lit(0))).alias("n"), F.coalesce(F.max("at_us"), F.min("us")).alias("since_us"))
    reason = F.when(F.col("n") >= every, "event_count").when(F.lit(now_us) - F.col("since_us") >= max_age_us, "time")
    return per.select("stream", reason.alias("reason")).filter("reason is not null")


def replay_decision(requests: DataFrame, heads: DataFrame, snapshots: DataFrame, limit: int) -> DataFrame:
    """(stream, since, decision, at_off): of requests (stream, since). Unknown streams and places outside the stream are
    errors; channel streams further behind than ``limit`` get their newest snapshot at or after ``since``, or an error;
    all others replay."""
    last = snapshots.groupBy("stream").agg(F.max("at_off").alias("at_off"))
    j = requests.join(heads.select("stream", "head"), "stream", "left").join(last, "stream", "left")
    far = F.col("stream").startswith("channel:") & (F.col("head") - F.col("since") > limit)
    usable = (F.col("at_off") >= F.col("since")) & (F.col("at_off") <= F.col("head"))
    decision = (
        F.when(F.col("head").isNull(), "unknown_stream").when((F.col("since") < 0) | (F.col("since") > F.col("head")), "bad_offset")
        .when(far & usable, "snapshot").when(far, "no_snapshot").otherwise("replay")
    )
    return j.select("stream", "since", decision.alias("decision"), F.when(decision == "snapshot", F.col("at_off")).alias("at_off"))


def user_changes(log: DataFrame) -> DataFrame:
    """(user_id, off, change) of states seen in order (display, real): added, renamed, profile, or nothing where equal."""
    x = row_before(log, "user_id", ["off"], ["display", "real"], "_was")
    change = F.when(F.col("_was").isNull(), F.array(F.lit("added"))).otherwise(F.array_compact(F.array(F.when(~F.col("display").eqNullSafe(F.col("_was.display")), F.lit("renamed")), F.when(~F.col("real").eqNullSafe(F.col("_was.real")), F.lit("profile")))))
    return x.select("user_id", "off", F.explode(change).alias("change"))


def corrective_edits(log: DataFrame) -> DataFrame:
    """(stream, msg_ts, id): base messages posted again with other content than the first, unless an edit already says so.

    Content is (k, thread_ts), compared as a whole with nulls equal."""
    w = W.partitionBy("stream", "msg_ts").orderBy("id")
    content = F.struct("k", "thread_ts")
    base = log.filter("kind = 'message' and msg_ts is not null").withColumn("_first", F.first(content).over(w)).withColumn("_n", F.row_number().over(w))
    again = base.filter("_n > 1").filter(~content.eqNullSafe(F.col("_first")))
    edits = log.filter("kind = 'message_changed'").select("stream", "msg_ts", "k").distinct()
    return again.join(edits, ["stream", "msg_ts", "k"], "left_anti").select("stream", "msg_ts", "id")


def corrections(events: DataFrame) -> DataFrame:
    """(stream, msg_ts, id, content): the edits that a log owes to base messages which come again with other content, in
    order of id. ``events``: id, stream, kind (message or message_changed), msg_ts, content.

    One edit for each new content: none where it is the first content, was said by an edit before, or has been given.
    """
    one = events.filter("stream is not null and msg_ts is not null").select("stream", "msg_ts", "id", "kind", "content")
    base = F.col("kind") == "message"
    first = one.filter(base).groupBy("stream", "msg_ts").agg(F.min("id").alias("_first"), F.min_by("content", "id").alias("_content"))
    j = one.join(first, ["stream", "msg_ts"]).filter(~base | ((F.col("id") > F.col("_first")) & (F.col("content") != F.col("_content"))))
    said = j.groupBy("stream", "msg_ts", "content").agg(F.min("id").alias("id"), F.min_by("kind", "id").alias("kind"))
    return said.filter("kind = 'message'").select("stream", "msg_ts", "id", "content")


def degraded_episodes(attempts: DataFrame, min_us: int) -> DataFrame:
    """(channel_id, us) where an outage is announced: a run of failures between successes, at most once, at the first
    failure that comes ``min_us`` or more after the run's first. ``attempts``: channel_id, us, id, ok."""
    counted = running_sum(attempts.withColumn("_ok", F.col("ok").cast("int")), "channel_id", ["us", "id"], "_ok", "episode")
    runs = counted.filter("not ok")
    began = runs.groupBy("channel_id", "episode").agg(F.min("us").alias("began"))
    return runs.join(began, ["channel_id", "episode"]).filter(F.col("us") - F.col("began") >= min_us).groupBy("channel_id", "episode").agg(F.min("us").alias("us")).select("channel_id", "us")




# The reasons, in the order in which they are asked for.
def staleness(states: DataFrame, now_us: int, after_s: int = 60) -> DataFrame:
    """Adds ``reason`` (null: current) to states with health, caught_up and last_frame_us; the first that holds counts."""
    silent = F.col("last_frame_us").isNull() | (F.lit(now_us) - F.col("last_frame_us") > after_s * 1_000_000)
    caught = F.coalesce("caught_up", F.lit(False))
    reason = (
        F.when(F.col("health") == "auth_failed", "auth token invalid").when(F.col("health") == "disconnected", "socket-mode disconnected").when(F.col("health") == "degraded", "slack ingestion unhealthy")
        .when(~caught, "catching up after reconnect").when(silent, "server unreachable")
    )
    return states.withColumn("reason", reason)


# The line that is put behind a document that may be stale.
def trailers(states: DataFrame, now_us: int, after_s: int = 60) -> DataFrame:
    """Adds ``decision`` (stale, fallback or clean), ``reasons`` and ``trailer`` to states as for ``staleness`` with
    ``fallbacks`` (array of what could not be named). A stale state has its one reason, whatever else there is, and alone gives a
    trailer, with the last frame's time or never."""
    s = staleness(states, now_us, after_s)
    fallbacks = F.coalesce("fallbacks", F.array().cast("array<string>"))
    decision = F.when(F.col("reason").isNotNull(), "stale").when(F.size(fallbacks) > 0, "fallback").otherwise("clean")
    last = F.coalesce(local(F.col("last_frame_us"), "UTC", "yyyy-MM-dd HH:mm:ss' UTC'"), F.lit("never"))
    text = F.concat(F.lit("\n---\n\n> ⚠ Content may be stale. Last successful sync: "), last, F.lit(". Reason: "), "reason", F.lit(".\n"))
    return s.withColumn("decision", decision).withColumn("reasons", F.when(F.col("reason").isNotNull(), F.array("reason")).otherwise(fallbacks)).withColumn("trailer", text)
