"""Is the log complete? Gaps between days, samples without a local message, drift, inventories, sweeps, due rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import json_has_key
from ..functions.times import is_loose_ts, utc_day
from .folds import active_candidates
from .latest import islands, latest_per_key
from .scan import running_count

DAY_US = 86_400_000_000


def day_presence_gaps(log: DataFrame, samples: DataFrame) -> DataFrame:
    """Of the latest sample per channel and day, those whose message is not in the log undeleted; the newest first.

    Asks for exact (stream, time) keys and never folds the whole log.
    """
    s = latest_per_key(samples, ["channel_id", "day_us"], [F.desc("sampled_us"), F.desc("id")]).filter("sample_ts is not null")
    gone = log.filter("kind = 'message_deleted'").select("channel_id", F.col("deleted_ts").alias("sample_ts"))
    here = log.filter("kind = 'message'").select("channel_id", F.col("msg_ts").alias("sample_ts")).join(gone, ["channel_id", "sample_ts"], "left_anti")
    found = s.join(here, ["channel_id", "sample_ts"], "left_anti")
    return found.select("channel_id", utc_day(F.col("day_us")).cast("string").alias("day"), "sample_ts", "sampled_us", F.lit("day_presence").alias("gap_type")).orderBy(F.desc("sampled_us"), "channel_id")


def probe_status(sweeps: DataFrame, samples: DataFrame, now_us: int) -> DataFrame:
    """One row: the latest completed sweep (started_us, ended_us, id), its age, and what it sampled between its start and
    end; nulls and zeros without one."""
    last = sweeps.orderBy(F.desc("ended_us"), F.desc("id")).limit(1).select("started_us", "ended_us")
    inside = samples.join(F.broadcast(last), (F.col("sampled_us") >= F.col("started_us")) & (F.col("sampled_us") <= F.col("ended_us")), "left_semi")  # one row
    seen = inside.agg(F.countDistinct("channel_id").alias("channels_covered"), F.countDistinct("day_us").alias("days_covered"))
    one = last.agg(F.max("ended_us").alias("last_sweep_us"))
    return one.join(F.broadcast(seen), F.lit(True)).select("last_sweep_us", F.floor((now_us - F.col("last_sweep_us")) / 1_000_000).alias("age_seconds"), "channels_covered", "days_covered")


def refill_in_flight(runs: DataFrame, windows: DataFrame) -> DataFrame:
    """(channel_id, oldest, latest, in_flight) of asked windows: a started run with that window, within a millionth of a
    second, has not finished. ``runs`` has channel_id, run_id, kind, oldest and latest as text."""
    number = r"\A[0-9]+(\.[0-9]+)?\z"
    open_ = runs.filter((F.col("kind") == "started") & F.col("run_id").isNotNull() & F.col("oldest").rlike(number) & F.col("latest").rlike(number))
    open_ = open_.join(runs.filter("kind = 'finished'").select("channel_id", "run_id"), ["channel_id", "run_id"], "left_anti")
    open_ = open_.select("channel_id", F.col("oldest").cast("double").alias("_o"), F.col("latest").cast("double").alias("_l"))
    # windows meet by whole seconds; one that lies at the edge of a second asks for both
    edge, near = 0.000001, lambda a, b: F.abs(F.col(a) - F.col(b)) < 0.000001
    seconds = F.array_distinct(F.array(F.floor(F.col("oldest") - edge), F.floor(F.col("oldest") + edge)))
    asked = windows.select("channel_id", "oldest", "latest", F.explode(seconds).alias("_s"))
    hit = asked.join(open_.withColumn("_s", F.floor("_o")), ["channel_id", "_s"]).filter(near("oldest", "_o") & near("latest", "_l")).select("channel_id", "oldest", "latest").distinct().withColumn("in_flight", F.lit(True))
    return windows.join(hit, ["channel_id", "oldest", "latest"], "left").select("channel_id", "oldest", "latest", F.coalesce("in_flight", F.lit(False)).alias("in_flight"))


def gaps(log: DataFrame, created: DataFrame | None = None) -> DataFrame:
    """(channel_id, first_missing, last_missing, n_missing): days without any message between days with one, in UTC.

    ``created`` (channel_id, day): counts as a day with a message, so that silence after it is a gap. Silence at the
    end never is.
    """
    days = log.filter("kind = 'message'").select("channel_id", utc_day(F.col("us")).alias("day"))
    if created is not None:
        days = days.unionByName(created.join(days.select("channel_id").distinct(), "channel_id", "left_semi").select("channel_id", "day"))
    return islands(days, "channel_id", "day")


def gaps_ranked(found: DataFrame) -> DataFrame:
    """(channel_id, n_ranges, n_missing, rank): the largest holes first."""
    per = found.groupBy("channel_id").agg(F.count("*").alias("n_ranges"), F.sum("n_missing").alias("n_missing"))
    # ranks come from a count per total, so that no window has to sort all channels in one task
    totals = per.groupBy("n_missing").agg(F.count("*").alias("_n"))
    before = totals.withColumn("_before", F.sum("_n").over(W.orderBy(F.desc("n_missing")).rowsBetween(W.unboundedPreceding, -1)))
    within = running_count(per, "n_missing", ["channel_id"], "_w")  # the commonest total in blocks
    return within.join(before.drop("_n"), "n_missing").select("channel_id", "n_ranges", "n_missing", (F.coalesce("_before", F.lit(0)) + F.col("_w")).alias("rank"))


def older_not_walked(samples: DataFrame) -> DataFrame:
    """Of samples that ask for what is older than the oldest local message (latest_ts, n_messages): the latest per
    channel, if it found anything."""
    return latest_per_key(samples.filter("latest_ts is not null"), ["channel_id"], [F.desc("sampled_us"), F.desc("id")]).filter("n_messages > 0")


def newest_drift(log: DataFrame, samples: DataFrame, seconds: int = 300) -> DataFrame:
    """Channels whose newest message upstream is more than ``seconds`` newer than the newest active one here, or without
    one here; those without first."""
    s = latest_per_key(samples, ["channel_id"], [F.desc("sampled_us"), F.desc("id")]).filter(is_loose_ts(F.col("sample_ts")))
    local = active_candidates(log).filter(is_loose_ts(F.col("ts"))).withColumn("channel_id", F.substring("stream", 9, 1_000_000)).groupBy("channel_id").agg(F.max(F.col("ts").cast("decimal(20,6)")).alias("local"))
    upstream = F.col("sample_ts").cast("decimal(20,6)")
    delta_us = ((upstream - F.col("local")) * 1_000_000).cast("bigint")
    return s.join(local, "channel_id", "left").select("channel_id", "sample_ts", delta_us.alias("delta_us"), "sampled_us").filter((F.col("delta_us") > seconds * 1_000_000) | F.col("delta_us").isNull()).orderBy(F.desc_nulls_first("delta_us"))


def _latest_listing(listed: DataFrame, id_col: str) -> DataFrame:
    """The items of the latest of listings as rows (id, sampled_us, item), as ``id_col``."""
    last = listed.agg(F.max(F.struct("sampled_us", "id")).alias("_last"))
    return listed.join(F.broadcast(last), F.struct("sampled_us", "id") == F.col("_last")).select(F.col("item").alias(id_col))  # one row


def missing_ids(listed: DataFrame, known: DataFrame, id_col: str) -> DataFrame:
    """Items of the latest listing, as rows (id, sampled_us, item), that are not known."""
    return _latest_listing(listed, id_col).distinct().join(known.select(id_col), id_col, "left_anti")


def absent_upstream(scope: DataFrame, listed: DataFrame, id_col: str) -> DataFrame:
    """Ids in scope that the latest listing lacks."""
    return scope.select(id_col).join(_latest_listing(listed, id_col), id_col, "left_anti")


def daily_drift(listed: DataFrame) -> DataFrame:
    """(day, n, delta): the size of each day's latest listing and its change since the day before that has one."""
    sizes = listed.groupBy("id", "sampled_us").agg(F.count("*").alias("n"))
    per_day = latest_per_key(sizes.withColumn("day", utc_day(F.col("sampled_us"))), ["day"], [F.desc("sampled_us"), F.desc("id")]).select("day", "n")
    return per_day.withColumn("delta", F.col("n") - F.lag("n").over(W.orderBy("day")))  # one row a day


def sweep_alert(sweeps: DataFrame, now_us: int, seconds: int) -> DataFrame:
    """One row if there is no completed sweep or the last is too old, else none."""
    return sweeps.agg(F.max("ended_us").alias("last_us")).filter(F.col("last_us").isNull() | (F.lit(now_us) - F.col("last_us") > seconds * 1_000_000))


def due(samples: DataFrame, scope: DataFrame, cadence_us: int, now_us: int) -> DataFrame:
    """(channel_id, age_us, is_due): age of the latest sample of each channel in scope; none is due at once."""
    last = samples.groupBy("channel_id").agg(F.max("sampled_us").alias("_last"))
    return scope.select("channel_id").join(last, "channel_id", "left").select("channel_id", (F.lit(now_us) - F.col("_last")).alias("age_us")).withColumn("is_due", F.col("age_us").isNull() | (F.col("age_us") > cadence_us))


def stale_day(samples: DataFrame, channel: Column, now_us: int, days: int = 30) -> DataFrame:
    """The day, of the last ``days`` complete UTC days, whose sample of a channel is oldest; none counts as oldest, the
    earliest day wins ties."""
    today = now_us // DAY_US
    window = samples.sparkSession.range(today - days, today).select((F.col("id") * DAY_US).alias("day_us"))
    last = samples.filter(channel).groupBy("day_us").agg(F.max("sampled_us").alias("_last"))
    return window.join(last, "day_us", "left").orderBy(F.asc_nulls_first("_last"), "day_us").limit(1).select("day_us", (F.lit(now_us) - F.col("_last")).alias("age_us"))


def resume_points(log: DataFrame, scope: DataFrame, now_us: int, lookback_us: int) -> DataFrame:
    """(channel_id, from_us): the newest local message, or now less the look-back."""
    head = log.filter("kind = 'message'").groupBy("channel_id").agg(F.max(F.replace("msg_ts", F.lit("."), F.lit("")).try_cast("bigint")).alias("_h"))
    return scope.select("channel_id").join(head, "channel_id", "left").select("channel_id", F.coalesce("_h", F.lit(now_us - lookback_us)).alias("from_us"))


def caught_up_threads(active: DataFrame, summaries: DataFrame) -> DataFrame:
    """(channel_id, thread_ts) of upstream summaries (with reply_count and latest_reply) that the active replies equal."""
    replies = active.filter("thread_ts is not null and thread_ts <> msg_ts").groupBy("channel_id", "thread_ts").agg(F.countDistinct("msg_ts").alias("reply_count"), F.max("msg_ts").alias("latest_reply"))
    return summaries.join(replies, ["channel_id", "thread_ts", "reply_count", "latest_reply"], "left_semi").select("channel_id", "thread_ts")


def parity(left: DataFrame, middle: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, left_n, middle_n, right_n, same) over three stores (key, n); a store without the key counts zero."""
    named = [d.select(key, F.col("n").alias(c)) for d, c in ((left, "left_n"), (middle, "middle_n"), (right, "right_n"))]
    j = named[0].join(named[1], key, "full_outer").join(named[2], key, "full_outer")
    cols = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("left_n", "middle_n", "right_n")]
    return j.select(key, *cols).withColumn("same", (F.col("left_n") == F.col("middle_n")) & (F.col("middle_n") == F.col("right_n")))


def probe_kind(call: Column) -> Column:
    """What a sample asked for, by which keys its call (JSON) has: neither bound, the upper one, both; else null."""
    latest, oldest = json_has_key(call, "latest"), json_has_key(call, "oldest")
    return F.when(~latest & ~oldest, "newest").when(latest & ~oldest, "older").when(latest & oldest, "between")
