"""What a client keeps of a channel's log: rows for messages, rows for replies, and how many replies a parent shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def message_operations(log: DataFrame) -> DataFrame:
    """(channel_id, ts, off, op, thread_ts, n): what each event does, by message time: ``top`` and ``reply`` write a row,
    ``drop`` removes one.

    A deletion that carries the deleted reply's thread (``previous_thread_ts``) removes the reply. Any other removes the
    message's own row if there is one at that point, and else the reply of that time.
    """
    is_reply = F.col("thread_ts").isNotNull() & (F.col("thread_ts") != F.col("msg_ts"))
    writes = log.filter("kind in ('message', 'message_changed') and msg_ts is not null").select("channel_id", F.col("msg_ts").alias("ts"), "off", F.when(is_reply, "reply").otherwise("top").alias("op"), F.when(is_reply, F.col("thread_ts")).alias("thread_ts"), F.coalesce("reply_count", F.lit(0)).cast("bigint").alias("n"))
    known = F.col("previous_thread_ts") if "previous_thread_ts" in log.columns else F.lit(None).cast("string")
    gone = log.filter("kind = 'message_deleted' and deleted_ts is not null").select("channel_id", F.col("deleted_ts").alias("ts"), "off", F.lit("drop").alias("op"), F.when(known != F.col("deleted_ts"), known).alias("thread_ts"), F.lit(0).cast("bigint").alias("n"))
    ops = writes.unionByName(gone)
    before = W.partitionBy("channel_id", "ts").orderBy("off").rowsBetween(W.unboundedPreceding, -1)
    open_drop = F.col("op").eqNullSafe("drop") & F.col("thread_ts").isNull()
    last_top, last_drop = F.max(F.when(F.col("op") == "top", F.col("off"))).over(before), F.max(F.when(open_drop, F.col("off"))).over(before)
    there = last_top.isNotNull() & (last_drop.isNull() | (last_top > last_drop))
    what = F.when(F.col("op") != "drop", F.col("op")).when(open_drop & there, "drop_top").otherwise("drop_reply")
    return ops.withColumn("_what", what).select("channel_id", "ts", "off", F.col("_what").alias("op"), "thread_ts", "n")


def _reply_changes(ops: DataFrame) -> DataFrame:
    """(channel_id, thread_ts, ts, off, change, names): replies of each thread as they come and go, by 1, 0 or -1.

    A deletion that names no thread removes the reply of that time wherever it is, if there is one.
    """
    replies = ops.filter("op = 'reply'")
    threads = replies.select("channel_id", "ts", "thread_ts").distinct()
    named = ops.filter("op = 'drop_reply' and thread_ts is not null")
    unnamed = ops.filter("op = 'drop_reply' and thread_ts is null").drop("thread_ts").join(threads, ["channel_id", "ts"])
    all_ = replies.withColumn("named", F.lit(True)).unionByName(named.withColumn("named", F.lit(True))).unionByName(unnamed.withColumn("named", F.lit(False)))
    own = W.partitionBy("channel_id", "thread_ts", "ts").orderBy("off")
    was = F.coalesce(F.lag(F.col("op") == "reply").over(own), F.lit(False))
    change = F.when(F.col("op") == "reply", F.when(was, 0).otherwise(1)).otherwise(F.when(was, -1).otherwise(0))
    return all_.withColumn("change", change).withColumn("deletes", (F.col("op") == "drop_reply") & (F.col("named") | (F.col("change") == -1)))


def thread_rows(log: DataFrame) -> DataFrame:
    """(channel_id, thread_ts, ts, off): the replies that are left, with the offset of the last write."""
    changes = _reply_changes(message_operations(log))
    last = changes.groupBy("channel_id", "thread_ts", "ts").agg(F.max_by("op", "off").alias("op"), F.max("off").alias("off"))
    return last.filter("op = 'reply'").drop("op")


def reply_counts(log: DataFrame) -> DataFrame:
    """(channel_id, ts, reply_count): the messages' own rows, with the count that each shows.

    A write raises the count to its own number or to the replies kept here, whichever is more; a reply that comes raises
    it to those kept; a reply that is deleted sets it to those kept, even if that is less. A deleted message that is
    posted again begins anew.
    """
    ops = message_operations(log)
    changes = _reply_changes(ops)
    thread = W.partitionBy("channel_id", "thread_ts").orderBy("off").rowsBetween(W.unboundedPreceding, 0)
    kept = changes.withColumn("kept", F.sum("change").over(thread)).select("channel_id", F.col("thread_ts").alias("ts"), "off", "kept", "deletes", F.lit(None).cast("bigint").alias("n"), F.lit("reply").alias("what"))
    own = ops.filter("op in ('top', 'drop_top')").select("channel_id", "ts", "off", F.lit(None).cast("bigint").alias("kept"), F.lit(False).alias("deletes"), F.when(F.col("op") == "top", F.col("n")).alias("n"), F.when(F.col("op") == "top", "write").otherwise("gone").alias("what"))
    w = W.partitionBy("channel_id", "ts").orderBy("off")
    before = w.rowsBetween(W.unboundedPreceding, 0)
    rows = own.unionByName(kept).withColumn("kept", F.coalesce(F.last("kept", ignorenulls=True).over(before), F.lit(0)))
    rows = rows.withColumn("life", F.coalesce(F.sum((F.col("what") == "gone").cast("int")).over(before), F.lit(0)))
    # only rows of the last life count, and of those only what comes from its first write on
    life = W.partitionBy("channel_id", "ts", "life").orderBy("off").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("born", F.min(F.when(F.col("what") == "write", F.col("off"))).over(life)).filter("born is not null and off >= born")
    latest = rows.groupBy("channel_id", "ts", "life").agg(F.max(F.when(F.col("deletes"), F.col("off"))).alias("reset"))
    counted = rows.join(latest, ["channel_id", "ts", "life"]).filter("reset is null or off >= reset")
    value = F.when(F.col("off") == F.col("reset"), F.col("kept")).otherwise(F.greatest("kept", "n"))
    shown = counted.groupBy("channel_id", "ts", "life").agg(F.max(value).cast("bigint").alias("reply_count"))
    lives = ops.filter("op = 'drop_top'").groupBy("channel_id", "ts").agg(F.count("*").alias("_lives"))
    return shown.join(lives, ["channel_id", "ts"], "left").filter(F.col("life") == F.coalesce("_lives", F.lit(0))).select("channel_id", "ts", "reply_count")


def thread_merge(base: DataFrame, log: DataFrame) -> DataFrame:
    """(channel_id, thread_ts, ts, off, is_parent): cached threads (channel_id, thread_ts, ts) with a log replayed over
    them. Messages and edits of a thread set, deletions remove; a parent is never removed, but edits to it count."""
    threads = base.select("channel_id", "thread_ts").distinct()
    seeds = base.select("channel_id", "thread_ts", "ts", F.lit(0).cast("bigint").alias("off"), F.lit(True).alias("there"))
    own = F.coalesce("thread_ts", "msg_ts")
    sets = log.filter("kind in ('message', 'message_changed') and msg_ts is not null").select("channel_id", own.alias("thread_ts"), F.col("msg_ts").alias("ts"), "off", F.lit(True).alias("there")).join(threads, ["channel_id", "thread_ts"], "left_semi")
    gone = log.filter("kind = 'message_deleted' and deleted_ts is not null").select("channel_id", F.col("deleted_ts").alias("ts"), "off")
    known = seeds.unionByName(sets).select("channel_id", "thread_ts", "ts").distinct().filter("ts <> thread_ts")
    gone = gone.join(known, ["channel_id", "ts"]).select("channel_id", "thread_ts", "ts", "off", F.lit(False).alias("there"))
    last = seeds.unionByName(sets).unionByName(gone).groupBy("channel_id", "thread_ts", "ts").agg(F.max_by("there", "off").alias("there"), F.max("off").alias("off"))
    return last.filter("there").select("channel_id", "thread_ts", "ts", "off", (F.col("ts") == F.col("thread_ts")).alias("is_parent"))


def bumped(base: DataFrame, bumps: DataFrame) -> DataFrame:
    """(channel_id, ts, reply_count, latest_reply): cached counts after notices (channel_id, ts, off, delta, latest_reply).

    A count never falls below zero at any step: with S the running sum of the deltas it ends at the greater of the first
    count plus S, and S less its least value. Notices of unknown messages do nothing; one without a time keeps the old.
    """
    so_far = W.partitionBy("channel_id", "ts").orderBy("off").rowsBetween(W.unboundedPreceding, 0)
    sums = bumps.withColumn("s", F.sum("delta").over(so_far)).groupBy("channel_id", "ts").agg(F.max_by("s", "off").alias("total"), F.min("s").alias("low"), F.expr("max_by(latest_reply, off) FILTER (WHERE latest_reply IS NOT NULL)").alias("last"))
    j = base.join(sums, ["channel_id", "ts"], "left")
    count = F.when(F.col("total").isNull(), F.col("reply_count")).otherwise(F.greatest(F.col("reply_count") + F.col("total"), F.col("total") - F.col("low")))
    return j.select("channel_id", "ts", count.cast("bigint").alias("reply_count"), F.coalesce("last", "latest_reply").alias("latest_reply"))


# The line that a block ends with when its message has replies, for one and for more.
_THREAD_LINE = r"(?U)> Thread: \d+ repl(?:y|ies)"
_ENDS = r"(?U)[\s\x1C-\x1F]+\z"


def thread_line(block: Column, count: Column) -> Column:
    """A block whose line about replies says ``count``: the line is changed where there is one, put at the end where there
    is none, and taken out, with the white space behind the block, where nothing is left."""
    line = F.concat(F.lit("> Thread: "), count.cast("string"), F.when(count == 1, " reply").otherwise(" replies"))
    bare = F.regexp_replace(block, _ENDS, "")
    without = F.concat(F.regexp_replace(F.regexp_replace(block, _THREAD_LINE, ""), _ENDS, ""), F.lit("\n"))
    return F.when(count <= 0, without).when(block.rlike(_THREAD_LINE), F.regexp_replace(block, F.lit(_THREAD_LINE), line)).otherwise(F.concat(bare, F.lit("\n\n"), line, F.lit("\n")))


def thread_blocks(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """``blocks`` (channel_id, ts, block, reply_count, ...) after their replies were counted (channel_id, ts, reply_count).

    Adds ``changed``: whether the block or its count is another now. A message that is not counted stays as it is.
    """
    j = blocks.join(counts.select("channel_id", "ts", F.col("reply_count").cast("bigint").alias("_n")), ["channel_id", "ts"], "left")
    new = F.when(F.col("_n").isNull(), F.col("block")).otherwise(thread_line(F.col("block"), F.col("_n")))
    others = [c for c in blocks.columns if c not in ("block", "reply_count")]
    changed = (new != F.col("block")) | (F.coalesce("_n", "reply_count") != F.col("reply_count"))
    return j.select(*others, new.alias("block"), F.coalesce("_n", "reply_count").alias("reply_count"), changed.alias("changed"))
