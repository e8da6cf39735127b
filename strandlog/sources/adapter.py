"""Event logs derived from the generic test tables, deterministically, with typed columns as ingest promotes them.

A log has: id, stream, channel_id, off (offset in stream), kind, us (ingest time, microseconds), and what the kinds
carry: msg_ts, previous_ts, deleted_ts, thread_ts, reply_count, latest_reply, parent_ts, k (a small number).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import micros_ts
from ..operators.scan import running_count, running_last
from .shared import written_once

#: The kind that stands for each type of generic event, and the moment that "now" is in queries.
KINDS = {"view": "message", "signup": "message", "click": "message_changed", "error": "message_deleted", "purchase": "parent_replied"}
NOW_US = 1_706_745_600_000_000  # 2024-02-01 00:00:00 UTC


def micros(column: str) -> F.Column:
    """Microseconds of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def channel_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of messages, edits, deletions and reply notices; a stream for each user of ``events``. Derived once."""
    return written_once(spark, sf_dir, "channel-log", lambda: derived_channel_log(spark, sf_dir), ["stream", "off"], ["events"])


def derived_channel_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", micros("ts").alias("us"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("event_type")]
    order = ["us", "event_id"]
    e = running_count(e.withColumn("kind", kind).withColumn("ets", micros_ts(F.col("us"))), "user_id", order, "off").withColumn("off", F.col("off").cast("bigint"))
    e = running_last(e, "user_id", order, F.when(F.col("kind") == "message", F.col("ets")), "tgt", itself=False)
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("channel:C"), "user_id").alias("stream"), F.concat(F.lit("C"), "user_id").alias("channel_id"), "off", "kind", "us", "k",
        F.when(is_("message"), F.col("ets")).when(is_("message_changed"), F.when(F.col("k") % 5 == 0, F.col("ets")).otherwise(F.col("tgt"))).alias("msg_ts"),
        F.when(is_("message_changed"), F.col("tgt")).alias("previous_ts"),
        F.when(is_("message_deleted"), F.col("tgt")).alias("deleted_ts"),
        F.when(is_("message") & (F.col("k") % 4 == 0), F.col("tgt")).alias("thread_ts"),
        F.when(is_("message", "message_changed") & (F.col("k") % 3 == 0), F.col("k") % 7).when(is_("parent_replied"), F.col("k") % 10).alias("reply_count"),
        F.when(is_("parent_replied"), F.col("ets")).alias("latest_reply"),
        F.when(is_("parent_replied"), F.col("tgt")).alias("parent_ts"),
    )


#: The same log for DuckDB: named queries of a WITH clause, the last of which is ``log``.
CHANNEL_LOG_SQL = """
ev AS (SELECT event_id, user_id, epoch_us(ts) AS us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  CASE event_type WHEN 'click' THEN 'message_changed' WHEN 'error' THEN 'message_deleted' WHEN 'purchase' THEN 'parent_replied' ELSE 'message' END AS kind FROM events),
ev2 AS (SELECT *, (us // 1000000) || '.' || lpad(CAST(us % 1000000 AS VARCHAR), 6, '0') AS ets, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS off FROM ev),
ev3 AS (SELECT *, last_value(CASE WHEN kind = 'message' THEN ets END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tgt FROM ev2),
log AS (SELECT event_id AS id, 'channel:C' || user_id AS stream, 'C' || user_id AS channel_id, off, kind, us, k,
  CASE WHEN kind = 'message' OR (kind = 'message_changed' AND k % 5 = 0) THEN ets WHEN kind = 'message_changed' THEN tgt END AS msg_ts,
  CASE WHEN kind = 'message_changed' THEN tgt END AS previous_ts, CASE WHEN kind = 'message_deleted' THEN tgt END AS deleted_ts,
  CASE WHEN kind = 'message' AND k % 4 = 0 THEN tgt END AS thread_ts,
  CASE WHEN kind IN ('message', 'message_changed') AND k % 3 = 0 THEN k % 7 WHEN kind = 'parent_replied' THEN k % 10 END AS reply_count,
  CASE WHEN kind = 'parent_replied' THEN ets END AS latest_reply, CASE WHEN kind = 'parent_replied' THEN tgt END AS parent_ts FROM ev3)
"""


def channel_list_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of channels added, refreshed, renamed, archived and joined; a channel for each customer of ``orders``.

    Nulls stand for absent fields: an older event of a kind that has a value is masked by a newer one that lacks it.
    """
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", F.floor("o_totalprice").cast("bigint").alias("x"))
    p = F.substring("o_orderpriority", 1, 1)
    full = p.isin("1", "2")
    x = F.col("x")
    unless = lambda n, value: F.when(x % n != 0, value)
    kind = F.when(p == "1", "channel_added").when(p == "2", "channel_info_refreshed").when(p == "3", "channel_renamed").when(p == "5", "channel_member_changed")
    kind = kind.otherwise(F.when(F.col("o_orderstatus") == "F", "channel_archived").when(F.col("o_orderstatus") == "O", "channel_unarchived").otherwise("channel_member_joined"))
    return o.select(
        F.concat(F.lit("C"), "o_custkey").alias("channel_id"), (F.col("o_orderkey") + 1).cast("bigint").alias("off"), kind.alias("kind"),
        F.when(full, unless(5, F.concat(F.lit("n"), x))).when(p == "3", unless(13, F.concat(F.lit("r"), x))).alias("name"),
        F.when(full, unless(7, x % 2 == 0)).when(p == "5", unless(17, x % 2 == 1)).alias("is_member"),
        F.when(full, unless(3, x % 4 == 0)).when(kind == "channel_archived", True).when(kind == "channel_unarchived", False).alias("is_archived"),
        F.when(full, unless(11, x % 100)).alias("num_members"),
        F.when(full, x % 10 == 1).alias("is_im"), F.when(full, x % 10 == 2).alias("is_mpim"),
        F.when(full & (x % 10 == 1), F.concat(F.lit("U"), x % 50)).alias("im_user_id"), F.when(full, unless(4, F.concat(F.lit("t"), x % 9))).alias("topic"), F.when(full, unless(6, F.when(x % 8 == 1, F.lit("")).otherwise(F.concat(F.lit("p"), x % 30)))).alias("purpose"),
        F.when(full & (x % 4 != 3), 1_700_000_000 + x * 60).alias("created"),
    )


CHANNEL_LIST_SQL = """
o AS (SELECT o_orderkey, o_custkey, left(o_orderpriority, 1) AS p, o_orderstatus, CAST(floor(o_totalprice) AS BIGINT) AS x FROM orders),
cl AS (SELECT 'C' || o_custkey AS channel_id, CAST(o_orderkey + 1 AS BIGINT) AS off,
  CASE p WHEN '1' THEN 'channel_added' WHEN '2' THEN 'channel_info_refreshed' WHEN '3' THEN 'channel_renamed' WHEN '5' THEN 'channel_member_changed'
    ELSE CASE o_orderstatus WHEN 'F' THEN 'channel_archived' WHEN 'O' THEN 'channel_unarchived' ELSE 'channel_member_joined' END END AS kind,
  CASE WHEN p IN ('1', '2') AND x % 5 <> 0 THEN 'n' || x WHEN p = '3' AND x % 13 <> 0 THEN 'r' || x END AS name,
  CASE WHEN p IN ('1', '2') AND x % 7 <> 0 THEN x % 2 = 0 WHEN p = '5' AND x % 17 <> 0 THEN x % 2 = 1 END AS is_member,
  CASE WHEN p IN ('1', '2') THEN CASE WHEN x % 3 <> 0 THEN x % 4 = 0 END WHEN p = '4' AND o_orderstatus = 'F' THEN true WHEN p = '4' AND o_orderstatus = 'O' THEN false END AS is_archived,
  CASE WHEN p IN ('1', '2') AND x % 11 <> 0 THEN x % 100 END AS num_members,
  CASE WHEN p IN ('1', '2') THEN x % 10 = 1 END AS is_im, CASE WHEN p IN ('1', '2') THEN x % 10 = 2 END AS is_mpim,
  CASE WHEN p IN ('1', '2') AND x % 10 = 1 THEN 'U' || (x % 50) END AS im_user_id, CASE WHEN p IN ('1', '2') AND x % 4 <> 0 THEN 't' || (x % 9) END AS topic, CASE WHEN p IN ('1', '2') AND x % 6 <> 0 THEN CASE WHEN x % 8 = 1 THEN '' ELSE 'p' || (x % 30) END END AS purpose,
  CASE WHEN p IN ('1', '2') AND x % 4 <> 3 THEN 1700000000 + x * 60 END AS created FROM o)
"""


def user_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_added for two customers in three, then renames (signups) and profile changes (purchases) by ``events``."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 3 <> 0")
    added = c.select(F.concat(F.lit("U"), "c_custkey").alias("user_id"), F.lit(0).cast("bigint").alias("off"), F.lit("user_added").alias("kind"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("d"), "c_custkey")).alias("display"), F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("r"), "c_custkey")).alias("real"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type in ('signup', 'purchase')").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    rename = F.col("event_type") == "signup"
    later = e.select(F.concat(F.lit("U"), "user_id").alias("user_id"), (F.col("event_id") + 1).cast("bigint").alias("off"), F.when(rename, "user_renamed").otherwise("user_profile_changed").alias("kind"), F.lit(None).cast("string").alias("name"),
                     F.when(rename, F.concat(F.lit("nick"), "k")).when(F.col("k") % 2 == 0, F.concat(F.lit("p"), "k")).otherwise(F.lit("")).alias("display"), F.when(~rename & (F.col("k") % 3 != 0), F.concat(F.lit("pr"), "k")).alias("real"))
    return added.unionByName(later)


USER_LOG_SQL = """
ul AS (SELECT 'U' || c_custkey AS user_id, CAST(0 AS BIGINT) AS off, 'user_added' AS kind, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'd' || c_custkey END AS display, CASE WHEN c_custkey % 5 <> 0 THEN 'r' || c_custkey END AS real
  FROM customer WHERE c_custkey % 3 <> 0
  UNION ALL SELECT 'U' || user_id, CAST(event_id + 1 AS BIGINT), CASE event_type WHEN 'signup' THEN 'user_renamed' ELSE 'user_profile_changed' END, NULL,
    CASE WHEN event_type = 'signup' THEN 'nick' || k WHEN k % 2 = 0 THEN 'p' || k ELSE '' END, CASE WHEN event_type = 'purchase' AND k % 3 <> 0 THEN 'pr' || k END
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type IN ('signup', 'purchase')))
"""


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of page fetches: started, pages, finished; a run for each order of ``lineitem``, streams by its part. Derived once."""
    return named_run_log(written_once(spark, sf_dir, "run-log", lambda: derived_run_log(spark, sf_dir), ["c", "id"], ["lineitem"]))


def derived_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shuffle, of an order's lines to one place: what a run is, its pages' numbers and its start and end come of one window."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", F.floor("l_quantity").cast("bigint").alias("q"))
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "q", "l_returnflag")
    run = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    pages = li.select(
        F.col("l_orderkey").cast("bigint").alias("o"), F.col("l_linenumber").cast("bigint").alias("page"), "q", F.row_number().over(order).alias("n"), F.min("l_partkey").over(run).alias("part"),
        F.max(F.col("l_returnflag") == "R").over(run).alias("done"), F.max(F.col("l_returnflag") == "A").over(run).alias("aborted"),
    )
    # a page, and beside a run's first one its start and its end
    marks = F.when(F.col("n") == 1, F.when(F.col("done"), F.array(F.lit(-1), F.lit(0), F.lit(99))).otherwise(F.array(F.lit(-1), F.lit(0)))).otherwise(F.array(F.lit(-1)))
    return pages.select("*", F.explode(marks).alias("mark")).select(
        (F.col("part") % 300).alias("c"), (F.col("o") * 100 + F.when(F.col("mark") < 0, F.col("n")).otherwise(F.col("mark"))).alias("id"), "mark", "page", "q", "o",
        F.when(F.col("mark") == 99, F.col("aborted")).alias("aborted"),
    )


def named_run_log(marks: DataFrame) -> DataFrame:
    """The run log of what ``derived_run_log`` gives, row by row: its texts follow from numbers, and only these are shuffled and kept."""
    page, more, o = F.col("mark") < 0, F.col("q") % 5 != 0, F.col("o")
    return marks.select(
        F.concat(F.lit("C"), F.col("c")).alias("channel_id"), F.concat(F.lit("R"), o).alias("run_id"), "id",
        F.when(page, "page").when(F.col("mark") == 0, "started").otherwise("finished").alias("kind"), F.when(page, F.col("page")).alias("page"), F.when(page, more).alias("has_more"),
        F.when(page & more, F.concat(F.lit("cur"), "q")).alias("cursor"), F.when(page, F.col("q")).alias("messages"),
        F.when(F.col("mark") == 99, F.when(F.col("aborted"), "aborted").otherwise("completed")).alias("outcome"), F.when(F.col("mark") == 0, o % 9 == 0).alias("bounded"),
    )


RUN_LOG_SQL = """
li AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, CAST(floor(l_quantity) AS BIGINT) AS q FROM lineitem),
rs AS (SELECT l_orderkey, min(l_partkey) AS part, bool_or(l_returnflag = 'R') AS done, bool_or(l_returnflag = 'A') AS aborted FROM li GROUP BY l_orderkey),
pg AS (SELECT li.*, part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, q, l_returnflag) AS n FROM li JOIN rs USING (l_orderkey)),
rl AS (SELECT 'C' || (part % 300) AS channel_id, 'R' || l_orderkey AS run_id, CAST(l_orderkey AS BIGINT) * 100 AS id, 'started' AS kind, CAST(NULL AS BIGINT) AS page, CAST(NULL AS BOOLEAN) AS has_more, CAST(NULL AS VARCHAR) AS "cursor", CAST(NULL AS BIGINT) AS messages, CAST(NULL AS VARCHAR) AS outcome, l_orderkey % 9 = 0 AS bounded FROM rs
  UNION ALL SELECT 'C' || (part % 300), 'R' || l_orderkey, CAST(l_orderkey AS BIGINT) * 100 + 99, 'finished', NULL, NULL, NULL, NULL, CASE WHEN aborted THEN 'aborted' ELSE 'completed' END, NULL FROM rs WHERE done
  UNION ALL SELECT 'C' || (part % 300), 'R' || l_orderkey, CAST(l_orderkey AS BIGINT) * 100 + n, 'page', l_linenumber, q % 5 <> 0, CASE WHEN q % 5 <> 0 THEN 'cur' || q END, q, NULL, NULL FROM pg)
"""


def samples(log: DataFrame) -> DataFrame:
    """Day-presence samples as a probe would have taken them: per channel and UTC day the newest message's time, one in
    three days off by a microsecond (a gap), some days sampled twice."""
    day_us = F.floor(F.col("us") / 86_400_000_000) * 86_400_000_000
    s = log.filter("kind = 'message'").groupBy("channel_id", day_us.cast("bigint").alias("day_us")).agg(F.max("us").alias("us"), F.max("k").alias("k"))
    n = F.col("day_us") / 86_400_000_000 + F.col("k")
    ts = micros_ts(F.when(n % 3 == 0, F.col("us") + 1).otherwise(F.col("us")))
    one = s.select("channel_id", "day_us", ts.alias("sample_ts"), (F.col("day_us") + 86_400_000_000 * 2).alias("sampled_us"), F.col("k").alias("id"))
    return one.unionByName(one.filter("id % 2 = 0").select("channel_id", "day_us", F.lit(None).cast("string").alias("sample_ts"), (F.col("sampled_us") - 1).alias("sampled_us"), "id"))


SAMPLES_SQL = """
sm0 AS (SELECT channel_id, (us // 86400000000) * 86400000000 AS day_us, max(us) AS us, max(k) AS k FROM log WHERE kind = 'message' GROUP BY ALL),
sm1 AS (SELECT channel_id, day_us, CASE WHEN (day_us // 86400000000 + k) % 3 = 0 THEN us + 1 ELSE us END AS u, day_us + 172800000000 AS sampled_us, k AS id FROM sm0),
sm AS (SELECT channel_id, day_us, (u // 1000000) || '.' || lpad(CAST(u % 1000000 AS VARCHAR), 6, '0') AS sample_ts, sampled_us, id FROM sm1
  UNION ALL SELECT channel_id, day_us, NULL, sampled_us - 1, id FROM sm1 WHERE id % 2 = 0)
"""
