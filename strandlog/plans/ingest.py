"""Queries of ingest and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds, ingest
from ..operators.latest import latest_per_key
from ..sources import adapter as a
from ..sources.shared import shared_folder
from ..streaming import apply
from .registry import query
from .state import ACTIVE_SQL, LOG


@query(f"{LOG}, {ACTIVE_SQL} SELECT stream, msg_ts AS ts, off FROM act")
def f1_active_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold over JSON payloads, promoted to typed columns first."""
    log = a.channel_log(spark, sf_dir)
    deleted, changed = F.col("kind") == "message_deleted", F.col("kind") == "message_changed"
    body = F.struct(F.col("msg_ts").alias("ts"), "thread_ts", "reply_count")
    payload = F.when(deleted, F.to_json(F.struct("deleted_ts"))).when(changed, F.to_json(F.struct(body.alias("message"), "previous_ts"))).when(F.col("kind") == "parent_replied", F.to_json(F.struct("parent_ts", "reply_count", "latest_reply"))).otherwise(F.to_json(body))
    events = log.select("id", "stream", F.col("off").alias("offset_in_stream"), "kind", payload.alias("payload"), F.timestamp_micros("us").alias("created_at"))
    return folds.active_messages(ingest.promote(events)).select("stream", F.col("msg_ts").alias("ts"), "off")


_PUSH_SQL = "pu AS (SELECT id, channel_id, k, CASE k % 8 WHEN 0 THEN 'channel_rename' WHEN 1 THEN 'member_joined_channel' WHEN 2 THEN 'user_change' WHEN 3 THEN 'odd' ELSE 'message' END AS t, CASE k % 8 WHEN 4 THEN 'message_deleted' WHEN 5 THEN 'message_changed' WHEN 6 THEN 'message_replied' END AS s FROM log)"


@query(f"""{LOG}, {_PUSH_SQL} SELECT id, CASE t WHEN 'message' THEN 'channel:' || channel_id WHEN 'user_change' THEN 'users' WHEN 'odd' THEN NULL ELSE 'channel-list' END AS stream,
CASE t WHEN 'channel_rename' THEN 'channel_renamed' WHEN 'member_joined_channel' THEN 'channel_member_joined' WHEN 'user_change' THEN 'user_profile_changed' WHEN 'message' THEN CASE s WHEN 'message_deleted' THEN s WHEN 'message_changed' THEN s WHEN 'message_replied' THEN 'parent_replied' ELSE 'message' END END AS kind,
CASE s WHEN 'message_deleted' THEN '9.9' WHEN 'message_changed' THEN '2.2' WHEN 'message_replied' THEN '2.2' ELSE '1.1' END AS ts FROM pu""")
def r10_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k") % 8
    type_ = F.when(k == 0, "channel_rename").when(k == 1, "member_joined_channel").when(k == 2, "user_change").when(k == 3, "odd").otherwise("message")
    subtype = F.when(k == 4, "message_deleted").when(k == 5, "message_changed").when(k == 6, "message_replied")
    body = F.to_json(F.struct(type_.alias("type"), subtype.alias("subtype"), F.col("channel_id").alias("channel"), F.lit("1.1").alias("ts"), F.lit("9.9").alias("deleted_ts"), F.struct(F.lit("2.2").alias("ts")).alias("message")))
    return ingest.translate(a.channel_log(spark, sf_dir).select("id", body.alias("body"))).select("id", "stream", "kind", "ts")


@query(f"{LOG}, h AS (SELECT stream, max(off) AS head FROM log GROUP BY 1) SELECT id, CASE WHEN k % 11 = 0 THEN 'unknown_stream' WHEN k - 3 < 0 THEN 'bad_since' WHEN k - 3 > head THEN 'since_beyond_head' ELSE 'ok' END AS status FROM log JOIN h USING (stream)")
def r5_subscribe_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = a.channel_log(spark, sf_dir)
    heads = log.groupBy("stream").agg(F.max("off").alias("head"))
    s = F.when(F.col("k") % 11 == 0, F.concat(F.lit("backfill-run:"), "channel_id")).otherwise(F.col("stream"))
    return log.join(heads, "stream").select("id", ingest.subscribe_status(s, F.col("k") - 3, F.col("head")).alias("status"))


@query(f"{LOG} SELECT channel_id, msg_ts AS ts, CASE WHEN fresh THEN 'new' ELSE 'old' END AS content FROM (SELECT channel_id, msg_ts, k % 2 = 0 AS fresh, bool_or(k % 10 = 0) OVER (PARTITION BY channel_id) AS hit FROM log WHERE kind = 'message') WHERE fresh AND hit OR NOT hit")
def r6_replace_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels with a snapshot hold its rows only; others stay as they are."""
    m = a.channel_log(spark, sf_dir).filter("kind = 'message'")
    hit = m.filter("k % 10 = 0").select("channel_id").distinct()
    current = m.select("channel_id", F.col("msg_ts").alias("ts"), F.when(F.col("k") % 2 == 0, "new").otherwise("old").alias("content"))
    snapshot = m.join(hit, "channel_id", "left_semi").filter("k % 2 = 0").select("channel_id", F.col("msg_ts").alias("ts"), F.lit("new").alias("content"))
    return ingest.replace_state(current, snapshot, ["channel_id", "ts"], "channel_id")


@query("SELECT user_id, arg_max(event_type, event_id) AS last_type, max(event_id) AS event_id FROM events GROUP BY 1")
def r1_stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files, its latest state per user kept by Spark between micro-batches."""
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/event[s].parquet")
    state = apply.latest_in_stream(source.withColumn("last_type", F.col("event_type")), ["user_id"], "event_id", ["last_type"])
    apply.keep_changes(state, f"{out}/state", f"{out}/checkpoint").awaitTermination()
    return latest_per_key(spark.read.parquet(f"{out}/state"), ["user_id"], [F.desc("event_id"), F.desc("batch")]).select("user_id", "last_type", "event_id")


def _heads(log: DataFrame) -> DataFrame:
    """What subscribers ask for: each stream from two offsets, at a moment in the middle of January."""
    at = 1_705_276_800_000_000
    return log.select("stream").distinct().withColumn("since", F.explode(F.array(F.lit(0), F.lit(5)).cast("array<bigint>"))).withColumn("at_us", F.lit(at).cast("bigint"))


@query(f"""{LOG}, rq AS (SELECT stream, unnest([0, 5]) AS since, 1705276800000000 AS at_us FROM (SELECT DISTINCT stream FROM log)), hd AS (SELECT rq.stream, since, at_us, coalesce((SELECT max(off) FROM log l WHERE l.stream = rq.stream AND l.us <= at_us), 0) AS head FROM rq),
ok AS (SELECT * FROM hd WHERE since <= head)
SELECT ok.stream, since, l.off, CASE WHEN l.off <= head THEN 'replay' ELSE 'live' END AS phase FROM ok JOIN log l ON l.stream = ok.stream AND l.off > since UNION ALL SELECT stream, since, head, 'caught_up' FROM ok UNION ALL SELECT stream, since, head, 'since_beyond_head' FROM hd WHERE since > head""")
def r4_replay_then_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = a.channel_log(spark, sf_dir)
    return ingest.replay_then_live(_heads(log), log)


@query(f"""{LOG}, m AS (SELECT *, (us - 1704067200000000) // 5000000 AS tick FROM (SELECT channel_id || '/' || k % 3 AS path, us FROM log WHERE kind <> 'message')), f AS (SELECT path, tick, min(us) AS first_us FROM m GROUP BY 1, 2)
SELECT path, tick, CAST((row_number() OVER (PARTITION BY tick ORDER BY first_us, path) - 1) // 2 AS BIGINT) AS drain FROM f""")
def r19_dirty_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty paths of each five seconds, each once, in order of the first mark, two at a time."""
    marks = a.channel_log(spark, sf_dir).filter("kind <> 'message'").select(F.concat_ws("/", "channel_id", F.col("k") % 3).alias("path"), "us")
    return ingest.dirty_batches(marks, 1_704_067_200_000_000, 5_000_000, 2).select("path", "tick", "drain")


@query(f"{LOG}, c AS (SELECT channel_id, msg_ts AS ts, 'old' AS content FROM log WHERE kind = 'message' AND k % 2 = 0), f AS (SELECT channel_id, msg_ts AS ts, 'new' AS content FROM log WHERE kind = 'message' AND k % 3 = 0) SELECT * FROM f UNION ALL SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.channel_id = c.channel_id AND f.ts = c.ts)")
def r7_rerender(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = a.channel_log(spark, sf_dir).filter("kind = 'message'")
    part = lambda n, content: m.filter(F.col("k") % n == 0).select("channel_id", F.col("msg_ts").alias("ts"), F.lit(content).alias("content"))
    return ingest.rerender(part(2, "old"), part(3, "new"), ["channel_id", "ts"])


#: Fixed rule: the push that each event of the channel log stands for, by its small number.
_TYPES = ["channel_archive", "channel_unarchive", "channel_rename", "channel_left", "channel_created", "member_joined_channel", "member_left_channel", "im_created", "group_rename", "odd"]


@query(f"""{LOG}, pu AS (SELECT id AS push_id, us, list_extract({_TYPES}, CAST(k % 10 + 1 AS INT)) AS type, CASE WHEN k % 17 <> 0 THEN channel_id END AS c, CASE WHEN k % 13 <> 0 THEN 'U' || k % 3 END AS u, msg_ts AS e FROM log),
st AS (SELECT 'C' || o_custkey AS c, 1704067200000000 + (o_orderkey % 40) * 43200000000 AS valid_us, max(o_orderkey) AS o FROM orders GROUP BY ALL),
j AS (SELECT pu.*, (SELECT arg_max(o, valid_us) FROM st WHERE st.c = pu.c AND valid_us <= pu.us) AS o FROM pu),
x AS (SELECT *, '{{"channel_id":"' || c || '"' AS h, '{{"id":"' || c || '","name":"n' || o || '"' || CASE WHEN o % 3 > 0 THEN ',"topic":"t' || o % 3 || '"' ELSE '' END || '}}' AS info, '{{"channel_id":"' || c || '","user_id":"' || u || '"' || coalesce(',"event_ts":"' || e || '"', '') || '}}' AS m FROM j WHERE c IS NOT NULL)
SELECT push_id, part, 'channel-list' AS stream, kind, payload FROM (
  SELECT push_id, 0 AS part, 'channel_added' AS kind, info AS payload FROM x WHERE o IS NOT NULL AND (type IN ('channel_created', 'im_created') OR type = 'member_joined_channel' AND u = 'U1')
  UNION ALL SELECT push_id, 1, 'channel_member_joined', m FROM x WHERE type = 'member_joined_channel' AND u IS NOT NULL UNION ALL SELECT push_id, 1, 'channel_member_left', m FROM x WHERE type = 'member_left_channel' AND u IS NOT NULL
  UNION ALL SELECT push_id, 2, 'channel_member_changed', h || ',"is_member":false}}' FROM x WHERE type = 'channel_left' OR type = 'member_left_channel' AND u = 'U1'
  UNION ALL SELECT push_id, 0, type || 'd', h || '}}' FROM x WHERE type IN ('channel_archive', 'channel_unarchive')
  UNION ALL SELECT push_id, 0, 'channel_renamed', h || ',"new_name":"n' || o || '"}}' FROM x WHERE type IN ('channel_rename', 'group_rename') AND o IS NOT NULL)""")
def r11_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural pushes with the channels as they were known at each push, one's own joins told from those of others."""
    k = F.col("k")
    types = F.array(*map(F.lit, _TYPES))
    pushes = a.channel_log(spark, sf_dir).select(F.col("id").alias("push_id"), "us", F.get(types, (k % 10).cast("int")).alias("type"), F.when(k % 17 != 0, F.col("channel_id")).alias("channel"), F.when(k % 13 != 0, F.concat(F.lit("U"), k % 3)).alias("user"), F.col("msg_ts").alias("event_ts"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("C"), "o_custkey").alias("channel_id"), (F.lit(1_704_067_200_000_000) + (F.col("o_orderkey") % 40) * 43_200_000_000).alias("valid_us"), "o_orderkey")
    states = o.groupBy("channel_id", "valid_us").agg(F.max("o_orderkey").alias("o"))
    states = states.select("channel_id", "valid_us", F.concat(F.lit("n"), "o").alias("name"), F.when(F.col("o") % 3 > 0, F.concat(F.lit("t"), F.col("o") % 3)).alias("topic"))
    return ingest.structural_events(pushes, states, "U1")
