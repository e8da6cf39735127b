"""Queries of the client's projection, of health, of walks that resume, of snapshots and refreshes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import completeness, folds, health, ingest, inventory, projection, resume
from ..sources import adapter as a
from .completeness import _EMPTY_SQL, _RESUME_SQL, _SNAPS_SQL, _runs_with_empty, _snaps
from .registry import ORACLES, query
from .state import _SNAPSHOT_SQL, CL, LOG, RL

NOW, DAY = a.NOW_US, 86_400_000_000


def projected_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channel log with the thread that some deletions carry."""
    log = a.channel_log(spark, sf_dir)
    return log.withColumn("previous_thread_ts", F.when((F.col("kind") == "message_deleted") & (F.col("k") % 6 == 1), F.concat(F.substring("deleted_ts", 1, 9), F.lit("0.000000"))).when((F.col("kind") == "message_deleted") & (F.col("k") % 6 == 2), F.col("deleted_ts"))).withColumn(
        "thread_ts", F.when((F.col("kind").isin("message", "message_changed")) & (F.col("k") % 3 == 1), F.concat(F.substring("msg_ts", 1, 9), F.lit("0.000000"))).otherwise(F.col("thread_ts"))
    )


#: The same log, then operations by message time, then replies as they come and go, each from the rule with subqueries.
_PROJECTED_SQL = f"""{LOG},
pl AS (SELECT * REPLACE (CASE WHEN kind IN ('message', 'message_changed') AND k % 3 = 1 THEN left(msg_ts, 9) || '0.000000' ELSE thread_ts END AS thread_ts),
  CASE WHEN kind = 'message_deleted' AND k % 6 = 1 THEN left(deleted_ts, 9) || '0.000000' WHEN kind = 'message_deleted' AND k % 6 = 2 THEN deleted_ts END AS previous_thread_ts FROM log),
wr AS (SELECT channel_id, msg_ts AS ts, off, thread_ts IS NOT NULL AND thread_ts <> msg_ts AS reply, thread_ts, coalesce(reply_count, 0) AS n FROM pl WHERE kind IN ('message', 'message_changed') AND msg_ts IS NOT NULL),
dl AS (SELECT channel_id, deleted_ts AS ts, off, CASE WHEN previous_thread_ts <> deleted_ts THEN previous_thread_ts END AS thread_ts FROM pl WHERE kind = 'message_deleted' AND deleted_ts IS NOT NULL),
lt AS (SELECT d.*, (SELECT max(off) FROM wr w WHERE w.channel_id = d.channel_id AND w.ts = d.ts AND NOT w.reply AND w.off < d.off) AS top, (SELECT max(off) FROM dl e WHERE e.channel_id = d.channel_id AND e.ts = d.ts AND e.thread_ts IS NULL AND e.off < d.off) AS drp FROM dl d),
dt AS (SELECT * FROM lt WHERE thread_ts IS NULL AND top IS NOT NULL AND (drp IS NULL OR top > drp)), dr AS (SELECT * FROM lt WHERE NOT (thread_ts IS NULL AND top IS NOT NULL AND (drp IS NULL OR top > drp))),
rw AS (SELECT channel_id, thread_ts, ts, off FROM wr WHERE reply),
rd AS (SELECT channel_id, thread_ts, ts, off, true AS named FROM dr WHERE thread_ts IS NOT NULL UNION ALL SELECT d.channel_id, t.thread_ts, d.ts, d.off, false FROM dr d JOIN (SELECT DISTINCT channel_id, ts, thread_ts FROM rw) t ON t.channel_id = d.channel_id AND t.ts = d.ts WHERE d.thread_ts IS NULL),
rv AS (SELECT *, true AS w, true AS named FROM rw UNION ALL SELECT channel_id, thread_ts, ts, off, false, named FROM rd),
ch AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY channel_id, thread_ts, ts ORDER BY off), false) AS was FROM rv)"""


@query(f"{_PROJECTED_SQL} SELECT channel_id, thread_ts, ts, off FROM (SELECT *, row_number() OVER (PARTITION BY channel_id, thread_ts, ts ORDER BY off DESC) AS rn FROM rv) WHERE rn = 1 AND w")
def f16_thread_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.thread_rows(projected_log(spark, sf_dir))


@query(f"""{_PROJECTED_SQL},
lf AS (SELECT channel_id, ts, max(off) AS o FROM dt GROUP BY 1, 2),
bn AS (SELECT w.channel_id, w.ts, min(w.off) AS b FROM wr w LEFT JOIN lf USING (channel_id, ts) WHERE NOT w.reply AND w.off > coalesce(lf.o, 0) GROUP BY 1, 2),
rs AS (SELECT b.*, (SELECT max(c.off) FROM ch c WHERE c.channel_id = b.channel_id AND c.thread_ts = b.ts AND c.off > b.b AND NOT c.w AND (c.named OR c.was)) AS r FROM bn b),
kp AS (SELECT channel_id, thread_ts AS ts, off, sum(CASE WHEN w AND NOT was THEN 1 WHEN NOT w AND was THEN -1 ELSE 0 END) OVER (PARTITION BY channel_id, thread_ts ORDER BY off) AS kept FROM ch),
aa AS (SELECT r.channel_id, r.ts, r.r, o.off, o.n FROM rs r JOIN (SELECT channel_id, ts, off, n FROM wr WHERE NOT reply UNION ALL SELECT channel_id, ts, off, 0 FROM kp) o ON o.channel_id = r.channel_id AND o.ts = r.ts WHERE o.off >= coalesce(r.r, r.b))
SELECT channel_id, ts, CAST(max(greatest(coalesce((SELECT arg_max(kept, off) FROM kp WHERE kp.channel_id = aa.channel_id AND kp.ts = aa.ts AND kp.off <= aa.off), 0), CASE WHEN aa.off = aa.r THEN 0 ELSE n END)) AS BIGINT) AS reply_count FROM aa GROUP BY 1, 2""")
def f17_reply_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.reply_counts(projected_log(spark, sf_dir))


@query(f"""{LOG}, b AS (SELECT channel_id, coalesce(thread_ts, msg_ts) AS thread_ts, msg_ts AS ts FROM log WHERE kind = 'message' AND k % 3 = 0), th AS (SELECT DISTINCT channel_id, thread_ts FROM b),
s AS (SELECT channel_id, thread_ts, ts, 0 AS off FROM b UNION ALL SELECT l.channel_id, coalesce(l.thread_ts, l.msg_ts), l.msg_ts, l.off FROM log l JOIN th ON th.channel_id = l.channel_id AND th.thread_ts = coalesce(l.thread_ts, l.msg_ts) WHERE l.kind IN ('message', 'message_changed') AND l.msg_ts IS NOT NULL),
m AS (SELECT channel_id, thread_ts, ts, max(off) AS off FROM s GROUP BY ALL)
SELECT channel_id, thread_ts, ts, off, ts = thread_ts AS is_parent FROM m WHERE ts = thread_ts OR NOT EXISTS (SELECT 1 FROM log d WHERE d.kind = 'message_deleted' AND d.channel_id = m.channel_id AND d.deleted_ts = m.ts AND d.off > m.off)""")
def f12_thread_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = a.channel_log(spark, sf_dir)
    base = log.filter("kind = 'message' and k % 3 = 0").select("channel_id", F.coalesce("thread_ts", "msg_ts").alias("thread_ts"), F.col("msg_ts").alias("ts"))
    return projection.thread_merge(base, log)


@query(f"""{LOG}, b AS (SELECT channel_id, msg_ts AS ts, k % 4 AS reply_count, CASE WHEN k % 2 = 0 THEN msg_ts END AS latest_reply FROM log WHERE kind = 'message'),
e AS (SELECT channel_id, parent_ts AS ts, off, k % 5 - 2 AS delta, CASE WHEN k % 3 > 0 THEN latest_reply END AS lr FROM log WHERE kind = 'parent_replied' AND parent_ts IS NOT NULL),
f AS (SELECT b.*, (SELECT list(delta ORDER BY off) FROM e WHERE e.channel_id = b.channel_id AND e.ts = b.ts) AS ds, (SELECT arg_max(lr, off) FROM e WHERE e.channel_id = b.channel_id AND e.ts = b.ts AND lr IS NOT NULL) AS lr FROM b)
SELECT channel_id, ts, CAST(CASE WHEN ds IS NULL THEN reply_count ELSE list_reduce(list_prepend(reply_count, ds), lambda x, y: greatest(0, x + y)) END AS BIGINT) AS reply_count, coalesce(lr, latest_reply) AS latest_reply FROM f""")
def f11_bumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = a.channel_log(spark, sf_dir)
    k = F.col("k")
    base = log.filter("kind = 'message'").select("channel_id", F.col("msg_ts").alias("ts"), (k % 4).alias("reply_count"), F.when(k % 2 == 0, F.col("msg_ts")).alias("latest_reply"))
    bumps = log.filter("kind = 'parent_replied' and parent_ts is not null").select("channel_id", F.col("parent_ts").alias("ts"), "off", (k % 5 - 2).alias("delta"), F.when(k % 3 > 0, F.col("latest_reply")).alias("latest_reply"))
    return projection.bumped(base, bumps)


HEALTH_SQL = f"""{LOG}, hl AS (SELECT id, CASE WHEN k % 5 = 0 THEN stream ELSE 'slurper-health' END AS stream, us,
  CASE WHEN k % 6 = 0 THEN 'backfill_progress' ELSE CASE kind WHEN 'message' THEN 'slack_healthy' WHEN 'message_changed' THEN 'slack_degraded' WHEN 'message_deleted' THEN 'auth_token_invalid' WHEN 'parent_replied' THEN CASE WHEN k % 2 = 0 THEN 'socket_mode_disconnected' ELSE 'socket_mode_reconnected' END END END AS kind FROM log)"""


def health_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health events beside those of other streams: a kind for each kind of the channel log."""
    k, kind = F.col("k"), F.col("kind")
    is_ = lambda x: kind == x
    name = F.when(k % 6 == 0, "backfill_progress").when(is_("message"), "slack_healthy").when(is_("message_changed"), "slack_degraded").when(is_("message_deleted"), "auth_token_invalid").when(k % 2 == 0, "socket_mode_disconnected").otherwise("socket_mode_reconnected")
    return a.channel_log(spark, sf_dir).select("id", F.when(k % 5 == 0, F.col("stream")).otherwise(health.HEALTH_STREAM).alias("stream"), "us", name.alias("kind"))


@query(f"{HEALTH_SQL} SELECT id, kind, us FROM hl WHERE stream = 'slurper-health'")
def f9_health_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.health_log(health_events(spark, sf_dir)).select("id", "kind", "us")


_STATE_SQL = "CASE kind WHEN 'slack_healthy' THEN 'healthy' WHEN 'socket_mode_reconnected' THEN 'healthy' WHEN 'slack_degraded' THEN 'degraded' WHEN 'socket_mode_disconnected' THEN 'disconnected' WHEN 'auth_token_invalid' THEN 'auth_failed' END"


@query(f"{HEALTH_SQL}, st AS (SELECT id, us, {_STATE_SQL} AS s FROM hl WHERE stream = 'slurper-health') SELECT s AS health, us AS health_us FROM st WHERE s IS NOT NULL ORDER BY id DESC LIMIT 1")
def f20_connection_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.connection_state(health_events(spark, sf_dir))


@query(f"{HEALTH_SQL} SELECT (SELECT max(us) FROM hl) AS last_event_us, (SELECT kind FROM hl WHERE stream = 'slurper-health' ORDER BY id DESC LIMIT 1) AS last_health_kind")
def q9_last_health_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.last_health_kind(health_events(spark, sf_dir))


@query(f"""{HEALTH_SQL}, st AS (SELECT us, {_STATE_SQL} AS s FROM hl WHERE stream = 'slurper-health'), cu AS (SELECT stream, off, us FROM log WHERE k = 3),
p AS (SELECT 1704067200000000 + range * {DAY // 4} AS poll_us FROM range(130)),
x AS (SELECT poll_us, (SELECT arg_max(s, us) FROM st WHERE s IS NOT NULL AND us <= poll_us) AS health, coalesce((SELECT poll_us - max(us) > 1800000000 FROM st WHERE s IS NOT NULL AND us <= poll_us), true) AS frame_stale,
  (SELECT count(DISTINCT stream) FROM cu WHERE us <= poll_us) AS n_caught_up, coalesce((SELECT max(off) FROM cu WHERE us <= poll_us), 0) AS max_offset FROM p)
SELECT *, lag(poll_us) OVER w IS NULL OR (health, frame_stale, n_caught_up, max_offset) IS DISTINCT FROM (lag(health) OVER w, lag(frame_stale) OVER w, lag(n_caught_up) OVER w, lag(max_offset) OVER w) AS changed FROM x WINDOW w AS (ORDER BY poll_us)""")
def q36_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every six hours; a frame is stale after half an hour."""
    polls = spark.range(130).select((F.lit(1_704_067_200_000_000) + F.col("id") * (DAY // 4)).alias("poll_us"))
    caught_up = a.channel_log(spark, sf_dir).filter("k = 3").select("stream", "off", "us")
    return health.signatures(health_events(spark, sf_dir), caught_up, polls, 1_800_000_000)


@query(f"""{LOG}, h AS (SELECT channel_id, max(CAST(replace(msg_ts, '.', '') AS BIGINT)) AS h FROM log WHERE kind = 'message' GROUP BY 1) SELECT l.channel_id, l.k * 20 AS gap_s, coalesce(h, {NOW} - 3600000000) AS from_us FROM log l LEFT JOIN h USING (channel_id) WHERE l.kind = 'message_deleted' AND l.k * 20 > 300""")
def r15_catch_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = a.channel_log(spark, sf_dir)
    gaps = log.filter("kind = 'message_deleted'").select("channel_id", (F.col("k") * 20).alias("gap_s"))
    return health.reconnects_to_catch_up(gaps, completeness.resume_points(log, log.select("channel_id").distinct(), NOW, 3_600_000_000), 300)


_PAGES_SQL = "rp AS (SELECT channel_id, run_id, CASE WHEN id % 11 > 0 THEN 'T' || (messages % 4) END AS thread_ts, page, id, CASE WHEN has_more THEN cursor END AS cursor, NOT has_more AS final FROM rl WHERE kind = 'page')"


def reply_pages(runs: DataFrame) -> DataFrame:
    return runs.filter("kind = 'page'").select("channel_id", "run_id", F.when(F.col("id") % 11 > 0, F.concat(F.lit("T"), F.col("messages") % 4)).alias("thread_ts"), "page", "id", F.when(F.col("has_more"), F.col("cursor")).alias("cursor"), (~F.col("has_more")).alias("final"))


_PROGRESS_SQL = f"""{_RESUME_SQL.format(runs=_EMPTY_SQL)}, {_PAGES_SQL},
pg2 AS (SELECT channel_id, thread_ts, coalesce("cursor", '') AS "cursor", final AS done FROM (SELECT rp.*, row_number() OVER (PARTITION BY rp.channel_id, thread_ts ORDER BY page DESC, id DESC) AS rn FROM rp JOIN an USING (channel_id, run_id) WHERE thread_ts IS NOT NULL) WHERE rn = 1)"""


@query(f"{_PROGRESS_SQL} SELECT * FROM pg2")
def q11_replies_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.replies_progress(_runs_with_empty(spark, sf_dir), reply_pages(a.run_log(spark, sf_dir)))


@query(f"""{_PROGRESS_SQL}, pn AS (SELECT *, CAST(1 AS BIGINT) AS reply_count, 'old' AS latest_reply FROM pg2), dv AS (SELECT channel_id, 'T' || (max(messages) % 6) AS thread_ts, count(*) AS reply_count, 'new' AS latest_reply FROM rl WHERE kind = 'page' GROUP BY 1)
SELECT pn.channel_id, pn.thread_ts, "cursor", CASE WHEN "cursor" = '' AND dv.channel_id IS NOT NULL THEN dv.reply_count ELSE pn.reply_count END AS reply_count, CASE WHEN "cursor" = '' AND dv.channel_id IS NOT NULL THEN dv.latest_reply ELSE pn.latest_reply END AS latest_reply FROM pn LEFT JOIN dv USING (channel_id, thread_ts) WHERE NOT done
UNION ALL SELECT channel_id, thread_ts, '', reply_count, latest_reply FROM dv WHERE NOT EXISTS (SELECT 1 FROM pn WHERE pn.channel_id = dv.channel_id AND pn.thread_ts = dv.thread_ts)""")
def r17_thread_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = q11_replies_progress(spark, sf_dir).withColumn("reply_count", F.lit(1).cast("bigint")).withColumn("latest_reply", F.lit("old"))
    found = a.run_log(spark, sf_dir).filter("kind = 'page'").groupBy("channel_id").agg(F.concat(F.lit("T"), F.max("messages") % 6).alias("thread_ts"), F.count("*").alias("reply_count")).withColumn("latest_reply", F.lit("new"))
    return resume.thread_worklist(plan, found)


@query(f"""{RL}, s AS (SELECT channel_id, run_id, 'B' || (id // 100 % 3) AS boot_id FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY id DESC) AS rn FROM rl WHERE kind = 'started') WHERE rn = 1)
SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM rl f WHERE f.kind = 'finished' AND f.channel_id = s.channel_id AND f.run_id = s.run_id)""")
def q27_in_progress_of_boot(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = a.run_log(spark, sf_dir)
    return resume.in_progress_of_boot(runs.withColumn("boot_id", F.concat(F.lit("B"), F.floor(F.col("id") / 100) % 3)), folds.backfill_state(runs))


@query(f"""{LOG}, {_SNAPSHOT_SQL}, {_SNAPS_SQL}, ln AS (SELECT stream, '{{"off":' || off || ',"ts":"' || ts || '"}}' AS line FROM ops o WHERE s AND NOT EXISTS (SELECT 1 FROM ops n WHERE n.stream = o.stream AND n.ts = o.ts AND (n.off > o.off OR (n.off = o.off AND n.seq > o.seq)))),
hd AS (SELECT stream, max(off) AS at_offset FROM log GROUP BY 1), pv AS (SELECT stream, max(at_off) AS b FROM sn GROUP BY 1), pay AS (SELECT stream, count(*) AS n, '[' || string_agg(line, ',') || ']' AS p FROM ln GROUP BY 1)
SELECT stream, at_offset, coalesce(n, 0) AS n_lines, CAST(coalesce(strlen(p), 2) AS BIGINT) AS payload_bytes, at_offset - coalesce(b, 0) AS events_covered FROM hd LEFT JOIN pv USING (stream) LEFT JOIN pay USING (stream) WHERE at_offset > coalesce(b, 0)""")
def q24_snapshot_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = a.channel_log(spark, sf_dir)
    return resume.snapshot_costs(log, folds.snapshot_messages(log), F.to_json(F.struct("off", "ts")), _snaps(log))


@query(f"""{CL}, fu AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY off DESC) AS rn, row_number() OVER (PARTITION BY channel_id ORDER BY off) AS first FROM cl WHERE kind IN ('channel_added', 'channel_info_refreshed')),
fr AS (SELECT channel_id, name, is_member, topic FROM fu WHERE first = 1 UNION ALL SELECT 'X' || r_regionkey, r_name, true, NULL FROM region)
SELECT fr.* FROM fr LEFT JOIN fu l ON l.channel_id = fr.channel_id AND l.rn = 1 WHERE l.channel_id IS NULL OR fr.name IS DISTINCT FROM l.name OR fr.is_member IS DISTINCT FROM l.is_member OR fr.topic IS DISTINCT FROM l.topic""")
def q29_refreshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What upstream says now: for each channel what its first full row said, and channels that the log does not know."""
    cl, columns = a.channel_list_log(spark, sf_dir), ["name", "is_member", "topic"]
    first = folds.latest_per_key(cl.filter(F.col("kind").isin(*folds.FULL_KINDS)), ["channel_id"], [F.asc("off")]).select("channel_id", *columns)
    new = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.concat(F.lit("X"), "r_regionkey").alias("channel_id"), F.col("r_name").alias("name"), F.lit(True).alias("is_member"), F.lit(None).cast("string").alias("topic"))
    return resume.refreshes_to_write(first.unionByName(new), cl, columns)


_FAMILY_SQL = f"""{LOG}, ex AS (SELECT id, CASE k % 8 WHEN 0 THEN 'channel-list' WHEN 1 THEN 'users' WHEN 2 THEN 'slurper-health' WHEN 3 THEN 'backfill-run:' || channel_id WHEN 4 THEN 'channel-list' ELSE stream END AS stream,
 CASE k % 8 WHEN 0 THEN 'channel_id_changed' WHEN 1 THEN 'user_added' WHEN 2 THEN 'tokens_revoked' WHEN 3 THEN CASE WHEN k % 3 = 0 THEN 'backfill_run_started' ELSE 'backfill_page_committed' END WHEN 4 THEN CASE WHEN k % 3 = 0 THEN 'channel_member_joined' ELSE 'channel_history_changed' END ELSE kind END AS kind,
 CASE WHEN k % 9 > 0 THEN 'a' || (k % 5) END AS a, CASE WHEN k % 7 > 0 THEN 'b' || (us % 3) END AS b, 'c' || (k % 2) AS c, msg_ts FROM log)"""


@query(f"""{_FAMILY_SQL}, fk AS (SELECT *, CASE kind WHEN 'message' THEN [msg_ts] WHEN 'user_added' THEN [a] WHEN 'parent_replied' THEN [a, b] WHEN 'channel_id_changed' THEN [a, b, c] WHEN 'channel_history_changed' THEN [a, b, c, c] WHEN 'channel_member_joined' THEN [a, b, c]
  WHEN 'tokens_revoked' THEN [a] WHEN 'backfill_run_started' THEN [a] WHEN 'backfill_page_committed' THEN [a, b] END AS key FROM ex)
SELECT id, stream, kind FROM (SELECT *, row_number() OVER (PARTITION BY stream, kind, key ORDER BY id) AS rn FROM fk) WHERE rn = 1 OR key IS NULL OR list_contains(list_transform(key, lambda x: x IS NULL), true)""")
def r8_key_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each family of kinds deduplicated by its own key; rows with an absent part of a key are all kept."""
    return ingest.first_of_family(family_events(spark, sf_dir)).select("id", "stream", "kind")


def family_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, stream, kind, payload): events of every family, with repeated and with absent parts of their keys."""
    k = F.col("k")
    which = lambda *x: F.element_at(F.array(*x), (k % 8 + 1).cast("int"))
    list_, own = F.lit("channel-list"), F.col("stream")
    stream = which(list_, F.lit("users"), F.lit("slurper-health"), F.concat(F.lit("backfill-run:"), "channel_id"), list_, own, own, own)
    kind = which(F.lit("channel_id_changed"), F.lit("user_added"), F.lit("tokens_revoked"), F.when(k % 3 == 0, "backfill_run_started").otherwise("backfill_page_committed"), F.when(k % 3 == 0, "channel_member_joined").otherwise("channel_history_changed"), F.col("kind"), F.col("kind"), F.col("kind"))
    x, y, z = F.when(k % 9 > 0, F.concat(F.lit("a"), k % 5)), F.when(k % 7 > 0, F.concat(F.lit("b"), F.col("us") % 3)), F.concat(F.lit("c"), k % 2)
    named = {"ts": F.when(kind == "channel_history_changed", z).otherwise(F.col("msg_ts")), "id": x, "parent_ts": x, "reply_count": y, "old_channel_id": x, "new_channel_id": y, "event_ts": z, "channel_id": x, "latest": y, "user_id": y, "tokens": x, "run_id": x, "page_index": y}
    return a.channel_log(spark, sf_dir).select("id", stream.alias("stream"), kind.alias("kind"), F.struct(*[v.alias(n) for n, v in named.items()]).alias("payload"))


@query(f"""{LOG}, ct AS ({ORACLES["f17_reply_counts"]}),
b AS (SELECT channel_id, msg_ts AS ts, k % 3 AS reply_count, CASE k % 4 WHEN 0 THEN 'text' || chr(10) || chr(10) || '> Thread: 1 reply' || chr(10) WHEN 1 THEN '> Thread: 12 replies' || chr(10) || 'more text' || chr(10) WHEN 2 THEN 'text ' || chr(10) || chr(10) ELSE '' END AS block FROM log WHERE kind = 'message'),
j AS (SELECT b.*, ct.reply_count AS n, '> Thread: ' || ct.reply_count || CASE WHEN ct.reply_count = 1 THEN ' reply' ELSE ' replies' END AS line FROM b LEFT JOIN ct USING (channel_id, ts)),
nw AS (SELECT *, CASE WHEN n IS NULL THEN block WHEN n <= 0 THEN regexp_replace(regexp_replace(block, '> Thread: \\d+ repl(y|ies)', '', 'g'), '\\s+$', '') || chr(10)
  WHEN block LIKE '%> Thread: %' THEN regexp_replace(block, '> Thread: \\d+ repl(y|ies)', line, 'g') ELSE regexp_replace(block, '\\s+$', '') || chr(10) || chr(10) || line || chr(10) END AS new FROM j)
SELECT channel_id, ts, new AS block, CAST(coalesce(n, reply_count) AS BIGINT) AS reply_count, new <> block OR coalesce(n, reply_count) <> reply_count AS changed FROM nw""")
def f17_thread_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, as they were rendered once, whose line about replies is changed, added or taken out by the replies counted."""
    k = F.col("k")
    text = F.when(k % 4 == 0, "text\n\n> Thread: 1 reply\n").when(k % 4 == 1, "> Thread: 12 replies\nmore text\n").when(k % 4 == 2, "text \n\n").otherwise("")
    blocks = a.channel_log(spark, sf_dir).filter("kind = 'message'").select("channel_id", F.col("msg_ts").alias("ts"), text.alias("block"), (k % 3).alias("reply_count"))
    return projection.thread_blocks(blocks, projection.reply_counts(projected_log(spark, sf_dir)))


@query(f"""{RL.replace("WITH", "WITH RECURSIVE", 1)},
p AS (SELECT channel_id, run_id, page, id, messages AS n, sum(messages) OVER (PARTITION BY channel_id, run_id ORDER BY page, id) AS s FROM rl WHERE kind = 'page'),
ab AS (SELECT *, row_number() OVER (PARTITION BY channel_id, run_id ORDER BY page, id) AS rn FROM p WHERE s > 150),
wr AS (SELECT *, row_number() OVER (PARTITION BY channel_id, run_id ORDER BY page, id) AS rn FROM p WHERE s <= 150 AND s >= 60),
nx AS (SELECT a.channel_id, a.run_id, a.s AS last, min(b.s) AS s FROM (SELECT channel_id, run_id, s FROM p WHERE s <= 150 UNION ALL SELECT DISTINCT channel_id, run_id, 0 FROM p) a JOIN p b ON b.channel_id = a.channel_id AND b.run_id = a.run_id AND b.s <= 150 AND b.s >= a.s + 40 GROUP BY ALL),
pr AS (SELECT channel_id, run_id, s FROM nx WHERE last = 0 UNION ALL SELECT nx.channel_id, nx.run_id, nx.s FROM pr JOIN nx ON nx.channel_id = pr.channel_id AND nx.run_id = pr.run_id AND nx.last = pr.s)
SELECT channel_id, run_id, page, 'aborted' AS mark, CAST(s - n AS BIGINT) AS messages FROM ab WHERE rn = 1 UNION ALL SELECT channel_id, run_id, page, 'warn_large', CAST(s AS BIGINT) FROM wr WHERE rn = 1
UNION ALL SELECT pr.channel_id, pr.run_id, (SELECT min(page) FROM p WHERE p.channel_id = pr.channel_id AND p.run_id = pr.run_id AND p.s = pr.s), 'progress', CAST(pr.s AS BIGINT) FROM pr""")
def r16_walk_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.walk_marks(a.run_log(spark, sf_dir), 60, 40, 150)
