"""Queries of current state: folds, heads, scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import is_loose_ts, is_valid_ts, micros_ts, ts_clock, ts_day, ts_micros, utc_day
from ..operators import folds, latest
from ..sources import adapter as a
from .registry import query

LOG, CL, UL, RL = "WITH " + a.CHANNEL_LOG_SQL, "WITH " + a.CHANNEL_LIST_SQL, "WITH " + a.USER_LOG_SQL, "WITH " + a.RUN_LOG_SQL
VALID = "regexp_full_match({}, '[1-9][0-9]{{9}}\\.[0-9]{{6}}')"
ACTIVE_SQL = f"""
cand AS (SELECT *, CASE kind WHEN 'message' THEN 0 ELSE 1 END AS prio FROM log WHERE kind IN ('message', 'message_changed') AND {VALID.format("msg_ts")}),
rk AS (SELECT *, row_number() OVER (PARTITION BY stream, msg_ts ORDER BY off DESC, prio DESC) AS rn FROM cand),
act AS (SELECT * FROM rk c WHERE rn = 1
  AND NOT EXISTS (SELECT 1 FROM log e WHERE e.stream = c.stream AND e.kind = 'message_changed' AND e.previous_ts = c.msg_ts AND e.msg_ts IS NOT NULL AND e.previous_ts <> e.msg_ts)
  AND NOT EXISTS (SELECT 1 FROM log d WHERE d.stream = c.stream AND d.kind = 'message_deleted' AND d.deleted_ts = c.msg_ts))
"""


@query(f"{LOG}, {ACTIVE_SQL} SELECT channel_id, strftime(make_timestamp(CAST(left(msg_ts, 10) AS BIGINT) * 1000000), '%Y-%m-%d') AS day, count(*) AS n_active FROM act GROUP BY ALL")
def flagship_active_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active messages per channel and UTC day."""
    us = F.replace("msg_ts", F.lit("."), F.lit("")).cast("bigint")
    return folds.active_messages(a.channel_log(spark, sf_dir)).groupBy("channel_id", utc_day(us).cast("string").alias("day")).agg(F.count("*").alias("n_active"))


@query(f"{LOG}, {ACTIVE_SQL} SELECT stream, channel_id, msg_ts AS ts, CAST(replace(msg_ts, '.', '') AS BIGINT) AS ts_micros, thread_ts, off FROM act")
def f1_active_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.active_messages(a.channel_log(spark, sf_dir)).select("stream", "channel_id", F.col("msg_ts").alias("ts"), ts_micros(F.col("msg_ts")).alias("ts_micros"), "thread_ts", "off")


@query(f"""{LOG}, {ACTIVE_SQL},
p AS (SELECT stream, channel_id, msg_ts AS parent_ts, reply_count, latest_reply, off FROM act WHERE reply_count > 0),
u AS (SELECT * FROM p UNION ALL SELECT stream, channel_id, parent_ts, reply_count, latest_reply, off FROM log l WHERE kind = 'parent_replied' AND EXISTS (SELECT 1 FROM p WHERE p.stream = l.stream AND p.parent_ts = l.parent_ts))
SELECT stream, channel_id, parent_ts, reply_count, latest_reply, off FROM (SELECT *, row_number() OVER (PARTITION BY stream, parent_ts ORDER BY off DESC) AS rn FROM u) WHERE rn = 1""")
def f2_active_thread_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.active_thread_parents(a.channel_log(spark, sf_dir))


_COLS = ("name", "is_member", "is_archived", "num_members")
_FULL = "kind IN ('channel_added', 'channel_info_refreshed')"
_SOURCES = {"name": f"{_FULL} OR kind = 'channel_renamed'", "is_member": f"{_FULL} OR kind = 'channel_member_changed'", "is_archived": f"{_FULL} OR kind IN ('channel_archived', 'channel_unarchived')"}
#: From the rule: the last added, the last refreshed, the last rename that has a name and so on; the greatest offset that has a value wins.
_CHANNELS_SQL = f"""
ck AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel_id, kind ORDER BY off DESC) AS rn FROM cl WHERE kind <> 'channel_member_joined' AND (kind <> 'channel_renamed' OR name IS NOT NULL) AND (kind <> 'channel_member_changed' OR is_member IS NOT NULL)) WHERE rn = 1),
ch AS (SELECT channel_id, {", ".join(f"arg_max({c}, off) FILTER (WHERE ({_SOURCES.get(c, _FULL)}) AND {c} IS NOT NULL) AS {c}, max(off) FILTER (WHERE ({_SOURCES.get(c, _FULL)}) AND {c} IS NOT NULL) AS {c}_off" for c in folds.ALL_COLUMNS)} FROM ck GROUP BY channel_id)
"""


def _replayed_sql(name: str, full: str) -> str:
    """From the rule: the last full row, and over each column the last narrow row behind it that has a value."""
    def later(kinds: str, value: str) -> str:
        return f"(SELECT {value} FROM cl k WHERE k.channel_id = f.channel_id AND k.off > f.off AND k.kind IN ({kinds}) AND {value} IS NOT NULL ORDER BY k.off DESC LIMIT 1)"

    return f"""{name}_f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY off DESC) AS rn FROM cl WHERE kind IN ({full})) WHERE rn = 1),
{name} AS (SELECT channel_id, coalesce({later("'channel_renamed'", "k.name")}, name) AS name, coalesce({later("'channel_member_changed'", "k.is_member")}, is_member, false) AS is_member,
  coalesce({later("'channel_archived', 'channel_unarchived'", "k.kind = 'channel_archived'")}, is_archived, false) AS is_archived, coalesce(is_im, false) AS is_im, coalesce(is_mpim, false) AS is_mpim FROM {name}_f f)"""


@query(f"{CL}, {_CHANNELS_SQL} SELECT * FROM ch")
def f3_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.channels(a.channel_list_log(spark, sf_dir), folds.ALL_COLUMNS, offsets=True)


@query(f"""{UL},
s AS (SELECT user_id, max(off) AS since FROM ul WHERE kind = 'user_added' GROUP BY 1),
t AS (SELECT ul.* FROM ul JOIN s USING (user_id) WHERE off >= since)
SELECT user_id, (SELECT name FROM t x WHERE x.user_id = s.user_id AND kind = 'user_added') AS name,
  (SELECT display FROM t x WHERE x.user_id = s.user_id ORDER BY off DESC LIMIT 1) AS display,
  (SELECT real FROM t x WHERE x.user_id = s.user_id AND kind <> 'user_renamed' ORDER BY off DESC LIMIT 1) AS real FROM s""")
def f4_users_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.users_snapshot(a.user_log(spark, sf_dir))


@query(f"""{UL} SELECT user_id, CASE kind WHEN 'user_renamed' THEN display WHEN 'user_added' THEN coalesce(nullif(display, ''), nullif(real, ''), nullif(name, ''), user_id) ELSE coalesce(nullif(display, ''), nullif(real, ''), user_id) END AS display_name
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY off DESC) AS rn FROM ul) WHERE rn = 1""")
def f4b_users_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.users_client(a.user_log(spark, sf_dir))


@query(f"""{UL}, d AS (SELECT user_id, display, row_number() OVER (PARTITION BY user_id ORDER BY off DESC) AS rn FROM ul), r AS (SELECT user_id, real, row_number() OVER (PARTITION BY user_id ORDER BY off DESC) AS rn FROM ul WHERE kind <> 'user_renamed')
SELECT d.user_id, d.display AS last_display, r.real AS last_real FROM d LEFT JOIN r ON r.user_id = d.user_id AND r.rn = 1 WHERE d.rn = 1 AND d.user_id IN (SELECT user_id FROM ul WHERE kind = 'user_added')""")
def f4c_user_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.user_state(a.user_log(spark, sf_dir))


_SNAPSHOT_SQL = """
ops AS (SELECT stream, msg_ts AS ts, off, 1 AS seq, true AS s FROM log WHERE kind IN ('message', 'message_changed') AND msg_ts IS NOT NULL
  UNION ALL SELECT stream, previous_ts, off, 0, false FROM log WHERE kind = 'message_changed' AND previous_ts IS NOT NULL AND previous_ts IS DISTINCT FROM msg_ts
  UNION ALL SELECT stream, deleted_ts, off, 0, false FROM log WHERE kind = 'message_deleted' AND deleted_ts IS NOT NULL)
"""


@query(f"{LOG}, {_SNAPSHOT_SQL} SELECT stream, ts, off FROM ops o WHERE s AND NOT EXISTS (SELECT 1 FROM ops n WHERE n.stream = o.stream AND n.ts = o.ts AND (n.off > o.off OR (n.off = o.off AND n.seq > o.seq)))")
def f5_snapshot_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.snapshot_messages(a.channel_log(spark, sf_dir))


@query(f"""{CL}, k AS (SELECT channel_id, max(off) AS since FROM cl WHERE kind = 'channel_added' GROUP BY 1),
t AS (SELECT cl.* FROM cl JOIN k USING (channel_id) WHERE off = since OR (off > since AND kind IN ('channel_renamed', 'channel_archived', 'channel_unarchived', 'channel_member_changed')))
SELECT channel_id, {", ".join(f"(SELECT {c} FROM t x WHERE x.channel_id = k.channel_id AND ({c} IS NOT NULL OR kind = 'channel_added') ORDER BY off DESC LIMIT 1) AS {c}" for c in _COLS)} FROM k""")
def f5b_channel_list_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.channel_list_snapshot(a.channel_list_log(spark, sf_dir))


@query(f"{LOG}, {_SNAPSHOT_SQL} SELECT stream, ts FROM (SELECT *, row_number() OVER (PARTITION BY stream, ts ORDER BY off DESC, seq DESC) AS rn FROM ops WHERE regexp_full_match(ts, '[0-9]+\\.[0-9]+')) WHERE rn = 1 AND s")
def f5c_loose_active_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.snapshot_messages(a.channel_log(spark, sf_dir)).filter(is_loose_ts(F.col("ts"))).select("stream", "ts")


@query(f"""{LOG} SELECT stream, msg_ts AS ts, id FROM log c WHERE kind IN ('message', 'message_changed') AND msg_ts IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM log d WHERE d.stream = c.stream AND d.id > c.id AND ((d.kind = 'message_deleted' AND d.deleted_ts = c.msg_ts) OR (d.kind = 'message_changed' AND d.previous_ts <> d.msg_ts AND d.previous_ts = c.msg_ts)))""")
def f5d_active_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.active_candidates(a.channel_log(spark, sf_dir))


def blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator's block list: one customer in nineteen, with a reason for some."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 19 = 0")
    return c.select(F.concat(F.lit("C"), "c_custkey").alias("channel_id"), F.when(F.col("c_custkey") % 2 == 0, "noise").alias("reason"))


BLOCKED_SQL = "bl AS (SELECT 'C' || c_custkey AS channel_id, CASE WHEN c_custkey % 2 = 0 THEN 'noise' END AS reason FROM customer WHERE c_custkey % 19 = 0)"


@query(f"{CL}, {_replayed_sql('ps', "'channel_added', 'channel_info_refreshed'")}, {BLOCKED_SQL} SELECT channel_id FROM ps WHERE NOT is_archived AND (is_member OR is_im OR is_mpim) AND channel_id NOT IN (SELECT channel_id FROM bl)")
def f6_probe_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.probe_scope(a.channel_list_log(spark, sf_dir), blocked(spark, sf_dir))


@query(f"""{RL},
s AS (SELECT channel_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY id DESC) AS rn FROM rl WHERE kind = 'started') WHERE rn = 1)
SELECT s.channel_id, s.run_id, (SELECT outcome FROM rl f WHERE f.kind = 'finished' AND f.channel_id = s.channel_id AND f.run_id = s.run_id ORDER BY id DESC LIMIT 1) AS outcome,
  p.page AS latest_page, p.has_more AS latest_has_more, p.cursor AS latest_cursor
FROM s LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY channel_id, run_id ORDER BY page DESC, id DESC) AS rn FROM rl WHERE kind = 'page') p ON p.channel_id = s.channel_id AND p.run_id = s.run_id AND p.rn = 1""")
def f7_backfill_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.backfill_state(a.run_log(spark, sf_dir))


@query(f"{LOG} SELECT channel_id, max(msg_ts) AS latest_ts FROM log WHERE kind = 'message' GROUP BY 1")
def f8_ingest_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.ingest_head(a.channel_log(spark, sf_dir))


FROM_US, TO_US = 1_704_672_000_000_000, 1_705_881_600_000_000


@query(f"""{LOG}, e AS (SELECT *, coalesce(msg_ts, deleted_ts) AS ts FROM log WHERE kind IN ('message', 'message_changed', 'message_deleted')),
r AS (SELECT * FROM e WHERE CAST(ts AS DECIMAL(20, 6)) >= {FROM_US // 1_000_000} AND CAST(ts AS DECIMAL(20, 6)) < {TO_US // 1_000_000})
SELECT o.stream, o.ts, o.id AS original_id, (SELECT count(*) FROM r x WHERE x.stream = o.stream AND x.ts = o.ts AND kind = 'message_changed') AS n_edits,
  coalesce((SELECT string_agg(us, ',' ORDER BY us) FROM r x WHERE x.stream = o.stream AND x.ts = o.ts AND kind = 'message_changed'), '') AS edit_times,
  (SELECT us FROM r x WHERE x.stream = o.stream AND x.ts = o.ts AND kind = 'message_deleted' ORDER BY id DESC LIMIT 1) AS deleted_us
FROM (SELECT *, row_number() OVER (PARTITION BY stream, ts ORDER BY id) AS rn FROM r WHERE kind = 'message' AND (thread_ts IS NULL OR thread_ts = msg_ts)) o WHERE rn = 1""")
def f10_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.originals(a.channel_log(spark, sf_dir), FROM_US, TO_US)


_BASE_SQL = "base AS (SELECT channel_id, msg_ts AS ts, CAST(1 AS BIGINT) AS n FROM log WHERE kind = 'message' AND k % 2 = 0)"


@query(f"""{LOG}, {_BASE_SQL},
ops AS (SELECT channel_id, ts, 0 AS off, 'set' AS op, n FROM base UNION ALL SELECT channel_id, msg_ts, off, 'set', coalesce(reply_count, 0) FROM log WHERE kind IN ('message', 'message_changed') AND msg_ts IS NOT NULL
  UNION ALL SELECT channel_id, deleted_ts, off, 'del', 0 FROM log WHERE kind = 'message_deleted' AND deleted_ts IS NOT NULL UNION ALL SELECT channel_id, parent_ts, off, 'bump', 1 FROM log WHERE kind = 'parent_replied' AND parent_ts IS NOT NULL),
w AS (SELECT *, max(CASE WHEN op <> 'bump' THEN off END) OVER (PARTITION BY channel_id, ts) AS since FROM ops)
SELECT channel_id, ts, CAST(sum(n) AS BIGINT) AS reply_count FROM w WHERE off >= since AND (op <> 'bump' OR off > since) GROUP BY channel_id, ts HAVING bool_or(op = 'set')""")
def f11_day_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = a.channel_log(spark, sf_dir)
    base = log.filter("kind = 'message' and k % 2 = 0").select("channel_id", F.col("msg_ts").alias("ts"), F.lit(1).alias("reply_count"))
    return folds.day_merge(base, log)


@query(f"{LOG} SELECT stream, off, kind FROM (SELECT *, count(*) OVER (PARTITION BY stream) AS n FROM log) WHERE off > n - 5")
def f13_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.keep_last(a.channel_log(spark, sf_dir), 5).select("stream", "off", "kind")


@query(f"{LOG} SELECT kind, CASE WHEN kind = 'parent_replied' THEN 'reject' ELSE 'apply' END AS route, count(*) AS n FROM log GROUP BY ALL")
def f14_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.dispatch(a.channel_log(spark, sf_dir)).groupBy("kind", "route").agg(F.count("*").alias("n"))


@query(f"""{LOG}, m AS (SELECT * FROM log l WHERE kind IN ('message', 'message_changed') AND msg_ts IS NOT NULL AND NOT EXISTS (SELECT 1 FROM log d WHERE d.kind = 'message_deleted' AND d.channel_id = l.channel_id AND d.deleted_ts = l.msg_ts AND d.off >= l.off))
SELECT channel_id, msg_ts AS ts, coalesce(thread_ts <> msg_ts, false) AS is_reply, off, CAST(coalesce(rc, 0) AS BIGINT) AS reply_count FROM (SELECT *, max(reply_count) OVER w AS rc, row_number() OVER (PARTITION BY channel_id, msg_ts ORDER BY off DESC) AS rn FROM m WINDOW w AS (PARTITION BY channel_id, msg_ts)) WHERE rn = 1""")
def f15_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.chunks(a.channel_log(spark, sf_dir))


_MANUAL_SQL = "mn AS (SELECT 'C' || c_custkey AS channel_id, CASE c_custkey % 3 WHEN 0 THEN 'hot' WHEN 1 THEN 'hidden' ELSE 'blocked' END AS tier FROM customer WHERE c_custkey % 11 = 0)"
TIERS_SQL = f"""{_replayed_sql("cc", "'channel_added'")}, {_MANUAL_SQL}, ti AS (SELECT cc.*, coalesce(mn.tier, CASE WHEN is_archived THEN 'hidden' WHEN is_im OR is_mpim OR is_member THEN 'hot' ELSE 'hidden' END) AS tier FROM cc LEFT JOIN mn USING (channel_id))"""
CHANNELS_SQL = _CHANNELS_SQL


def manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 11 = 0")
    n = F.col("c_custkey") % 3
    return c.select(F.concat(F.lit("C"), "c_custkey").alias("channel_id"), F.when(n == 0, "hot").when(n == 1, "hidden").otherwise("blocked").alias("tier"))


@query(f"{CL}, {TIERS_SQL} SELECT channel_id, tier, tier <> 'blocked' AS subscribed FROM ti")
def f18_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.tiers(a.channel_list_log(spark, sf_dir), manual(spark, sf_dir))


@query(f"""{CL}, {TIERS_SQL}, {BLOCKED_SQL}, cu AS (SELECT channel_id, tier, CASE WHEN tier = 'blocked' AND length(channel_id) % 2 = 0 THEN 'hot' END AS prior FROM ti)
SELECT channel_id, CASE WHEN b THEN 'blocked' WHEN tier <> 'blocked' THEN tier WHEN prior IS NULL THEN 'hidden' ELSE prior END AS tier, CASE WHEN b THEN CASE WHEN prior IS NOT NULL THEN prior WHEN tier <> 'blocked' THEN tier END END AS prior
FROM (SELECT *, channel_id IN (SELECT channel_id FROM bl) AS b FROM cu)""")
def f19_block_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = folds.tiers(a.channel_list_log(spark, sf_dir), manual(spark, sf_dir))
    current = t.select("channel_id", "tier", F.when((F.col("tier") == "blocked") & (F.length("channel_id") % 2 == 0), "hot").alias("prior"))
    return folds.sync_blocks(current, blocked(spark, sf_dir))


@query(f"{LOG} SELECT stream, off, kind, us FROM log WHERE stream = 'channel:C7' AND off > 2 AND off <= 6")
def s1_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.channel_log(spark, sf_dir).filter("stream = 'channel:C7' and off > 2 and off <= 6").orderBy("off").select("stream", "off", "kind", "us")


@query(f"{LOG} SELECT stream, max(off) AS head, count(*) FILTER (WHERE us > {a.NOW_US} - 86400000000) AS last_day FROM log GROUP BY 1")
def q8_stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.channel_log(spark, sf_dir).groupBy("stream").agg(F.max("off").alias("head"), F.count_if(F.col("us") > a.NOW_US - 86_400_000_000).alias("last_day"))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS rn FROM events WHERE event_type = 'click')
SELECT 'C' || user_id AS stream, event_id AS id, CAST(rn + coalesce(h, 0) AS BIGINT) AS offset_in_stream FROM e LEFT JOIN (SELECT user_id, max(event_id) % 50 AS h FROM events WHERE event_type = 'view' GROUP BY 1) USING (user_id)""")
def w5_assign_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("stream", F.concat(F.lit("C"), "user_id")).withColumn("us", a.micros("ts"))
    heads = e.filter("event_type = 'view'").groupBy("stream").agg((F.max("event_id") % 50).alias("offset_in_stream"))
    new = e.filter("event_type = 'click'").select("stream", F.col("event_id").alias("id"), "us")
    return latest.assign_offsets(new, heads, ["us", "id"]).select("stream", "id", F.col("offset_in_stream").cast("bigint"))


@query(f"""{LOG}, x AS (SELECT stream, id, CASE WHEN k % 10 <> 0 THEN parent_ts END AS parent_ts, reply_count FROM log WHERE kind = 'parent_replied')
SELECT stream, id FROM (SELECT *, row_number() OVER (PARTITION BY stream, parent_ts, reply_count ORDER BY id) AS rn FROM x) WHERE rn = 1 OR parent_ts IS NULL OR reply_count IS NULL""")
def r8_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply notices that repeat parent and count fall away; rows with a null in the key never do."""
    log = a.channel_log(spark, sf_dir).filter("kind = 'parent_replied'").withColumn("parent_ts", F.when(F.col("k") % 10 != 0, F.col("parent_ts")))
    return latest.first_wins(log, [F.col("stream"), F.col("parent_ts"), F.col("reply_count")], [F.col("id")]).select("stream", "id")


_MANGLED_SQL = """
mg AS (SELECT event_id, CASE k % 11 WHEN 0 THEN t WHEN 1 THEN '0' || substr(t, 2) WHEN 2 THEN left(t, length(t) - 1) WHEN 3 THEN '1' || t WHEN 4 THEN ' ' || t WHEN 5 THEN t || chr(10) WHEN 6 THEN '' WHEN 7 THEN '1e9' WHEN 8 THEN '-' || t WHEN 9 THEN left(t, 5) || '.5' END AS ts
  FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, (epoch_us(ts) // 1000000) || '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') AS t FROM events))
"""


def mangled_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts): the events' times as text, most of them spoiled in one of ten ways."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), micros_ts(a.micros("ts")).alias("t"))
    t = F.col("t")
    forms = [t, F.concat(F.lit("0"), F.substring(t, 2, 99)), F.left(t, F.length(t) - 1), F.concat(F.lit("1"), t), F.concat(F.lit(" "), t), F.concat(t, F.lit("\n")), F.lit(""), F.lit("1e9"), F.concat(F.lit("-"), t), F.concat(F.left(t, F.lit(5)), F.lit(".5"))]
    return e.select("event_id", F.get(F.array(*forms), (F.col("k") % 11).cast("int")).alias("ts"))


@query(f"""WITH {_MANGLED_SQL} SELECT event_id, ts, regexp_full_match(ts, '[1-9][0-9]{{9}}\\.[0-9]{{6}}') AS strict, regexp_full_match(ts, '[0-9]+\\.[0-9]+') AS loose FROM mg""")
def ts_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mangled_times(spark, sf_dir).select("event_id", "ts", is_valid_ts(F.col("ts")).alias("strict"), is_loose_ts(F.col("ts")).alias("loose"))


@query(f"""WITH {_MANGLED_SQL}, p AS (SELECT *, try_cast(trim(replace(ts, chr(10), '')) AS DOUBLE) AS s FROM mg), v AS (SELECT *, CASE WHEN s BETWEEN -62135596800 AND 253402300799 THEN CAST(floor(s) AS BIGINT) END AS n FROM p),
l AS (SELECT *, timezone('Pacific/Auckland', timezone('UTC', make_timestamp(n * 1000000))) AS lt FROM v)
SELECT event_id, coalesce(strftime(lt, '%H:%M'), ts) AS clock, coalesce(strftime(lt, '%Y-%m-%d'), CASE WHEN ts IS NOT NULL THEN 'unknown' END) AS day FROM l""")
def c6_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock and date of times as they come: one that is no number stays as it is, and its date is unknown."""
    zone = "Pacific/Auckland"
    return mangled_times(spark, sf_dir).select("event_id", ts_clock(F.col("ts"), zone).alias("clock"), ts_day(F.col("ts"), zone).alias("day"))
