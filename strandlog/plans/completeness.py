"""Queries about what is missing, late or due."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import completeness as c
from ..operators import folds, inventory, queues
from ..operators.latest import as_of
from ..sources import adapter as a
from .registry import ORACLES, query
from .state import ACTIVE_SQL, BLOCKED_SQL, CHANNELS_SQL, CL, LOG, RL, TIERS_SQL, blocked, manual

NOW, DAY = a.NOW_US, 86_400_000_000
SM = f"{LOG}, {a.SAMPLES_SQL}"


def _samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    log = a.channel_log(spark, sf_dir)
    return log, a.samples(log)


@query(f"""{SM}, s AS (SELECT *, row_number() OVER (PARTITION BY channel_id, day_us ORDER BY sampled_us DESC, id DESC) AS rn FROM sm)
SELECT channel_id, strftime(make_timestamp(day_us), '%Y-%m-%d') AS day, sample_ts, sampled_us, 'day_presence' AS gap_type FROM s WHERE rn = 1 AND sample_ts IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM log m WHERE m.channel_id = s.channel_id AND m.kind = 'message' AND m.msg_ts = s.sample_ts AND NOT EXISTS (SELECT 1 FROM log d WHERE d.channel_id = m.channel_id AND d.kind = 'message_deleted' AND d.deleted_ts = m.msg_ts))""")
def q1_day_presence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, samples = _samples(spark, sf_dir)
    return c.day_presence_gaps(log, samples)


def _sweeps(spark: SparkSession) -> DataFrame:
    """A sweep every day of January, an hour long, begun at six."""
    day = F.lit(1_704_067_200_000_000) + F.col("id") * DAY
    return spark.range(28).select("id", (day + 6 * queues.HOUR_US).alias("started_us"), (day + 30 * queues.HOUR_US).alias("ended_us"))


@query(f"""{SM}, sw AS (SELECT range AS id, 1704067200000000 + range * {DAY} + 6 * 3600000000 AS s, 1704067200000000 + range * {DAY} + 30 * 3600000000 AS e FROM range(28)), l AS (SELECT * FROM sw ORDER BY e DESC, id DESC LIMIT 1)
SELECT e AS last_sweep_us, CAST(({NOW} - e) // 1000000 AS BIGINT) AS age_seconds, count(DISTINCT channel_id) AS channels_covered, count(DISTINCT day_us) AS days_covered FROM l LEFT JOIN sm ON sampled_us BETWEEN s AND e GROUP BY e""")
def q2_probe_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.probe_status(_sweeps(spark), _samples(spark, sf_dir)[1], NOW)


_WIN_SQL = "rw AS (SELECT *, CASE WHEN id % 7 = 0 THEN 'x' ELSE CAST(id AS VARCHAR) || '.5' END AS oldest, CAST(id + 10 AS VARCHAR) AS latest FROM rl), aw AS (SELECT channel_id, CAST(id AS DOUBLE) + 0.5 AS oldest, CAST(id + 10 AS DOUBLE) AS latest FROM rl WHERE kind = 'started')"


@query(f"""{RL}, {_WIN_SQL} SELECT channel_id, oldest, latest, EXISTS (SELECT 1 FROM rw s WHERE s.kind = 'started' AND s.channel_id = aw.channel_id AND abs(try_cast(s.oldest AS DOUBLE) - aw.oldest) < 0.000001 AND abs(try_cast(s.latest AS DOUBLE) - aw.latest) < 0.000001
  AND NOT EXISTS (SELECT 1 FROM rw f WHERE f.kind = 'finished' AND f.channel_id = s.channel_id AND f.run_id = s.run_id)) AS in_flight FROM aw""")
def q3_refill_in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = a.run_log(spark, sf_dir).withColumn("oldest", F.when(F.col("id") % 7 == 0, "x").otherwise(F.concat("id", F.lit(".5")))).withColumn("latest", (F.col("id") + 10).cast("string"))
    asked = runs.filter("kind = 'started'").select("channel_id", (F.col("id").cast("double") + 0.5).alias("oldest"), (F.col("id") + 10).cast("double").alias("latest"))
    return c.refill_in_flight(runs, asked)


_DAYS_SQL = f"""cr AS (SELECT 'C' || c_custkey AS channel_id, 19723 + c_custkey % 12 AS d FROM customer WHERE c_custkey % 2 = 0),
dy AS (SELECT DISTINCT channel_id, us // {DAY} AS d FROM log WHERE kind = 'message'), dz AS (SELECT * FROM dy UNION SELECT * FROM cr WHERE channel_id IN (SELECT channel_id FROM dy)),
gp AS (SELECT z.channel_id, z.d + 1 AS a, (SELECT min(n.d) FROM dz n WHERE n.channel_id = z.channel_id AND n.d > z.d) - 1 AS b FROM dz z)"""
_DATE = "strftime(make_timestamp({} * 86400000000), '%Y-%m-%d')"


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    created = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 2 = 0").select(F.concat(F.lit("C"), "c_custkey").alias("channel_id"), F.date_from_unix_date((19723 + F.col("c_custkey") % 12).cast("int")).alias("day"))
    return c.gaps(a.channel_log(spark, sf_dir), created)


@query(f"{LOG}, {_DAYS_SQL} SELECT channel_id, {_DATE.format('a')} AS first_missing, {_DATE.format('b')} AS last_missing, b - a + 1 AS n_missing FROM gp WHERE b >= a")
def q4_bounded_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir).select("channel_id", F.col("first_missing").cast("string").alias("first_missing"), F.col("last_missing").cast("string").alias("last_missing"), "n_missing")


@query(f"{LOG}, {_DAYS_SQL}, p AS (SELECT channel_id, count(*) AS n_ranges, CAST(sum(b - a + 1) AS BIGINT) AS n_missing FROM gp WHERE b >= a GROUP BY 1) SELECT *, row_number() OVER (ORDER BY n_missing DESC, channel_id) AS rank FROM p")
def q5_gaps_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.gaps_ranked(_gaps(spark, sf_dir))


_TOTALS_SQL = f"""co AS (SELECT channel_id, count(*) AS ingested FROM log WHERE kind = 'message' GROUP BY 1),
tt AS (SELECT 'C' || c_custkey AS channel_id, CASE c_custkey % 7 WHEN 0 THEN 0 WHEN 1 THEN n WHEN 2 THEN n * 2 WHEN 3 THEN n + n // 50 WHEN 4 THEN 1000 ELSE n + 1 END AS total, CASE c_custkey % 13 WHEN 5 THEN 'error' WHEN 6 THEN 'unavailable' ELSE 'ok' END AS refresh_status
  FROM (SELECT c_custkey, coalesce(ingested, 0) AS n FROM customer LEFT JOIN co ON channel_id = 'C' || c_custkey) WHERE c_custkey % 5 <> 4)"""


def totals(spark: SparkSession, sf_dir: str, counts: DataFrame) -> DataFrame:
    k, n = F.col("c_custkey"), F.coalesce("ingested", F.lit(0))
    cust = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 5 <> 4").select("c_custkey", F.concat(F.lit("C"), "c_custkey").alias("channel_id")).join(counts, "channel_id", "left")
    total = F.when(k % 7 == 0, 0).when(k % 7 == 1, n).when(k % 7 == 2, n * 2).when(k % 7 == 3, n + F.floor(n / 50)).when(k % 7 == 4, 1000).otherwise(n + 1)
    return cust.select("channel_id", total.cast("bigint").alias("total"), F.when(k % 13 == 5, "error").when(k % 13 == 6, "unavailable").otherwise("ok").alias("refresh_status"))


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = a.channel_log(spark, sf_dir).filter("kind = 'message'").groupBy("channel_id").agg(F.count("*").alias("ingested"))
    return inventory.channel_stats(a.channel_list_log(spark, sf_dir), counts, totals(spark, sf_dir, counts), blocked(spark, sf_dir))


_STATS_SQL = f"""{LOG}, {a.CHANNEL_LIST_SQL}, {CHANNELS_SQL}, {BLOCKED_SQL}, {_TOTALS_SQL},
cd AS (SELECT channel_id, arg_max(off, off) AS off FROM cl WHERE kind IN ('channel_added', 'channel_info_refreshed') GROUP BY 1), ce AS (SELECT cd.channel_id, cl.created FROM cd JOIN cl ON cl.channel_id = cd.channel_id AND cl.off = cd.off),
st AS (SELECT ch.channel_id, coalesce(ch.name, ch.channel_id) AS name, total, coalesce(ingested, 0) AS ingested, coalesce(ch.is_member, false) AS is_member, coalesce(is_archived, false) AS is_archived, bl.channel_id IS NOT NULL AS is_blocked,
  strftime(make_timestamp(created // 86400 * 86400000000), '%Y-%m-%d') AS created, coalesce(refresh_status, 'unavailable') AS refresh_status
  FROM ch LEFT JOIN ce USING (channel_id) LEFT JOIN tt USING (channel_id) LEFT JOIN co USING (channel_id) LEFT JOIN bl USING (channel_id)),
sx AS (SELECT *, CASE WHEN is_blocked THEN 'blocked' WHEN total IS NULL OR refresh_status IN ('error', 'unavailable') THEN 'unavailable' WHEN total = 0 OR ingested * 100 >= total * 99 THEN 'done' WHEN ingested = 0 AND NOT is_member THEN 'not_joined' WHEN ingested = 0 THEN 'not_started' ELSE 'in_progress' END AS status FROM st)"""


@query(f"{_STATS_SQL} SELECT * FROM sx")
def q6_channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir)


@query(f"{_STATS_SQL} SELECT status, count(*) AS n, CAST(sum(total) AS BIGINT) AS total, CAST(sum(ingested) AS BIGINT) AS ingested FROM sx GROUP BY 1")
def q6_workspace_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.sum("total").alias("total"), F.sum("ingested").alias("ingested"))


@query(f"{_STATS_SQL} SELECT channel_id, '| ' || replace(name, '|', chr(92) || '|') || ' | ' || coalesce(format('{{:,}}', total), '—') || ' | ' || format('{{:,}}', ingested) || ' | ' || status || ' | ' || coalesce(created, '—') || ' |' AS line FROM sx")
def c15_inventory_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.inventory_line(_stats(spark, sf_dir))


@query(f"""{RL}, l AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY id DESC) AS rn FROM rl), o AS (SELECT 'C' || c_custkey AS channel_id FROM customer WHERE c_custkey % 19 = 0)
SELECT l.channel_id, CASE WHEN kind = 'page' THEN messages ELSE 0 END AS messages_so_far, o.channel_id IS NOT NULL AS first FROM l LEFT JOIN o USING (channel_id) WHERE rn = 1 AND kind IN ('started', 'page')""")
def q10_in_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels whose latest event is a start or a page; those that an operator marked come first."""
    return inventory.in_progress(a.run_log(spark, sf_dir), blocked(spark, sf_dir))


@query(f"{LOG}, s AS (SELECT channel_id, id, CASE WHEN k % 3 > 0 THEN us END AS latest, CASE WHEN k % 3 = 2 THEN us END AS oldest, us FROM log WHERE kind = 'message') SELECT channel_id, CASE WHEN latest IS NULL THEN 'newest' WHEN oldest IS NULL THEN 'older' ELSE 'between' END AS probe, max(us) AS sampled_us FROM s WHERE oldest IS NULL OR latest IS NOT NULL GROUP BY ALL")
def p8_probe_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples told apart by which bounds their call had, the latest of each."""
    k = F.col("k")
    bound = lambda c: F.when(c, F.col("us"))
    call = F.to_json(F.struct(bound(k % 3 > 0).alias("latest"), bound(k % 3 == 2).alias("oldest")))
    s = a.channel_log(spark, sf_dir).filter("kind = 'message'").select("channel_id", "us", call.alias("call"))
    return s.withColumn("probe", c.probe_kind(F.col("call"))).filter("probe is not null").groupBy("channel_id", "probe").agg(F.max("us").alias("sampled_us"))


@query(f"{LOG} SELECT max(us) AS last_event_us, arg_max(kind, CAST(us AS HUGEINT) * 1000000 + id) AS last_kind FROM log")
def q9_last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.channel_log(spark, sf_dir).agg(F.max("us").alias("last_event_us"), F.max_by("kind", F.struct("us", "id")).alias("last_kind"))


@query(f"""{RL}, l AS (SELECT channel_id, kind = 'started' AS in_progress FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY id DESC) AS rn FROM rl WHERE kind <> 'page') WHERE rn = 1)
SELECT channel_id, count(*) FILTER (WHERE outcome = 'completed') AS n_completed, count(*) FILTER (WHERE outcome = 'aborted') AS n_aborted, any_value(in_progress) AS in_progress FROM rl JOIN l USING (channel_id) GROUP BY 1""")
def q10_backfill_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.backfill_metrics(a.run_log(spark, sf_dir))


_RESUME_SQL = f"""{RL}, full_started AS (SELECT s.channel_id, s.run_id, s.id, EXISTS (SELECT 1 FROM rl p WHERE p.kind = 'page' AND p.channel_id = s.channel_id AND p.run_id = s.run_id) AS p,
  EXISTS (SELECT 1 FROM rl f WHERE f.kind = 'finished' AND f.channel_id = s.channel_id AND f.run_id = s.run_id) AS e FROM {{runs}} s WHERE s.kind = 'started' AND NOT coalesce(s.bounded, false)),
nw AS (SELECT * FROM full_started x WHERE NOT EXISTS (SELECT 1 FROM full_started y WHERE y.channel_id = x.channel_id AND y.id > x.id)),
an AS (SELECT channel_id, run_id FROM nw WHERE p AND NOT e
  UNION ALL SELECT channel_id, arg_max(run_id, id) FROM full_started x WHERE p AND NOT e AND EXISTS (SELECT 1 FROM nw WHERE nw.channel_id = x.channel_id AND NOT nw.p AND NOT nw.e AND nw.id > x.id)
    AND x.id > coalesce((SELECT max(id) FROM rl f WHERE f.kind = 'finished' AND f.channel_id = x.channel_id), 0) GROUP BY channel_id)"""
_EMPTY_SQL = "(SELECT * FROM rl UNION ALL SELECT channel_id, run_id || 'x', id + 1, kind, NULL, NULL, NULL, NULL, NULL, false FROM rl WHERE kind = 'started' AND id % 400 = 0)"


def _runs_with_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some runs are followed by one that has no page yet."""
    runs = a.run_log(spark, sf_dir)
    more = runs.filter("kind = 'started' and id % 400 = 0").withColumn("run_id", F.concat("run_id", F.lit("x"))).withColumn("id", F.col("id") + 1).withColumn("bounded", F.lit(False))
    return runs.unionByName(more)


@query(f"{_RESUME_SQL.format(runs=_EMPTY_SQL)}, pp AS (SELECT *, row_number() OVER (PARTITION BY channel_id, run_id ORDER BY page DESC, id DESC) AS rn FROM rl WHERE kind = 'page') SELECT an.channel_id, an.run_id, NOT has_more OR coalesce(pp.cursor, '') = '' AS history_done, CASE WHEN NOT has_more OR coalesce(pp.cursor, '') = '' THEN '' ELSE pp.cursor END AS history_cursor FROM an JOIN pp ON pp.channel_id = an.channel_id AND pp.run_id = an.run_id AND pp.rn = 1")
def q11_resume_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.resume_plan(_runs_with_empty(spark, sf_dir))


@query(f"""{LOG}, {ACTIVE_SQL}, rp AS (SELECT channel_id, thread_ts, count(DISTINCT msg_ts) AS n, max(msg_ts) AS m FROM act WHERE thread_ts IS NOT NULL AND thread_ts <> msg_ts GROUP BY ALL)
SELECT rp.channel_id, rp.thread_ts FROM rp JOIN (SELECT channel_id, thread_ts, count(*) AS n, max(msg_ts) AS m FROM log WHERE kind = 'message' AND thread_ts IS NOT NULL GROUP BY ALL) u ON u.channel_id = rp.channel_id AND u.thread_ts = rp.thread_ts AND u.n = rp.n AND u.m = rp.m""")
def q12_caught_up_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = a.channel_log(spark, sf_dir)
    upstream = log.filter("kind = 'message' and thread_ts is not null").groupBy("channel_id", "thread_ts").agg(F.count("*").alias("reply_count"), F.max("msg_ts").alias("latest_reply"))
    return c.caught_up_threads(folds.active_messages(log), upstream)


_INBOX_SQL = f"WITH {a.CHANNEL_LOG_SQL}, ib AS (SELECT id AS event_id, us AS received_us, k % 13 AS attempts, CASE WHEN k % 3 = 0 THEN us + 1000000 END AS processed_us, CASE WHEN k % 13 >= 12 AND k % 3 <> 0 THEN us + 5000000 END AS dead_us, us + k * 36000000000 AS next_us FROM log)"


def inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, us = F.col("k"), F.col("us")
    return a.channel_log(spark, sf_dir).select(F.col("id").alias("event_id"), us.alias("received_us"), (k % 13).alias("attempts"), F.when(k % 3 == 0, us + 1_000_000).alias("processed_us"), F.when((k % 13 >= 12) & (k % 3 != 0), us + 5_000_000).alias("dead_us"), (us + k * 36_000_000_000).alias("next_us"))


@query(f"{_INBOX_SQL} SELECT event_id, received_us FROM ib WHERE processed_us IS NULL AND dead_us IS NULL AND next_us <= {NOW}")
def q13_inbox_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.pending(inbox(spark, sf_dir), NOW).select("event_id", "received_us")


@query(f"{_INBOX_SQL} SELECT event_id FROM ib WHERE processed_us < {NOW} - 48 * 3600000000 AND dead_us IS NULL")
def q14_inbox_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.expired(inbox(spark, sf_dir), NOW).select("event_id")


@query(f"{_INBOX_SQL} SELECT count(*) AS n_pending, CAST(greatest(0, ({NOW} - min(received_us)) // 1000000) AS BIGINT) AS oldest_age_s FROM ib WHERE processed_us IS NULL AND dead_us IS NULL")
def q15_inbox_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.depth(inbox(spark, sf_dir), NOW)


@query(f"{_INBOX_SQL} SELECT event_id, CASE WHEN processed_us IS NOT NULL THEN 'done' WHEN attempts >= 12 THEN 'dead' ELSE 'waiting' END AS state, CASE WHEN processed_us IS NULL AND attempts < 12 THEN CAST(2 * 2 ** least(attempts, 8) AS BIGINT) END AS wait_s FROM ib")
def r18_attempt_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.attempt_state(inbox(spark, sf_dir))


@query(f"""{_INBOX_SQL}, ar AS (SELECT DISTINCT id + (CASE WHEN k % 2 = 0 THEN 0 ELSE 1000000 END) AS event_id FROM log WHERE k % 5 = 0),
q AS (SELECT * FROM ib UNION ALL SELECT event_id, {NOW}, 0, NULL, NULL, {NOW} FROM ar WHERE event_id NOT IN (SELECT event_id FROM ib)), t AS (SELECT *, processed_us IS NULL AND dead_us IS NULL AND next_us <= {NOW} AND event_id % 4 < 2 AS tried, event_id % 4 = 0 AS ok FROM q)
SELECT event_id, attempts + CASE WHEN tried AND NOT ok THEN 1 ELSE 0 END AS attempts, CASE WHEN tried AND ok THEN {NOW} ELSE processed_us END AS processed_us, CASE WHEN tried AND NOT ok AND attempts + 1 >= 12 THEN {NOW} ELSE dead_us END AS dead_us,
  CASE WHEN tried AND NOT ok AND attempts + 1 < 12 THEN {NOW} + CAST(2 * 2 ** least(attempts + 1, 8) AS BIGINT) * 1000000 ELSE next_us END AS next_us FROM t""")
def s9_queue_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals, some of them known, are queued; half of what is due is tried, half of that fails."""
    log = a.channel_log(spark, sf_dir)
    arrivals = log.filter("k % 5 = 0").select((F.col("id") + F.when(F.col("k") % 2 == 0, 0).otherwise(1_000_000)).alias("event_id"))
    q = queues.enqueue(inbox(spark, sf_dir), arrivals, NOW)
    outcomes = q.filter("event_id % 4 < 2").select("event_id", (F.col("event_id") % 4 == 0).alias("ok"))
    return queues.settle(q, outcomes, NOW).select("event_id", "attempts", "processed_us", "dead_us", "next_us")


@query(f"{SM}, x AS (SELECT *, sample_ts AS latest_ts, id % 4 AS n_messages, row_number() OVER (PARTITION BY channel_id ORDER BY sampled_us DESC, id DESC) AS rn FROM sm WHERE sample_ts IS NOT NULL) SELECT channel_id, latest_ts, n_messages, sampled_us FROM x WHERE rn = 1 AND n_messages > 0")
def q16_older_not_walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(spark, sf_dir)[1].withColumn("latest_ts", F.col("sample_ts")).withColumn("n_messages", F.col("id") % 4)
    return c.older_not_walked(s).select("channel_id", "latest_ts", "n_messages", "sampled_us")


_SHIFTED = "(u2 // 1000000) || '.' || lpad(CAST(u2 % 1000000 AS VARCHAR), 6, '0')"


@query(f"""{SM}, h0 AS (SELECT channel_id, CAST(replace(sample_ts, '.', '') AS BIGINT) + (id % 3) * 200000000 AS u2, sampled_us, row_number() OVER (PARTITION BY channel_id ORDER BY sampled_us DESC, id DESC) AS rn FROM sm WHERE sample_ts IS NOT NULL), h AS (SELECT *, {_SHIFTED} AS sample_ts FROM h0 WHERE rn = 1),
ca AS (SELECT id, channel_id, msg_ts AS ts FROM log WHERE kind IN ('message', 'message_changed') AND msg_ts IS NOT NULL), loc AS (SELECT channel_id, max(CAST(replace(ts, '.', '') AS BIGINT)) AS m FROM ca x WHERE NOT EXISTS (SELECT 1 FROM log d WHERE d.channel_id = x.channel_id AND d.id > x.id AND (d.deleted_ts = x.ts OR (d.previous_ts = x.ts AND d.msg_ts <> x.ts))) GROUP BY 1)
SELECT h.channel_id, sample_ts, u2 - m AS delta_us, sampled_us FROM h LEFT JOIN loc USING (channel_id) WHERE m IS NULL OR u2 - m > 300000000""")
def q17_newest_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, s = _samples(spark, sf_dir)
    shifted = s.filter("sample_ts is not null").withColumn("sample_ts", a.micros_ts(F.replace("sample_ts", F.lit("."), F.lit("")).cast("bigint") + (F.col("id") % 3) * 200_000_000))
    return c.newest_drift(log, shifted)


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of channels as rows (id, sampled_us, item): one for each day, of the channels with a message that day."""
    log = a.channel_log(spark, sf_dir).filter("kind = 'message'").select(F.floor(F.col("us") / DAY).alias("id"), "us", F.col("channel_id").alias("item"))
    return log.select("id", "item").distinct().join(log.groupBy("id").agg(F.max("us").alias("sampled_us")), "id")


_LISTED_SQL = f"ls AS (SELECT us // {DAY} AS id, max(us) AS sampled_us, list(DISTINCT channel_id) AS ids FROM log WHERE kind = 'message' GROUP BY 1), ll AS (SELECT * FROM ls ORDER BY sampled_us DESC LIMIT 1)"


@query(f"{LOG}, {_LISTED_SQL} SELECT DISTINCT channel_id FROM (SELECT unnest(ids) AS channel_id FROM ll) WHERE channel_id NOT IN (SELECT 'C' || o_custkey FROM orders WHERE o_custkey % 3 = 0)")
def q18_missing_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_custkey % 3 = 0").select(F.concat(F.lit("C"), "o_custkey").alias("channel_id"))
    return c.missing_ids(_listed(spark, sf_dir), known, "channel_id")


#: From the rule: the last full row, the last change of membership and the last of archival, in no order among each other.
_SCOPE_SQL = """
fu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY off DESC) AS rn FROM cl WHERE kind IN ('channel_added', 'channel_info_refreshed')) WHERE rn = 1),
mc AS (SELECT * FROM (SELECT channel_id, is_member AS m, row_number() OVER (PARTITION BY channel_id ORDER BY off DESC) AS rn FROM cl WHERE kind = 'channel_member_changed') WHERE rn = 1),
ac AS (SELECT * FROM (SELECT channel_id, kind = 'channel_archived' AS a, row_number() OVER (PARTITION BY channel_id ORDER BY off DESC) AS rn FROM cl WHERE kind IN ('channel_archived', 'channel_unarchived')) WHERE rn = 1),
sc AS (SELECT fu.channel_id FROM fu LEFT JOIN mc USING (channel_id) LEFT JOIN ac USING (channel_id) WHERE NOT coalesce(ac.a, fu.is_archived, false) AND (coalesce(mc.m, fu.is_member, false) OR coalesce(fu.is_im, false) OR coalesce(fu.is_mpim, false)))"""


@query(f"{LOG}, {a.CHANNEL_LIST_SQL}, {_SCOPE_SQL}, {_LISTED_SQL} SELECT channel_id FROM sc WHERE channel_id NOT IN (SELECT unnest(ids) FROM ll)")
def q19_absent_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.absent_upstream(folds.current_scope(a.channel_list_log(spark, sf_dir)), _listed(spark, sf_dir), "channel_id")


@query(f"{LOG}, {_LISTED_SQL} SELECT DISTINCT user_id FROM (SELECT unnest(ids) AS user_id FROM ll) WHERE user_id NOT IN (SELECT 'C' || c_custkey FROM customer WHERE c_custkey % 4 <> 0)")
def q20_missing_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 4 <> 0").select(F.concat(F.lit("C"), "c_custkey").alias("user_id"))
    return c.missing_ids(_listed(spark, sf_dir), known, "user_id")


@query(f"{LOG}, {_LISTED_SQL} SELECT {_DATE.format('id')} AS day, CAST(len(ids) AS BIGINT) AS n, CAST(len(ids) - lag(len(ids)) OVER (ORDER BY id) AS BIGINT) AS delta FROM ls")
def q21_daily_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.daily_drift(_listed(spark, sf_dir)).select(F.col("day").cast("string").alias("day"), "n", "delta")


@query(f"""WITH s AS (SELECT day, max(us) AS ended_us FROM (SELECT CAST(ts AS DATE) AS day, epoch_us(ts) AS us FROM events WHERE event_type <> 'error') WHERE us < {NOW} - 2 * {DAY} GROUP BY day)
SELECT max(ended_us) AS last_us FROM s HAVING max(ended_us) IS NULL OR max(ended_us) < {NOW} - 86400000000""")
def q22_sweep_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sweep for each day of events, up to two days ago: one row, as the last is too old."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type <> 'error'").select(a.micros("ts").alias("us")).filter(F.col("us") < NOW - 2 * DAY)
    sweeps = e.groupBy(F.floor(F.col("us") / DAY).alias("day")).agg(F.max("us").alias("ended_us"))
    return c.sweep_alert(sweeps, NOW, 86_400)


_SNAPS_SQL = "sn AS (SELECT stream, off AS at_off, us AS at_us FROM log WHERE k = 3)"


def _snaps(log: DataFrame) -> DataFrame:
    return log.filter("k = 3").select("stream", F.col("off").alias("at_off"), F.col("us").alias("at_us"))


@query(f"""{LOG}, {_SNAPS_SQL}, la AS (SELECT stream, max(at_off) AS at_off, arg_max(at_us, at_off) AS at_us FROM sn GROUP BY 1),
n AS (SELECT l.stream, max(l.off) - coalesce(max(la.at_off), 0) AS n, coalesce(max(la.at_us), min(l.us)) AS since FROM log l LEFT JOIN la USING (stream) WHERE la.at_off IS NULL OR l.off > la.at_off GROUP BY 1)
SELECT stream, CASE WHEN n >= 60 THEN 'event_count' ELSE 'time' END AS reason FROM n WHERE n >= 60 OR {NOW} - since >= 20 * {DAY}""")
def q23_snapshots_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = a.channel_log(spark, sf_dir)
    return queues.snapshots_due(log, _snaps(log), NOW, 60, 20 * DAY)


_REQ_SQL = "rq AS (SELECT DISTINCT CASE WHEN k % 17 = 0 THEN 'channel:none' ELSE stream END AS stream, k - 2 AS since FROM log WHERE kind = 'message_deleted')"


@query(f"""{LOG}, {_SNAPS_SQL}, {_REQ_SQL}, hd AS (SELECT stream, max(off) AS head FROM log GROUP BY 1), la AS (SELECT stream, max(at_off) AS at_off FROM sn GROUP BY 1),
d AS (SELECT stream, since, at_off, CASE WHEN head IS NULL THEN 'unknown_stream' WHEN since < 0 OR since > head THEN 'bad_offset' WHEN head - since <= 30 THEN 'replay' WHEN at_off >= since AND at_off <= head THEN 'snapshot' ELSE 'no_snapshot' END AS decision FROM rq LEFT JOIN hd USING (stream) LEFT JOIN la USING (stream))
SELECT stream, since, decision, CASE WHEN decision = 'snapshot' THEN at_off END AS at_off FROM d""")
def q25_replay_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = a.channel_log(spark, sf_dir)
    asked = log.filter("kind = 'message_deleted'").select(F.when(F.col("k") % 17 == 0, "channel:none").otherwise(F.col("stream")).alias("stream"), (F.col("k") - 2).alias("since")).distinct()
    return queues.replay_decision(asked, log.groupBy("stream").agg(F.max("off").alias("head")), _snaps(log), 30)


@query(f"{LOG} SELECT 'C' || c_custkey AS channel_id, coalesce((SELECT max(CAST(replace(msg_ts, '.', '') AS BIGINT)) FROM log WHERE kind = 'message' AND channel_id = 'C' || c_custkey), {NOW} - 3600000000) AS from_us FROM customer")
def q26_resume_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("C"), "c_custkey").alias("channel_id"))
    return c.resume_points(a.channel_log(spark, sf_dir), scope, NOW, 3_600_000_000)


@query(f"{SM} SELECT 'C' || c_custkey AS channel_id, {NOW} - m AS age_us, m IS NULL OR {NOW} - m > 3 * {DAY} AS is_due FROM customer LEFT JOIN (SELECT channel_id AS ci, max(sampled_us) AS m FROM sm GROUP BY 1) ON ci = 'C' || c_custkey")
def q28_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("C"), "c_custkey").alias("channel_id"))
    return c.due(_samples(spark, sf_dir)[1], scope, 3 * DAY, NOW)


@query(f"{SM}, w AS (SELECT ({NOW} // {DAY} - 30 + range) * {DAY} AS day_us FROM range(30)) SELECT day_us, {NOW} - m AS age_us FROM w LEFT JOIN (SELECT day_us, max(sampled_us) AS m FROM sm WHERE channel_id = 'C7' GROUP BY 1) USING (day_us) ORDER BY m NULLS FIRST, day_us LIMIT 1")
def l3_stale_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.stale_day(_samples(spark, sf_dir)[1], F.col("channel_id") == "C7", NOW)


@query(f"""{LOG}, {ACTIVE_SQL}, x AS (SELECT channel_id FROM log WHERE kind = 'message' AND k % 9 <> 0), k AS (SELECT channel_id, count(*) AS l, 0 AS m, 0 AS r FROM log WHERE kind = 'message' GROUP BY 1 UNION ALL SELECT channel_id, 0, count(*), 0 FROM act GROUP BY 1 UNION ALL SELECT channel_id, 0, 0, count(*) FROM x GROUP BY 1)
SELECT channel_id, CAST(sum(l) AS BIGINT) AS left_n, CAST(sum(m) AS BIGINT) AS middle_n, CAST(sum(r) AS BIGINT) AS right_n, sum(l) = sum(m) AND sum(m) = sum(r) AS same FROM k GROUP BY 1""")
def q33_store_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = a.channel_log(spark, sf_dir)
    n = lambda d: d.groupBy("channel_id").agg(F.count("*").alias("n"))
    return c.parity(n(log.filter("kind = 'message'")), n(folds.active_messages(log)), n(log.filter("kind = 'message' and k % 9 <> 0")), "channel_id")


@query(f"{RL}, w AS (SELECT *, sum(messages) OVER (PARTITION BY channel_id, run_id ORDER BY page, id ROWS UNBOUNDED PRECEDING) AS s FROM rl WHERE kind = 'page') SELECT channel_id, run_id, CAST(coalesce(min(s) FILTER (WHERE s >= 100), max(s)) AS BIGINT) AS total, min(page) FILTER (WHERE s >= 100) AS stopped_at, CASE WHEN max(s) >= 100 THEN 'size_capped' ELSE 'completed' END AS outcome FROM w GROUP BY 1, 2")
def r16_run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.run_outcomes(a.run_log(spark, sf_dir), 100)


@query(f"""WITH {a.USER_LOG_SQL}, w AS (SELECT *, lag(display) OVER p AS d, lag(real) OVER p AS r, row_number() OVER p AS n FROM ul WINDOW p AS (PARTITION BY user_id ORDER BY off))
SELECT user_id, off, 'added' AS change FROM w WHERE n = 1 UNION ALL SELECT user_id, off, 'renamed' FROM w WHERE n > 1 AND display IS DISTINCT FROM d UNION ALL SELECT user_id, off, 'profile' FROM w WHERE n > 1 AND real IS DISTINCT FROM r""")
def r12_user_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.user_changes(a.user_log(spark, sf_dir))


@query(f"""{LOG}, b AS (SELECT id, stream, CASE WHEN k % 3 = 0 THEN coalesce(thread_ts, msg_ts) ELSE msg_ts END AS msg_ts, k, thread_ts, kind FROM log), f AS (SELECT *, row_number() OVER (PARTITION BY stream, msg_ts ORDER BY id) AS n FROM b WHERE kind = 'message' AND msg_ts IS NOT NULL)
SELECT x.stream, x.msg_ts, x.id FROM f x JOIN f o ON o.stream = x.stream AND o.msg_ts = x.msg_ts AND o.n = 1 WHERE x.n > 1 AND (x.k IS DISTINCT FROM o.k OR x.thread_ts IS DISTINCT FROM o.thread_ts) AND NOT EXISTS (SELECT 1 FROM b e WHERE e.kind = 'message_changed' AND e.stream = x.stream AND e.msg_ts = x.msg_ts AND e.k = x.k)""")
def r9_corrective_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = a.channel_log(spark, sf_dir).withColumn("msg_ts", F.when(F.col("k") % 3 == 0, F.coalesce("thread_ts", "msg_ts")).otherwise(F.col("msg_ts")))
    return queues.corrective_edits(log)


@query(f"""{LOG}, t AS (SELECT *, kind <> 'message' AS ok, count(*) FILTER (WHERE kind <> 'message') OVER (PARTITION BY channel_id ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS ep FROM log), f AS (SELECT channel_id, ep, min(us) AS b FROM t WHERE NOT ok GROUP BY 1, 2)
SELECT t.channel_id, min(t.us) AS us FROM t JOIN f ON f.channel_id = t.channel_id AND f.ep = t.ep WHERE NOT ok AND t.us - b >= {DAY} GROUP BY t.channel_id, t.ep""")
def r14_degraded_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = a.channel_log(spark, sf_dir).select("channel_id", "us", "id", (F.col("kind") != "message").alias("ok"))
    return queues.degraded_episodes(attempts, DAY)


@query(f"""{LOG}, s AS (SELECT id, CASE k % 6 WHEN 0 THEN 'auth_failed' WHEN 1 THEN 'disconnected' WHEN 2 THEN 'degraded' WHEN 3 THEN 'healthy' END AS health, k % 4 <> 0 AS caught_up, CASE WHEN k % 5 <> 0 THEN {NOW} - k * 2000000 END AS f FROM log)
SELECT id, CASE WHEN health = 'auth_failed' THEN 'auth token invalid' WHEN health = 'disconnected' THEN 'socket-mode disconnected' WHEN health = 'degraded' THEN 'slack ingestion unhealthy' WHEN NOT caught_up THEN 'catching up after reconnect' WHEN f IS NULL OR {NOW} - f > 60000000 THEN 'server unreachable' END AS reason FROM s""")
def t14_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.staleness(_stale_states(spark, sf_dir), NOW).select("id", "reason")


def _stale_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    health = F.when(k % 6 == 0, "auth_failed").when(k % 6 == 1, "disconnected").when(k % 6 == 2, "degraded").when(k % 6 == 3, "healthy")
    fallbacks = F.when(k % 7 == 0, F.array(F.concat(F.lit("user U"), k), F.lit("channel C"))).when(k % 7 < 3, F.array().cast("array<string>"))
    return a.channel_log(spark, sf_dir).select("id", health.alias("health"), (k % 4 != 0).alias("caught_up"), F.when(k % 5 != 0, NOW - k * 2_000_000).alias("last_frame_us"), fallbacks.alias("fallbacks"))


@query(ORACLES["t14_staleness"].replace("SELECT id, health, k % 4", "SELECT id, k, health, k % 4").replace("s AS (SELECT id,", "s AS (SELECT id, k,").replace(") SELECT id, CASE", "), r AS (SELECT id, k, f, CASE", 1).replace(")\nSELECT id, CASE", "), r AS (SELECT id, k, f, CASE", 1) + """)
SELECT id, CASE WHEN reason IS NOT NULL THEN 'stale' WHEN k % 7 = 0 THEN 'fallback' ELSE 'clean' END AS decision, CASE WHEN reason IS NOT NULL THEN reason WHEN k % 7 = 0 THEN 'user U' || k || '; channel C' ELSE '' END AS reasons,
  chr(10) || '---' || chr(10) || chr(10) || '> ⚠ Content may be stale. Last successful sync: ' || coalesce(strftime(make_timestamp(f), '%Y-%m-%d %H:%M:%S UTC'), 'never') || '. Reason: ' || reason || '.' || chr(10) AS trailer FROM r""")
def t14_trailers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.trailers(_stale_states(spark, sf_dir), NOW).select("id", "decision", F.array_join("reasons", "; ").alias("reasons"), "trailer")


@query(f"{CL}, {TIERS_SQL}, x AS (SELECT channel_id, 's' || (CAST(substr(channel_id, 2) AS BIGINT) % 200) AS slug, tier, CASE WHEN is_im THEN 'dms' WHEN is_mpim THEN 'group-dms' WHEN is_member THEN 'channels' ELSE 'other-channels' END AS root FROM ti), y AS (SELECT *, row_number() OVER (PARTITION BY root, slug ORDER BY tier <> 'hot', channel_id) AS n FROM x WHERE tier <> 'blocked') SELECT channel_id, root, CASE WHEN n > 1 THEN slug || '-' || n ELSE slug END AS unique_slug FROM y")
def w3_unique_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = folds.client_channels(a.channel_list_log(spark, sf_dir), manual(spark, sf_dir))
    x = t.filter("tier <> 'blocked'").select("channel_id", "tier", inventory.conversation_root(F.col("is_im"), F.col("is_mpim"), F.col("is_member")).alias("root"), F.concat(F.lit("s"), F.substring("channel_id", 2, 20).cast("bigint") % 200).alias("slug"))
    return inventory.unique_slugs(x, "root", "slug", [F.col("tier") != "hot"], "channel_id").select("channel_id", "root", "unique_slug")


@query(f"{LOG} SELECT r.id, r.stream, r.us, (SELECT max(s.off) FROM log s WHERE s.kind = 'message' AND s.stream = r.stream AND s.us <= r.us) AS off FROM log r WHERE r.kind = 'message_deleted'")
def j17_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = a.channel_log(spark, sf_dir)
    return as_of(log.filter("kind = 'message_deleted'").select("id", "stream", "us"), log.filter("kind = 'message'").select("stream", F.col("us").alias("state_us"), "off"), "stream", "us", "state_us").select("id", "stream", "us", "off")


