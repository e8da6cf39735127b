"""Queries of listings, names, tiers, blocks, paths and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..operators import folds, inventory, listing, projection
from ..sources import adapter as a
from .completeness import _STATS_SQL, _stats
from .projection import _PROJECTED_SQL, projected_log
from .registry import query
from .state import BLOCKED_SQL, CL, LOG, TIERS_SQL, blocked, manual
from .text import ZONE

_ROOT_SQL = "CASE WHEN is_im THEN 'dms' WHEN is_mpim THEN 'group-dms' WHEN is_member THEN 'channels' ELSE 'other-channels' END"


def client(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.client_channels(a.channel_list_log(spark, sf_dir), manual(spark, sf_dir))


@query(f"{CL}, {TIERS_SQL} SELECT channel_id, {_ROOT_SQL} AS root, tier, true AS shown FROM ti WHERE tier = 'hot' UNION ALL SELECT channel_id, {_ROOT_SQL}, tier, false FROM ti WHERE tier IN ('hot', 'hidden')")
def p10_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What listings show, and what names in them reach."""
    c = client(spark, sf_dir)
    return listing.listed(c).withColumn("shown", F.lit(True)).unionByName(listing.listed(c, hidden=True).withColumn("shown", F.lit(False)))


@query(f"WITH {a.CHANNEL_LOG_SQL}, {a.CHANNEL_LIST_SQL}, {TIERS_SQL} SELECT channel_id FROM ti WHERE is_im AND CAST(substr(channel_id, 2) AS BIGINT) % 4 > 0 AND NOT EXISTS (SELECT 1 FROM log WHERE kind = 'message' AND log.channel_id = ti.channel_id)")
def p11_dormant(spark: SparkSession, sf_dir: str) -> DataFrame:
    walked = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 4 > 0").select(F.concat(F.lit("C"), "c_custkey").alias("channel_id"))
    return listing.dormant(client(spark, sf_dir), walked, a.channel_log(spark, sf_dir).filter("kind = 'message'"))


@query(f"{CL}, {TIERS_SQL}, {BLOCKED_SQL} SELECT channel_id FROM ti WHERE (is_member OR is_im OR is_mpim) AND channel_id NOT IN (SELECT channel_id FROM bl) AND NOT regexp_matches(lower(coalesce(name, '')), '77|r1')")
def p12_to_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.to_walk(client(spark, sf_dir), blocked(spark, sf_dir), ("77", "r1"))


@query(f"{LOG}, x AS (SELECT id, CASE WHEN k % 9 = 0 THEN 'not a time' ELSE msg_ts END AS ts, thread_ts, reply_count FROM log WHERE kind IN ('message', 'message_changed') AND msg_ts IS NOT NULL) SELECT id, coalesce(reply_count, 0) > 0 AND (thread_ts IS NULL OR thread_ts = ts) AS parent, coalesce(reply_count, 0) > 0 AND thread_ts IS NOT DISTINCT FROM ts AS strict_parent FROM x WHERE try_cast(ts AS DECIMAL(20, 6)) IS NULL OR CAST(ts AS DECIMAL(20, 6)) > 1705000000")
def p14_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages since a moment or without a time, and whether each is a thread's parent (P13, both rules)."""
    x = a.channel_log(spark, sf_dir).filter("kind in ('message', 'message_changed') and msg_ts is not null").select("id", F.when(F.col("k") % 9 == 0, "not a time").otherwise(F.col("msg_ts")).alias("ts"), "thread_ts", "reply_count")
    kept = x.filter(listing.passes_since(F.col("ts"), F.lit(1_705_000_000)))
    return kept.select("id", *[listing.is_thread_parent(F.col("ts"), F.col("thread_ts"), F.col("reply_count"), s).alias(n) for s, n in ((False, "parent"), (True, "strict_parent"))])


_NAMED_SQL = f"""sl AS (SELECT channel_id, tier, {_ROOT_SQL} AS root, 's' || (CAST(substr(channel_id, 2) AS BIGINT) % 200) AS slug FROM ti WHERE tier <> 'blocked'),
nm AS (SELECT channel_id, root, tier, CASE WHEN n > 1 THEN slug || '-' || n ELSE slug END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY root, slug ORDER BY tier <> 'hot', channel_id) AS n FROM sl))"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.named(client(spark, sf_dir), F.concat(F.lit("s"), F.substring("channel_id", 2, 20).cast("bigint") % 200))


@query(f"""{CL}, {TIERS_SQL}, {_NAMED_SQL}, tg AS (SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN 'C' || c_custkey WHEN 1 THEN 's' || c_custkey % 250 WHEN 2 THEN CASE WHEN c_custkey % 3 = 0 THEN 'dms' ELSE 'channels' END || '/s' || c_custkey % 200 ELSE 's' || c_custkey % 200 || '-2' END AS target FROM customer),
h AS (SELECT target, list(channel_id) AS ids FROM tg JOIN nm ON nm.slug = CASE WHEN contains(target, '/') THEN split_part(target, '/', 2) ELSE target END AND (NOT contains(target, '/') OR nm.root = split_part(target, '/', 1)) GROUP BY 1),
r AS (SELECT target, CASE WHEN len(ids) > 1 THEN NULL WHEN len(ids) = 1 THEN ids[1] ELSE (SELECT channel_id FROM ti WHERE ti.channel_id = target) END AS channel_id, len(ids) AS n FROM tg LEFT JOIN h USING (target))
SELECT target, channel_id, CASE WHEN n > 1 THEN 'ambiguous' WHEN channel_id IS NULL THEN 'unknown' END AS error FROM r""")
def q31_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    in_root = F.concat(F.when(k % 3 == 0, "dms").otherwise("channels"), F.lit("/s"), k % 200)
    target = F.when(k % 4 == 0, F.concat(F.lit("C"), k)).when(k % 4 == 1, F.concat(F.lit("s"), k % 250)).when(k % 4 == 2, in_root).otherwise(F.concat(F.lit("s"), k % 200, F.lit("-2")))
    targets = spark.read.parquet(f"{sf_dir}/customer.parquet").select(target.alias("target")).distinct()
    return listing.resolve_targets(targets, names(spark, sf_dir), client(spark, sf_dir))


@query(f"""{CL}, {TIERS_SQL}, st AS (SELECT channel_id, tier, channel_id IN (SELECT channel_id FROM mn) AS by_hand, CASE WHEN is_archived THEN 'hidden' WHEN is_im OR is_mpim OR is_member THEN 'hot' ELSE 'hidden' END AS default_tier FROM ti),
w AS (SELECT 'C' || c_custkey AS channel_id, CASE c_custkey % 5 WHEN 1 THEN 'blocked' WHEN 2 THEN 'hot' END AS tier FROM customer WHERE c_custkey % 7 = 0)
SELECT st.channel_id, CASE WHEN w.channel_id IS NULL THEN st.tier WHEN w.tier IS NULL THEN default_tier ELSE w.tier END AS tier, CASE WHEN w.channel_id IS NULL THEN by_hand ELSE w.tier IS NOT NULL END AS by_hand,
  CASE WHEN w.channel_id IS NULL THEN st.tier WHEN w.tier IS NULL THEN default_tier ELSE w.tier END <> 'blocked' AS subscribed, default_tier FROM st LEFT JOIN w USING (channel_id)""")
def q31_set_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, m = client(spark, sf_dir), manual(spark, sf_dir)
    default = folds.client_channels(a.channel_list_log(spark, sf_dir), m.limit(0)).select("channel_id", F.col("tier").alias("default_tier"))
    state = c.join(m.select("channel_id", F.lit(True).alias("_m")), "channel_id", "left").join(default, "channel_id").select("channel_id", "tier", F.coalesce("_m", F.lit(False)).alias("by_hand"), "subscribed", "default_tier")
    k = F.col("c_custkey")
    wanted = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 7 = 0").select(F.concat(F.lit("C"), k).alias("channel_id"), F.when(k % 5 == 1, "blocked").when(k % 5 == 2, "hot").alias("tier"))
    return listing.set_tiers(state, wanted)


@query(f"""{LOG}, {BLOCKED_SQL}, e AS (SELECT id, channel_id, us, k % 3 > 0 AS block, CASE WHEN k % 2 = 0 THEN 'r' || k END AS reason FROM log WHERE kind = 'message_deleted'), l AS (SELECT channel_id, max(us) AS us, arg_max(block, CAST(us AS HUGEINT) * 1000000 + id) AS block, arg_max(coalesce(reason, '-'), CAST(us AS HUGEINT) * 1000000 + id) AS r FROM e GROUP BY 1)
SELECT channel_id, CASE WHEN l.block THEN nullif(r, '-') ELSE bl.reason END AS reason, CASE WHEN bl.channel_id IS NOT NULL THEN CAST(1 AS BIGINT) ELSE l.us END AS blocked_us FROM bl FULL JOIN l USING (channel_id) WHERE coalesce(l.block, true)""")
def q32_block_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    edits = a.channel_log(spark, sf_dir).filter("kind = 'message_deleted'").select("id", "channel_id", "us", (k % 3 > 0).alias("block"), F.when(k % 2 == 0, F.concat(F.lit("r"), k)).alias("reason"))
    return listing.edit_blocks(blocked(spark, sf_dir).withColumn("blocked_us", F.lit(1).cast("bigint")), edits)


_FORMS = ["", "/r", "/r/s", "/r/s/channel.md", "/r/s/x.md", "/r/s/D", "/r/s/D/channel.md", "/r/s/D/feed.md", "/r/s/D/x.md", "/r/s/D/t/thread.md", "/r/s/D/t/u/thread.md", "/.cached-only/r/s/channel.md"]
_DAY_OK = "try_cast(regexp_extract(path, '/([0-9]{4}-[0-9]{2})/([0-9]{2})/', 1) || '-' || regexp_extract(path, '/([0-9]{4}-[0-9]{2})/([0-9]{2})/', 2) AS DATE) IS NOT NULL"
_UNDER = "^/mnt(/\\.cached-only)?/(dms|group-dms|channels|other-channels)/[^/]+"


@query(f"""WITH c AS (SELECT c_custkey AS c, list_extract(['dms', 'group-dms', 'channels', 'other-channels', 'nowhere'], CAST(c_custkey % 5 + 1 AS INT)) AS r, '2024-' || lpad(CAST(c_custkey % 14 AS VARCHAR), 2, '0') || '/' || lpad(CAST(c_custkey % 33 AS VARCHAR), 2, '0') AS d,
  list_extract({_FORMS}, CAST(c_custkey % 12 + 1 AS INT)) AS f FROM customer),
p AS (SELECT CASE WHEN c % 23 = 0 THEN '/mntx' ELSE '/mnt' END || replace(replace(replace(f, '/r', '/' || r), '/s', '/s' || c), '/D', '/' || d) AS path FROM c)
SELECT path, CASE WHEN regexp_full_match(path, '{_UNDER}') THEN 'channel_dir' WHEN regexp_full_match(path, '{_UNDER}/channel.md') THEN 'channel_file'
  WHEN regexp_full_match(path, '{_UNDER}/[0-9]{{4}}-[0-9]{{2}}/[0-9]{{2}}/(channel|feed).md') AND {_DAY_OK} THEN 'day_file' WHEN regexp_full_match(path, '{_UNDER}/[0-9]{{4}}-[0-9]{{2}}/[0-9]{{2}}/[^/]+/(thread|feed).md') AND {_DAY_OK} THEN 'thread_file' END AS kind FROM p""")
def c12_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path for each customer, of every depth, some outside the mount, of no root or of no day."""
    k = F.col("c_custkey")
    pick = lambda items: F.get(F.array(*map(F.lit, items)), (k % len(items)).cast("int"))
    root, form = pick(["dms", "group-dms", "channels", "other-channels", "nowhere"]), pick(_FORMS)
    day = F.concat(F.lit("/2024-"), F.lpad((k % 14).cast("string"), 2, "0"), F.lit("/"), F.lpad((k % 33).cast("string"), 2, "0"))
    path = F.replace(F.replace(form, F.lit("/r"), F.concat(F.lit("/"), root)), F.lit("/s"), F.concat(F.lit("/s"), k))
    path = F.replace(path, F.lit("/D"), day)
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.when(k % 23 == 0, "/mntx").otherwise("/mnt"), path).alias("path"))
    return c.select("path", listing.parsed_path(F.col("path"), "/mnt")["kind"].alias("kind"))


_LOCAL = f"timezone('{ZONE}', timezone('UTC', make_timestamp(t)))"


@query(f"""WITH {a.CHANNEL_LOG_SQL}, {a.CHANNEL_LIST_SQL}, {TIERS_SQL}, {_NAMED_SQL}, lk AS (SELECT id, CASE WHEN k % 10 = 7 THEN 'C0' ELSE channel_id END AS channel_id, CASE WHEN k % 5 > 0 THEN msg_ts END AS message_ts, CASE WHEN k % 5 > 0 AND k % 4 = 0 THEN coalesce(thread_ts, msg_ts) END AS thread_ts FROM log WHERE kind = 'message'),
pa AS (SELECT DISTINCT channel_id, msg_ts AS ts, 'ts-' || msg_ts AS thread_slug FROM log WHERE kind = 'message' AND reply_count > 0),
x AS (SELECT lk.*, nm.root, nm.slug, pa.thread_slug, CAST(replace(coalesce(lk.thread_ts, message_ts), '.', '') AS BIGINT) AS t FROM lk LEFT JOIN nm USING (channel_id) LEFT JOIN pa ON pa.channel_id = lk.channel_id AND pa.ts = coalesce(lk.thread_ts, message_ts)),
y AS (SELECT *, CASE WHEN root IS NULL THEN 'unknown channel' WHEN thread_slug IS NULL AND thread_ts IS NOT NULL THEN 'unknown thread' END AS error FROM x)
SELECT id, CASE WHEN error IS NULL THEN '/mnt/' || root || '/' || slug || CASE WHEN t IS NULL THEN '' ELSE strftime({_LOCAL}, '/%Y-%m/%d') || CASE WHEN thread_slug IS NULL THEN '/channel.md' ELSE '/' || thread_slug || '/thread.md' END END END AS path, error FROM y""")
def c11_link_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    m = a.channel_log(spark, sf_dir).filter("kind = 'message'")
    ts, thread = F.when(k % 5 > 0, F.col("msg_ts")), F.when((k % 5 > 0) & (k % 4 == 0), F.coalesce("thread_ts", "msg_ts"))
    at = times.ts_micros(F.coalesce(thread, ts))
    links = m.select("id", F.when(k % 10 == 7, "C0").otherwise(F.col("channel_id")).alias("channel_id"), ts.alias("message_ts"), thread.alias("thread_ts"), times.local(at, ZONE, "yyyy-MM").alias("month"), times.local(at, ZONE, "dd").alias("day"))
    parents = m.filter("reply_count > 0").select("channel_id", F.col("msg_ts").alias("ts"), F.concat(F.lit("ts-"), "msg_ts").alias("thread_slug")).distinct()
    return listing.link_paths(links, names(spark, sf_dir), parents, "/mnt")


@query("""SELECT c_custkey, 'n' || c_custkey AS name, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment END AS kind, CASE c_custkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE 3 END AS n FROM customer WHERE c_custkey % 5 > 1
UNION ALL SELECT c_custkey, NULL, NULL, 0 FROM customer WHERE c_custkey % 5 <= 1""")
def c13_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of documents read back: quoted, with a key that comes again, without an end, without a head."""
    k = F.col("c_custkey")
    head = F.concat(F.lit("---\nname: \"n"), k, F.lit("\"\nkind: "), "c_mktsegment", F.lit("\nurl: 'https://x.org:1'\nno entry\n"), F.when(k % 3 == 0, F.concat(F.lit("kind:  "), "c_name", F.lit(" \n"))).otherwise(""))
    document = F.when(k % 5 == 0, head).when(k % 5 == 1, F.concat(F.lit("\n"), head, F.lit("---\n"))).otherwise(F.concat(head, F.lit("---\ntext: none\n---\n")))
    m = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", listing.frontmatter(document).alias("m"))
    return m.select("c_custkey", F.col("m")["name"].alias("name"), F.col("m")["kind"].alias("kind"), F.size("m").alias("n"))


@query(f"{LOG} SELECT id, k * 400 >= 10000 AND us % 3 > 0 AS approximate FROM log WHERE kind = 'message'")
def c19_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.col("k") * 400
    return a.channel_log(spark, sf_dir).filter("kind = 'message'").select("id", listing.approximate_total(total, total + F.col("us") % 3).alias("approximate"))


_COUNTED_SQL = "rc AS (SELECT channel_id, ts, CAST(max(n) AS BIGINT) AS reply_count FROM wr WHERE NOT reply GROUP BY 1, 2), th AS (SELECT DISTINCT channel_id, thread_ts, ts FROM rw WHERE ts <> thread_ts)"


@query(f"{_PROJECTED_SQL}, {_COUNTED_SQL} SELECT channel_id, strftime(timezone('{ZONE}', timezone('UTC', make_timestamp(CAST(replace(ts, '.', '') AS BIGINT)))), '%Y-%m-%d') AS day, ts, reply_count > 0 AS is_parent FROM rc")
def q30_day_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = projection.message_operations(projected_log(spark, sf_dir)).filter("op = 'top'").groupBy("channel_id", "ts").agg(F.max("n").alias("reply_count"))
    return listing.day_contents(top, times.local(times.ts_micros(F.col("ts")), ZONE, "yyyy-MM-dd"))


@query(f"""{_PROJECTED_SQL}, {_COUNTED_SQL}, al AS (SELECT channel_id, thread_ts, ts, row_number() OVER (PARTITION BY channel_id, thread_ts ORDER BY ts) AS place FROM th UNION ALL SELECT channel_id, ts, ts, 0 FROM rc WHERE EXISTS (SELECT 1 FROM th WHERE th.channel_id = rc.channel_id AND th.thread_ts = rc.ts))
SELECT al.channel_id, al.thread_ts, place, al.ts, coalesce(rc.reply_count, 0) AS reply_count FROM al LEFT JOIN rc ON rc.channel_id = al.channel_id AND rc.ts = al.thread_ts""")
def q30_thread_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = projection.message_operations(projected_log(spark, sf_dir))
    top = ops.filter("op = 'top'").groupBy("channel_id", "ts").agg(F.max("n").alias("reply_count"))
    return listing.thread_contents(top, ops.filter("op = 'reply'").select("channel_id", "thread_ts", "ts").distinct())


@query(f"{_STATS_SQL} SELECT channel_id, total FROM sx ORDER BY total IS NULL, total DESC, lower(name), channel_id LIMIT 100")
def l6_inventory_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred of the inventory's order: a report."""
    return inventory.inventory_order(_stats(spark, sf_dir)).limit(100).select("channel_id", "total")


@query(f"{LOG} SELECT stream, off, kind FROM log WHERE stream = 'channel:C7' AND off > 2 ORDER BY off LIMIT 3")
def l5_event_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a replay: three events behind an offset."""
    return a.channel_log(spark, sf_dir).filter("stream = 'channel:C7' and off > 2").orderBy("off").limit(3).select("stream", "off", "kind")


@query(f"{LOG} SELECT id, CASE WHEN regexp_full_match(t, '[0-9]+\\.[0-9]+') THEN CAST(t AS DECIMAL(20, 6)) ELSE 0 END AS sort_key FROM (SELECT id, CASE WHEN k % 6 = 0 THEN 'x' || msg_ts ELSE msg_ts END AS t FROM log WHERE kind = 'message')")
def l4_sort_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.channel_log(spark, sf_dir).filter("kind = 'message'").select("id", times.ts_sort_key(F.when(F.col("k") % 6 == 0, F.concat(F.lit("x"), "msg_ts")).otherwise(F.col("msg_ts"))).alias("sort_key"))


_AGE_SQL = f"({a.NOW_US} - us) / 1000000"


@query(f"{LOG} SELECT id, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%fZ') AS probed_at, CAST(floor(CASE WHEN {_AGE_SQL} < 3600 THEN 60 WHEN {_AGE_SQL} < 86400 THEN 600 WHEN {_AGE_SQL} < 604800 THEN greatest({_AGE_SQL} / 20, 1800) END) AS BIGINT) AS fresh_s FROM (SELECT * REPLACE (us - us % 1000000 AS us) FROM log)")
def c5_c18_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of probes as text that sorts, and for how long a thread with its last reply then stays fresh."""
    log = a.channel_log(spark, sf_dir).withColumn("us", F.col("us") - F.col("us") % 1_000_000)
    fresh = times.thread_cache_seconds((F.lit(a.NOW_US) - F.col("us")) / 1_000_000)
    return log.select("id", times.iso_micros(F.col("us")).alias("probed_at"), F.floor(fresh).cast("bigint").alias("fresh_s"))
