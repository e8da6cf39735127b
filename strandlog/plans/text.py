"""Queries of the text layer over conversations and pages, with references put in by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import times
from ..operators import folds, render
from ..operators.latest import latest_per_key
from ..sources import adapter as a
from .completeness import _DAYS_SQL, _DATE, _gaps
from .registry import query
from .state import ACTIVE_SQL, CL, LOG, UL

_CONV_SQL = """cv AS (SELECT conv_id || ':' || turn AS key, conv_id, turn, role,
 CASE conv_id % 7 WHEN 0 THEN '<@U' || conv_id % 300 || '|old> *bold* ' WHEN 1 THEN '<#C' || conv_id % 300 || '> _it_ ' WHEN 2 THEN '<https://x.org/a|label> **b** ' WHEN 3 THEN '<!here> ~gone~ ' WHEN 4 THEN '<!subteam^S1|@team> <!subteam^S2> ' WHEN 5 THEN '<@U' || conv_id % 300 || '><http://y.org> ' ELSE '' END || coalesce(text, '') AS m FROM conversations)"""


def conversation_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, conv_id, turn, role, m): texts with markup at their beginning."""
    i = F.col("conv_id")
    n = (i % 300).cast("string")
    head = (
        F.when(i % 7 == 0, F.concat(F.lit("<@U"), n, F.lit("|old> *bold* "))).when(i % 7 == 1, F.concat(F.lit("<#C"), n, F.lit("> _it_ "))).when(i % 7 == 2, "<https://x.org/a|label> **b** ")
        .when(i % 7 == 3, "<!here> ~gone~ ").when(i % 7 == 4, "<!subteam^S1|@team> <!subteam^S2> ").when(i % 7 == 5, F.concat(F.lit("<@U"), n, F.lit("><http://y.org> "))).otherwise("")
    )
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.concat_ws(":", "conv_id", "turn").alias("key"), "conv_id", "turn", "role", F.concat(head, F.coalesce("text", F.lit(""))).alias("m"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_markup(spark, sf_dir).withColumn("block", t.structural(F.col("m")))


@query()
def t1_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-behind is not in the oracle's expressions; string-exact tests hold this one."""
    return blocks(spark, sf_dir).select("key", "block")


_REF_SQL = f"{_CONV_SQL}, ref AS (SELECT key, 'user' AS kind, unnest(list_distinct(regexp_extract_all(m, '<@(U[A-Z0-9]+)(?:\\|[^>]+)?>', 1))) AS ref FROM cv UNION ALL SELECT key, 'channel', unnest(list_distinct(regexp_extract_all(m, '<#(C[A-Z0-9]+)(?:\\|[^>]+)?>', 1))) FROM cv)"


@query(f"WITH {_REF_SQL} SELECT key, kind, ref FROM ref")
def t5_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.mention_edges(conversation_markup(spark, sf_dir), "key", "m")


@query(f"{UL}, {_REF_SQL} SELECT DISTINCT key FROM ref WHERE kind = 'user' AND ref IN (SELECT user_id FROM ul WHERE kind = 'user_renamed' AND off > 5000)")
def q34_invalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = a.user_log(spark, sf_dir).filter("kind = 'user_renamed' and off > 5000").select(F.lit("user").alias("kind"), F.col("user_id").alias("ref"))
    return render.invalidated(render.mention_edges(conversation_markup(spark, sf_dir), "key", "m"), changed, "key")


_USERS_SQL = "us AS (SELECT user_id, CASE kind WHEN 'user_renamed' THEN display WHEN 'user_added' THEN coalesce(nullif(display, ''), nullif(real, ''), nullif(name, ''), user_id) ELSE coalesce(nullif(display, ''), nullif(real, ''), user_id) END AS display_name FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY off DESC) AS rn FROM ul) WHERE rn = 1)"


@query(f"""{UL}, {_USERS_SQL}, {_CONV_SQL}, x AS (SELECT key, conv_id, regexp_replace(m, '<@(U[0-9]+)\\|[^>]+>', '<@\\1>') AS m, 'U' || conv_id % 300 AS u, 'C' || conv_id % 300 AS c FROM cv)
SELECT key, replace(replace(m, '<@' || u || '>', '@' || coalesce(display_name, u)), '<#' || c || '>', '#' || CASE WHEN conv_id % 300 % 2 = 0 THEN 'chan' || conv_id % 300 ELSE c END) AS resolved,
  CASE WHEN conv_id % 7 IN (0, 5) AND display_name IS NULL THEN u WHEN conv_id % 7 = 1 AND conv_id % 300 % 2 = 1 THEN c ELSE '' END AS missed FROM x LEFT JOIN us ON user_id = u""")
def t4_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = conversation_markup(spark, sf_dir).withColumn("m", F.regexp_replace("m", t.USER, "<@$1>")).select("key", "m")
    names = spark.range(0, 300, 2).select(F.concat(F.lit("C"), "id").alias("channel_id"), F.concat(F.lit("chan"), "id").alias("name"))
    done = render.resolve(texts, folds.users_client(a.user_log(spark, sf_dir)), names, "key", "m")
    return done.select("key", "resolved", F.array_join("missed", ",").alias("missed"))


ZONE = "Pacific/Auckland"


def _clock(us: str) -> str:
    return f"strftime(timezone('{ZONE}', timezone('UTC', make_timestamp({us}))), '%H:%M')"


_BLOCKS_SQL = f"""{LOG}, {ACTIVE_SQL}, bk AS (SELECT channel_id, us, msg_ts AS ts, concat_ws(chr(10) || chr(10), '## ' || {_clock("us")} || ' ' || CASE WHEN k % 5 = 0 THEN '@bot' ELSE '<@U' || k || '>' END || CASE WHEN k % 6 = 0 THEN ' *(edited ' || {_clock("us + 60000000")} || ')*' ELSE '' END,
  '**hello** <@U' || k || '>', CASE WHEN k % 7 = 0 THEN '**T**' || chr(10) || chr(10) || '*x*' || chr(10) || chr(10) || '<http://z>' END, CASE WHEN k % 4 = 0 THEN ':wave: ' || k END,
  CASE WHEN k % 16 = 0 THEN '[Huddle Notes](a.png)' WHEN k % 8 = 0 THEN '📎 [a.png](attachments/a.png)' END, CASE WHEN reply_count > 0 AND thread_ts = msg_ts THEN '> Thread: ' || reply_count || ' replies' END) || chr(10) AS block FROM act)"""


@query(f"{_BLOCKS_SQL} SELECT * FROM bk")
def t2_message_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of messages with reactions, files, attachments and threads."""
    log = a.channel_log(spark, sf_dir)
    k = F.col("k")
    m = folds.active_messages(log).select(
        "channel_id", "us", F.col("msg_ts").alias("ts"), "thread_ts", F.when(k % 5 == 0, "bot").otherwise(F.concat(F.lit("U"), k)).alias("user"), F.concat(F.lit("*hello* <@U"), k, F.lit("|x>")).alias("text"),
        F.when(k % 6 == 0, F.col("us") + 60_000_000).alias("edited_us"), F.coalesce("reply_count", F.lit(0)).alias("reply_count"),
        F.when(k % 4 == 0, F.array(F.struct(F.lit("wave").alias("name"), k.alias("count")))).alias("reactions"), F.when(k % 8 == 0, F.array(F.struct(F.lit("a.png").alias("name"), (k % 16 == 0).alias("huddle")))).alias("files"),
        F.when(k % 7 == 0, F.array(F.struct(F.lit("").alias("pretext"), F.lit("T").alias("title"), F.lit(None).cast("string").alias("title_link"), F.lit("_x_").alias("text"), F.lit("http://z").alias("from_url"), F.lit("f").alias("fallback")))).alias("attachments"),
    )
    return m.select("channel_id", "us", "ts", render.message_block(ZONE).alias("block"))


@query(f"""{LOG}, {ACTIVE_SQL} SELECT channel_id, msg_ts AS ts, 'hello-u' || k || CASE WHEN k % 7 = 0 THEN '-t-x-http-z' ELSE '' END || CASE WHEN k % 4 = 0 THEN '-wave-' || k ELSE '' END AS slug FROM act""")
def t10_thread_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of threads from their first message's own text."""
    return t2_message_blocks(spark, sf_dir).select("channel_id", "ts", render.thread_slug(F.col("block"), F.col("ts")).alias("slug"))


@query(f"""{_BLOCKS_SQL}, dy AS (SELECT channel_id, strftime(timezone('{ZONE}', timezone('UTC', make_timestamp(us))), '%Y-%m-%d') AS day, string_agg(block, chr(10) ORDER BY ts, block) AS body FROM bk GROUP BY 1, 2)
SELECT channel_id, day, '---' || chr(10) || 'channel: n' || channel_id || chr(10) || 'channel_id: ' || channel_id || chr(10) || 'date: ' || day || chr(10) || '---' || chr(10) || body AS document FROM dy""")
def t7_day_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = t2_message_blocks(spark, sf_dir).withColumn("name", F.concat(F.lit("n"), "channel_id"))
    return render.day_documents(b, ZONE)


@query(f"{LOG} SELECT channel_id, strftime(timezone('{ZONE}', timezone('UTC', make_timestamp(us))), '%Y-%m') AS month, strftime(timezone('{ZONE}', timezone('UTC', make_timestamp(us))), '%d') AS day, count(*) AS n FROM log WHERE kind = 'message' GROUP BY ALL")
def q30_known_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = a.channel_log(spark, sf_dir).filter("kind = 'message'")
    return m.groupBy("channel_id", times.local(F.col("us"), ZONE, "yyyy-MM").alias("month"), times.local(F.col("us"), ZONE, "dd").alias("day")).agg(F.count("*").alias("n"))


@query(f"""WITH d AS (SELECT DISTINCT CAST(CAST(ts AS DATE) + CAST(event_id % 366 AS INTEGER) AS VARCHAR)[:10] AS day FROM events), z AS (SELECT unnest(['UTC', 'Pacific/Auckland', 'America/Los_Angeles', 'Europe/Berlin']) AS zone)
SELECT day, zone, epoch_us(timezone(zone, CAST(day AS TIMESTAMP))) AS from_us, epoch_us(timezone(zone, CAST(day AS TIMESTAMP) + INTERVAL 1 DAY)) AS to_us FROM d, z""")
def c3_local_day_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of a year of events, of 23, 24 and 25 hours, in four zones."""
    out = None
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    days = e.select(F.date_add(times.utc_day(a.micros("ts")), (F.col("event_id") % 366).cast("int")).cast("string").alias("day")).distinct()
    for zone in ("UTC", "Pacific/Auckland", "America/Los_Angeles", "Europe/Berlin"):
        a_, b_ = times.local_day_range(F.col("day").cast("date"), zone)
        one = days.select("day", F.lit(zone).alias("zone"), a_.alias("from_us"), b_.alias("to_us"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"{LOG}, {_DAYS_SQL}, g AS (SELECT channel_id, {_DATE.format('a')} AS f, {_DATE.format('b')} AS l, b - a + 1 AS n FROM gp WHERE b >= a) SELECT channel_id, string_agg('- ' || f || CASE WHEN n = 1 THEN ' (1 day)' ELSE ' → ' || l || ' (' || n || ' days)' END, chr(10) ORDER BY f) AS report FROM g GROUP BY 1")
def t9_gap_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _gaps(spark, sf_dir).select("channel_id", F.col("first_missing").cast("string").alias("first_missing"), F.col("last_missing").cast("string").alias("last_missing"), "n_missing")
    return render.gap_report(g)


@query(f"""{LOG}, {_DAYS_SQL}, g AS (SELECT channel_id, {_DATE.format('a')} AS f, {_DATE.format('b')} AS l, b - a + 1 AS n FROM gp WHERE b >= a)
SELECT channel_id, CAST(sum(n) AS BIGINT) AS n_missing, '## n' || channel_id || ' (`' || channel_id || '`) — ' || CAST(sum(n) AS BIGINT) || ' missing day(s), ' || count(*) || ' range(s)' || chr(10) || chr(10) || string_agg('- ' || f || CASE WHEN n = 1 THEN ' (1 day)' ELSE ' → ' || l || ' (' || n || ' days)' END, chr(10) ORDER BY f) || chr(10) AS section FROM g GROUP BY 1""")
def t9_workspace_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of the workspace's report, the largest holes first."""
    g = _gaps(spark, sf_dir).select("channel_id", F.col("first_missing").cast("string").alias("first_missing"), F.col("last_missing").cast("string").alias("last_missing"), "n_missing")
    names = g.select("channel_id").distinct().withColumn("name", F.concat(F.lit("n"), "channel_id"))
    return render.workspace_sections(g, names)


_ORIGINALS = (1_704_672_000_000_000, 1_705_881_600_000_000)


@query(f"""{LOG}, e AS (SELECT *, coalesce(msg_ts, deleted_ts) AS ts FROM log WHERE kind IN ('message', 'message_changed', 'message_deleted')), r AS (SELECT * FROM e WHERE CAST(ts AS DECIMAL(20, 6)) >= {_ORIGINALS[0] // 1_000_000} AND CAST(ts AS DECIMAL(20, 6)) < {_ORIGINALS[1] // 1_000_000}),
o AS (SELECT *, row_number() OVER (PARTITION BY stream, ts ORDER BY id) AS rn FROM r WHERE kind = 'message' AND (thread_ts IS NULL OR thread_ts = msg_ts)),
n AS (SELECT o.stream, o.ts, '## ' || {_clock("o.us")} || chr(10) || 'k' || o.k AS body, (SELECT string_agg('<sub>edited ' || strftime(make_timestamp(us), '%H:%M') || ' UTC</sub>', chr(10) ORDER BY us) FROM r x WHERE x.stream = o.stream AND x.ts = o.ts AND kind = 'message_changed') AS ed,
  (SELECT arg_max(us, id) FROM r x WHERE x.stream = o.stream AND x.ts = o.ts AND kind = 'message_deleted') AS dl FROM o WHERE rn = 1),
b AS (SELECT stream, ts, concat_ws(chr(10), body, ed, CASE WHEN dl IS NOT NULL THEN '<sub>**deleted ' || strftime(make_timestamp(dl), '%H:%M') || ' UTC**</sub>' END) || chr(10) AS t, dl FROM n)
SELECT stream, ts, CASE WHEN dl IS NOT NULL THEN '~~' || chr(10) || t || '~~' || chr(10) ELSE t END AS block FROM b""")
def q7_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was posted in a range, each with its edits and deletion noted below it."""
    log = a.channel_log(spark, sf_dir)
    texts = log.filter("kind = 'message'").select(F.col("id").alias("original_id"), F.concat(F.lit("## "), times.local(F.col("us"), ZONE, "HH:mm"), F.lit("\nk"), "k", F.lit("\n")).alias("text"))
    found = folds.originals(log, *_ORIGINALS).join(texts, "original_id")
    edits = F.transform(F.filter(F.split("edit_times", ","), lambda x: x != ""), lambda x: x.cast("bigint"))
    return found.select("stream", "ts", render.annotated_original(F.col("text"), edits, F.col("deleted_us"), lambda us: times.local(us, "UTC", "HH:mm")).alias("block"))


@query(f"""{LOG} SELECT id, concat_ws(chr(10) || chr(10), CASE WHEN k % 3 = 0 THEN '**@U' || k || '** says **loud**' ELSE '**@U' || k || '** says' END, CASE WHEN k % 5 > 0 THEN 'the end' END) AS text FROM log WHERE kind = 'message'""")
def t12_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a talk, of which some are empty or of another type."""
    k = F.col("k")
    el = lambda kind, name, text, bold: F.struct(F.lit(kind).alias("type"), name.alias("name"), text.alias("text"), bold.alias("bold"))
    none, no = F.lit(None).cast("string"), F.lit(False)
    first = F.array(el("user", F.concat(F.lit("U"), k), none, no), el("text", none, F.lit(" says "), no), el("text", none, F.when(k % 3 == 0, " loud ").otherwise(""), k % 3 == 0))
    section = lambda kind, elements: F.struct(F.lit(kind).alias("type"), elements.alias("elements"))
    last = F.array(el("text", none, F.when(k % 5 > 0, " the end ").otherwise("  "), no))
    sections = F.array(section("rich_text_section", first), section("rich_text_list", first), section("rich_text_section", last))
    return a.channel_log(spark, sf_dir).filter("kind = 'message'").select("id", render.transcript(sections).alias("text"))


@query(f"""{LOG}, m AS (SELECT id, us // 86400000000 AS day, msg_ts AS ts, unnest(CASE WHEN k % 2 = 0 THEN ['h' || k % 3, 'x', 'h0'] ELSE ['x'] END) AS name, unnest(CASE WHEN k % 2 = 0 THEN [0, 1, 2] ELSE [0] END) AS place FROM log WHERE kind = 'message' AND (thread_ts IS NULL OR thread_ts = msg_ts))
SELECT id, place, CASE WHEN n > 1 THEN name || '-' || n ELSE name END AS unique_slug FROM (SELECT *, row_number() OVER (PARTITION BY day, name ORDER BY ts, id, place) AS n FROM m WHERE name <> 'x')""")
def q35_day_huddles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The huddles among the files of each day's messages outside threads, with names of their own."""
    m = a.channel_log(spark, sf_dir).filter("kind = 'message' and (thread_ts is null or thread_ts = msg_ts)")
    file = lambda name, huddle: F.struct(name.alias("name"), F.lit(huddle).alias("huddle"))
    files = F.when(F.col("k") % 2 == 0, F.array(file(F.concat(F.lit("h"), F.col("k") % 3), True), file(F.lit("x"), False), file(F.lit("h0"), True))).otherwise(F.array(file(F.lit("x"), False)))
    return render.day_huddles(m.select("id", F.floor(F.col("us") / times.DAY_US).alias("day"), F.col("msg_ts").alias("ts"), files.alias("files"))).select("id", "place", "unique_slug")


@query()
def t11_canvas_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", t.canvas_markdown(F.col("html")).alias("markdown"))


@query()
def c9_slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accents are taken apart in Python; tests hold it against a plain version, and the next query the rest by SQL."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", t.slugify(F.col("text")).alias("slug"))


@query("""WITH b AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '-', 'g'), '-') AS b FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '[^\\x00-\\x7F]')),
c AS (SELECT doc_id, b, left(b, 60) AS c FROM b) SELECT doc_id, CASE WHEN length(b) <= 60 THEN b WHEN contains(c, '-') AND length(c) - strpos(reverse(c), '-') > 20 THEN left(c, length(c) - strpos(reverse(c), '-')) ELSE c END AS slug FROM c""")
def c9_slugify_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all documents without other letters than ASCII's."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").filter(~F.coalesce("text", F.lit("")).rlike(r"[^\x00-\x7F]")).select("doc_id", t.slugify(F.col("text")).alias("slug"))


@query("SELECT c_custkey, CASE WHEN length(b) <= 60 THEN b ELSE left(b, 60) END AS slug FROM (SELECT c_custkey, trim(regexp_replace(lower(c_name || ' / ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '-') AS b FROM customer)")
def c9_slugify_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", t.slugify(F.concat_ws(" / ", "c_name", "c_mktsegment"), plain=True).alias("slug"))


@query(f"""{LOG}, u AS (SELECT id, CASE k % 6 WHEN 0 THEN 'https://w.chat.com/archives/' || channel_id WHEN 1 THEN 'https://w.chat.com/archives/' || channel_id || '/p12ab' WHEN 2 THEN 'https://w.chat.com/files/x' ELSE 'https://w.chat.com/archives/' || channel_id || '/p' || us || CASE WHEN k % 6 = 3 THEN '?thread_ts=1.5' ELSE '' END END AS url, k, channel_id, us FROM log WHERE kind = 'message')
SELECT id, CASE WHEN k % 6 NOT IN (1, 2) THEN channel_id END AS channel_id, CASE WHEN k % 6 > 2 THEN left(CAST(us AS VARCHAR), 10) || '.' || substr(CAST(us AS VARCHAR), 11) END AS message_ts, CASE WHEN k % 6 = 3 THEN '1.5' END AS thread_ts, CASE k % 6 WHEN 1 THEN 'bad time' WHEN 2 THEN 'no archive' END AS error FROM u""")
def c10_permalinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    base = F.concat(F.lit("https://w.chat.com/archives/"), "channel_id")
    url = F.when(k % 6 == 0, base).when(k % 6 == 1, F.concat(base, F.lit("/p12ab"))).when(k % 6 == 2, "https://w.chat.com/files/x").otherwise(F.concat(base, F.lit("/p"), "us", F.when(k % 6 == 3, "?thread_ts=1.5").otherwise("")))
    return a.channel_log(spark, sf_dir).filter("kind = 'message'").select("id", t.permalink(url).alias("p")).select("id", "p.*")


@query("SELECT event_id, json_exists(props, '$.k') AS has_k, json_exists(props, '$.z') AS has_z FROM events")
def p2_json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", t.json_has_key(F.col("props"), "k").alias("has_k"), t.json_has_key(F.col("props"), "z").alias("has_z"))


@query(f"{CL} SELECT channel_id, name FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY off DESC) AS rn FROM cl WHERE kind = 'channel_added') WHERE rn = 1")
def q37_name_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renames carry other fields than this map reads, so they never show in it."""
    return latest_per_key(a.channel_list_log(spark, sf_dir).filter("kind = 'channel_added'"), ["channel_id"], [F.desc("off")]).select("channel_id", "name")


@query(f"{LOG}, h AS (SELECT id, channel_id, us // 86400000000 AS day, 'h' || k % 3 AS slug, msg_ts AS ts FROM log WHERE kind = 'message' AND k % 2 = 0) SELECT id, CASE WHEN n > 1 THEN slug || '-' || n ELSE slug END AS unique_slug FROM (SELECT *, row_number() OVER (PARTITION BY day, slug ORDER BY ts, id) AS n FROM h)")
def q35_huddles(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = a.channel_log(spark, sf_dir).filter("kind = 'message' and k % 2 = 0")
    h = m.select("id", F.floor(F.col("us") / times.DAY_US).alias("day"), F.concat(F.lit("h"), F.col("k") % 3).alias("slug"), F.col("msg_ts").alias("ts"))
    return render.huddles(h).select("id", "unique_slug")


@query("""SELECT event_id, '{"a":[1,null,"x' || k || '"],"b":{"k":' || k || ',"z":"é"}}' AS value FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k % 5 > 0
UNION ALL SELECT event_id, NULL FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 = 0""")
def c14_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects written in another order of keys and with spaces, some of them broken."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    value = F.concat(F.lit('{ "b" : {"z": "é", "k": '), k, F.lit('}, "a": [1, null, "x'), k, F.when(k % 5 > 0, '"] }').otherwise('"'))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", t.canonical_json(value).alias("value"))
