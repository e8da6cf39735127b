"""String-exact cases of the text layer, files and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from strandlog.functions import text as t
from strandlog.functions import times
from strandlog.operators import folds, render
from strandlog.sources import adapter, files
from strandlog.streaming import apply

CASES = [
    ("<@U1|old> hi", "<@U1> hi"), ("<#C1|x>", "<#C1>"), ("<https://x.org/a|la bel>", "[la bel](https://x.org/a)"), ("<http://y.org>", "http://y.org"), ("<!here> <!channel> <!everyone>", "@here @channel @everyone"),
    ("<!subteam^S1|@team>", "@team"), ("<!subteam^S1>", "@S1"), ("*b*", "**b**"), ("**b**", "**b**"), ("_i_", "*i*"), ("__i__", "__i__"), ("~s~", "~~s~~"), ("*a\nb*", "*a\nb*"), ("", ""), (None, ""),
]


@pytest.mark.parametrize("text, want", CASES)
def test_structural(spark, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(t.structural(F.col("x"))).first()[0] == want


@pytest.mark.parametrize(
    "text, want",
    [("Ça va, élan!", "ca-va-elan"), ("!!!", ""), (None, ""), ("a" * 70, "a" * 60), ("word " * 20, "-".join(["word"] * 12)), ("short-" + "x" * 80, ("short-" + "x" * 80)[:60])],
)
def test_slugify(spark, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(t.slugify(F.col("x"))).first()[0] == want


def test_canonical_json(spark):
    d = spark.createDataFrame([('{"b": 1, "a": [2, null]}',), ('{"a":[2,null],"b":1}',), ("{",), (None,)], "x string")
    got = [r[0] for r in d.select(t.canonical_json("x")).collect()]
    assert got == ['{"a":[2,null],"b":1}'] * 2 + [None, None]


def test_json_key_with_null(spark):
    d = spark.createDataFrame([('{"a": null}',), ("{}",), (None,)], "x string")
    assert [r[0] for r in d.select(t.json_has_key(F.col("x"), "a")).collect()] == [True, False, False]


def test_resolve(spark):
    blocks = spark.createDataFrame([(1, "<@U1> and <@U2> in <#C1>"), (2, "none"), (3, "<@U9|lab> <x>")], "key long, block string")
    users = spark.createDataFrame([("U1", "<#C1>"), ("U2", "")], "user_id string, display_name string")
    channels = spark.createDataFrame([("C1", "general")], "channel_id string, name string")
    got = {r.key: (r.resolved, r.missed) for r in render.resolve(blocks, users, channels, "key").collect()}
    assert got == {1: ("@<#C1> and @U2 in #general", ["U2"]), 2: ("none", []), 3: ("@lab <x>", [])}  # names go in as they are


def test_message_block(spark):
    schema = "us long, user string, text string, edited_us long, attachments array<struct<pretext:string,title:string,title_link:string,text:string,from_url:string,fallback:string>>, reactions array<struct<name:string,count:long>>, files array<struct<name:string,huddle:boolean>>, reply_count long, ts string, thread_ts string"
    us = 12 * 3_600_000_000
    d = spark.createDataFrame([(us, "U1", "*x*", us + 60_000_000, [("", "T", "http://l", "", "http://u", "f"), ("", "", "", "", "", "fall")], [("a", 2), ("b", 1)], [("n.png", False), ("h", True)], 3, "1", "1"), (us, "bot", "", None, None, None, None, 0, "2", None)], schema)
    got = [r[0] for r in d.select(render.message_block("UTC")).collect()]
    assert got[0] == "## 12:00 <@U1> *(edited 12:01)*\n\n**x**\n\n**[T](http://l)**\n\nfall\n\n:a: 2  :b: 1\n\n📎 [n.png](attachments/n.png)\n\n[Huddle Notes](h)\n\n> Thread: 3 replies\n"
    assert got[1] == "## 12:00 @bot\n"


def test_canvas(spark):
    page = '<body><nav>x</nav><h1 class="a"> Title </h1><p>one <b>two</b> <a href="/l">link</a><br>three &amp; four</p><ul><li>i</li></ul><script>no()</script></body>tail'
    assert spark.createDataFrame([(page,), ("<p>no heading</p>",)], "x string").select(t.canvas_markdown(F.col("x"))).collect()[0][0] == "# Title\n\none **two** [link](/l)\nthree & four\n\n- i"


@pytest.mark.parametrize(
    "page, want",
    [
        ("<h1>A</h1><br><b>x</b><blockquote>q</blockquote>", "# A\n\n**x**q"), ("<h1>A</h1><input type=\"checkbox\" checked>done <input type=\"checkbox\"/>open <link rel=x>y", "# A\n[x] done [ ] open y"),
        ("<h1>A</h1><i>it</i> <em>em</em> <strong>s</strong><hr>t", "# A\n*it* *em* **s**\n---\nt"), ("<h1>A</h1><p>open <b>never closed<p>next", "# A\n\nopen never closed\nnext"), ("<h1>A</h1><img alt=\"smile\" src=x>smile</img> <img src=y> :smile:smile:", "# A\n:smile: :smile:"),
        ("<h2>before</h2><h1>A</h1><h3> deep </h3></i><ul><li>a<li>b</li></ul>", "# A\n\n### deep\na\n- b"), ("<h1>A &lt;b&gt;</h1>&amp;nbsp;", "# A <b>\n&nbsp;"),
    ],
)
def test_canvas_cases(spark, page, want):
    assert spark.createDataFrame([(page,)], "x string").select(t.canvas_markdown(F.col("x"))).first()[0] == want


def test_canvas_takes_few_pages_at_once():
    """Pages reach Python in small batches of rows, not in Arrow batches of thousands."""
    from pyspark.util import PythonEvalType

    assert t.canvas_markdown.evalType == PythonEvalType.SQL_BATCHED_UDF


def test_canvas_of_all_pages(spark, sf):
    """Against a plain version for the few tags that these pages have."""
    import html
    import re

    def plain(page: str) -> str | None:
        at = page.find("<h1")
        if at < 0:
            return None
        x = re.sub(r"<(b)>(.*?)</b>", r"**\2**", page[at:].split("</body>")[0], flags=re.S)
        x = re.sub(r"<h1>\s*(.*?)\s*</h1>", r"\n# \1\n", x, flags=re.S)
        x = html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<p>|</p>|<br>", "\n", x)))
        return re.sub(r"\n{3,}", "\n\n", re.sub(" +", " ", re.sub(r"([a-z_0-9-]+):\1", r"\1", x))).strip()

    pages = spark.read.parquet(f"{sf}/pages.parquet").select("html", t.canvas_markdown("html").alias("m")).collect()
    assert [r.m for r in pages] == [plain(r.html) for r in pages] and any(r.m for r in pages)


def test_structural_of_all_texts(spark, sf):
    """Against the rules read by another engine of expressions, over all made-up markup."""
    import re

    from strandlog.plans.text import conversation_markup

    def plain(x: str) -> str:
        x = re.sub(r"<([@#])([UC][A-Z0-9]+)\|[^>]+>", lambda m: f"<{m[1]}{m[2]}>" if m[1] + m[2][0] in ("@U", "#C") else m[0], x)
        x = re.sub(r"<(https?://[^|>]+)(?:\|([^>]+))?>", lambda m: f"[{m[2]}]({m[1]})" if m[2] else m[1], x)
        x = re.sub(r"<!(?:(here|channel|everyone)|subteam\^[A-Z0-9]+\|(@[^>]+)|subteam\^([A-Z0-9]+))>", lambda m: m[2] or "@" + (m[1] or m[3]), x)
        for c, to in (("*", "**"), ("_", "*"), ("~", "~~")):
            x = re.sub(rf"(?<!{re.escape(c)})\{c}([^{re.escape(c)}\n]+)\{c}(?!{re.escape(c)})", lambda m, to=to: to + m[1] + to, x)
        return x

    rows = conversation_markup(spark, sf).select("m", t.structural(F.col("m")).alias("s")).collect()
    assert [r.s for r in rows] == [plain(r.m) for r in rows]


def test_slugs_of_all_documents(spark, sf):
    import re
    import unicodedata

    def plain(x: str | None) -> str:
        x = re.sub("[^a-z0-9]+", "-", unicodedata.normalize("NFKD", x or "").encode("ascii", "ignore").decode().lower()).strip("-")
        cut = x[:60]
        return x if len(x) <= 60 else cut[: cut.rfind("-")] if cut.rfind("-") > 20 else cut

    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text", t.slugify(F.col("text")).alias("s")).collect()
    assert [r.s for r in rows] == [plain(r.text) for r in rows]


def test_thread_slug(spark):
    d = spark.createDataFrame([("## 12:00 <@U1>\n\nAn idea: x\n\n:a: 2  :b: 1\n\n📎 [n](m)\n\n> Thread: 3 replies\n", "1.5"), ("## 12:00 @bot\n", "1.5"), ("## 1\n\n!!!\n", "2.5")], "b string, ts string")
    assert [r[0] for r in d.select(render.thread_slug(F.col("b"), F.col("ts"))).collect()] == ["an-idea-x", "ts-1.5", "ts-2.5"]


def test_days_of_other_lengths(spark):
    d = spark.createDataFrame([("2024-03-31",), ("2024-10-27",), ("2024-06-01",)], "d string")
    a, b = times.local_day_range(F.col("d").cast("date"), "Europe/Berlin")
    assert [r[0] for r in d.select((b - a) / 3_600_000_000).collect()] == [23, 25, 24]


def test_original_block(spark):
    d = spark.createDataFrame([("## h\n\nbody\n", [60_000_000], 120_000_000), ("x\n", [], None)], "b string, e array<long>, g long")
    got = [r[0] for r in d.select(render.annotated_original(F.col("b"), F.col("e"), F.col("g"), lambda us: times.local(us, "UTC", "HH:mm"))).collect()]
    assert got == ["~~\n## h\n\nbody\n<sub>edited 00:01 UTC</sub>\n<sub>**deleted 00:02 UTC**</sub>\n~~\n", "x\n"]


def test_day_files(spark, tmp_path):
    (tmp_path / "C1").mkdir()
    (tmp_path / "C1" / "2024-01-01.json").write_text(json.dumps([{"ts": "1.1", "user": "", "bot_id": "B1", "text": "x", "other": 1}, {"ts": "1.2"}]))
    (tmp_path / "C1" / "2024-01-02.json").write_text("[]")
    (tmp_path / "C1" / "2024-01-03.json").write_text("{broken")
    got = [(r.channel_id, r.day, r.ts, r.user) for r in files.read_day_files(spark, str(tmp_path)).orderBy("ts").collect()]
    assert got == [("C1", "2024-01-01", "1.1", "B1"), ("C1", "2024-01-01", "1.2", "unknown")]


def test_snapshot_files(spark, tmp_path):
    lines = spark.createDataFrame([("channel:C1", "2", '{"ts": "2", "a": 1}'), ("channel:C1", "1", '{"ts": "1", "a": 2}')], "stream string, ts string, payload string")
    files.write_snapshot(lines, str(tmp_path / "s"))
    assert sorted(tuple(r) for r in files.read_snapshot(spark, str(tmp_path / "s"), "ts string, a long").select("ts", "a").collect()) == [("1", 2), ("2", 1)]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('{"ts": "1"}\n{oops\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_snapshot(spark, str(tmp_path / "bad"), "ts string").collect()


def test_a_hot_stream_is_written_in_parts_that_join(spark, tmp_path):
    import gzip

    whole = "spark.sql.adaptive.coalescePartitions.enabled"  # small parts would be written together
    spark.conf.set(whole, "false")

    rows = [("channel:HOT" if i % 10 else f"channel:C{i % 7}", f"{i:06d}", f'{{"ts": "{i:06d}", "b": {i % 3}}}') for i in range(4000)]
    path = str(tmp_path / "s")
    files.write_snapshot(spark.createDataFrame(rows, "stream string, ts string, payload string").repartition(8), path)
    spark.conf.unset(whole)
    parts = files.snapshot_parts(spark, path).filter("stream = 'channel_HOT'").orderBy("part").collect()
    sizes = [len(gzip.open(p.file.removeprefix("file:")).read().splitlines()) for p in parts]
    assert len(parts) > 1 and max(sizes) < 3 * 3600 / len(parts)
    joined = gzip.decompress(b"".join(open(p.file.removeprefix("file:"), "rb").read() for p in parts)).decode().splitlines()
    assert joined == [f'{{"b":{int(t) % 3},"ts":"{t}"}}' for s, t, _ in rows if s == "channel:HOT"]


def test_decisions(spark, tmp_path):
    d = spark.createDataFrame([("a", 1)], "path string, n long")
    for _ in range(2):
        files.append_decisions(d, str(tmp_path / "d"))
    (tmp_path / "d" / "part-x.txt").write_text("not json\n")
    assert files.read_decisions(spark, str(tmp_path / "d"), "path string, n long").count() == 2


def test_stream_equals_batch(spark, sf, tmp_path):
    log = adapter.channel_log(spark, sf)
    for i in range(3):  # arrives out of order, and the last file again
        log.filter(f"id % 3 = {2 - i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):
        apply.append_log(source, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    got = apply.state_of(spark, str(tmp_path / "log"), folds.snapshot_messages)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, folds.snapshot_messages(log).collect()))
    assert apply.cursors(spark.read.parquet(str(tmp_path / "log"))).count() == log.select("stream").distinct().count()


def test_first_in_stream_batch(spark):
    d = spark.createDataFrame([("a", 1), ("a", 1), (None, 1), (None, 1)], "k string, n long")
    assert apply.first_in_stream(d, ["k"]).count() == 3


def test_documents_by_channel_and_day(spark, tmp_path):
    d = spark.createDataFrame([("C1", "2024-01-01", "one\n"), ("C1", "2024-01-02", "two\n"), ("C2", "2024-01-03", "today\n")], "channel_id string, day string, document string")
    files.write_documents(d, str(tmp_path / "docs"), today="2024-01-03")
    files.write_documents(d.filter("day = '2024-01-02'").withColumn("document", F.lit("again\n")), str(tmp_path / "docs"))
    got = {str(p.relative_to(tmp_path / "docs").parent): p.read_text().strip() for p in (tmp_path / "docs").rglob("part-*.txt")}
    assert got == {"channel_id=C1/day=2024-01-01": "one", "channel_id=C1/day=2024-01-02": "again"}


def test_files_of_documents_and_snapshots_do_not_grow_with_channels(spark, tmp_path):
    n = lambda folder, name: len(list((tmp_path / folder).rglob(name)))
    d = spark.range(600).select(F.concat(F.lit("C"), F.col("id") % 300).alias("channel_id"), F.concat(F.lit("2024-01-0"), 1 + F.floor(F.col("id") / 300)).alias("day"), F.concat(F.lit("text \n\n"), "id", F.lit("\n")).alias("document"))
    files.write_day_documents(d, str(tmp_path / "docs"), today="2024-01-03")
    assert sorted(map(tuple, files.read_day_documents(spark, str(tmp_path / "docs")).collect())) == sorted(map(tuple, d.collect()))
    assert n("docs", "day=*") == 2 and n("docs", "part-*") < 20
    again = d.filter("day = '2024-01-02'").withColumn("document", F.lit("again"))
    files.write_day_documents(again.unionByName(again.withColumn("day", F.lit("2024-01-03"))), str(tmp_path / "docs"), today="2024-01-03")
    got = files.read_day_documents(spark, str(tmp_path / "docs"))
    assert {(r.day, r.document == "again", r["count"]) for r in got.groupBy("day", "document").count().groupBy("day", "document").agg(F.sum("count").alias("count")).filter("document = 'again'").collect()} == {("2024-01-02", True, 300)} and got.count() == 600
    lines = d.select("channel_id", "day", F.to_json(F.struct("day", "channel_id")).alias("payload"))
    files.write_shared_snapshot(lines, str(tmp_path / "s"), stream="channel_id", order="day")
    back = files.read_snapshot(spark, str(tmp_path / "s"), "channel_id string, day string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, d.select("channel_id", "day").collect())) and n("s", "part-*.gz") < 20


def test_failing_batch_is_replayed(spark, tmp_path):
    """A batch that fails stops the query; when it runs again nothing is lost and nothing comes twice."""
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).selectExpr("'s' as stream", "id as off").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def source(fail: bool):
        s = spark.readStream.schema("stream string, off long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return s.withColumn("off", F.when((F.col("off") == 15) & F.lit(fail), F.raise_error(F.lit("a bad row"))).otherwise(F.col("off")))

    with pytest.raises(Exception, match="a bad row"):
        apply.append_log(source(True), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    before = spark.read.parquet(str(tmp_path / "log")).count()
    assert before in (0, 10, 20)
    apply.append_log(source(False), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.off for r in spark.read.parquet(str(tmp_path / "log")).collect()) == list(range(30))


def test_drifted(spark):
    from strandlog.operators import ingest

    was = spark.createDataFrame([("a", "s", 1), ("a", "t", 2), ("b", "s", 1)], "path string, stream string, off long")
    assert [r.path for r in ingest.drifted(was, spark.createDataFrame([("s", 1), ("t", 3)], "stream string, off long")).collect()] == ["a"]


def test_range_scan_is_pushed_down(spark, sf):
    from strandlog import plans

    plan = plans.queries()["s1_range_scan"](spark, sf)._jdf.queryExecution().toString()
    assert "EqualTo(stream,channel:C7)" in plan and "GreaterThan(off,2)" in plan
