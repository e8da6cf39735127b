"""Running values in blocks against plain loops, with a key that holds half of the rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strandlog.operators import latest, queues, scan


def made(n: int = 3000, hot: float = 0.5) -> list[tuple]:
    r = random.Random(11)
    keys = ["hot" if r.random() < hot else r.choice(["a", "b", None, "d"]) for _ in range(n)]
    return [(k, r.randrange(n // 3), i, r.choice([None, r.randrange(50)]), r.random() < 0.1) for i, k in enumerate(keys)]


SCHEMA = "key string, us long, id long, v long, ok boolean"


def in_order(rows):
    per: dict = {}
    for x in sorted(rows, key=lambda x: (x[1], x[2])):
        per.setdefault(x[0], []).append(x)
    return per


@pytest.mark.parametrize("parts", [8, 10_000])  # 10,000: every key is hot
def test_counts_sums_and_last_values(spark, parts):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want_n, want_s, want_l, want_b = {}, {}, {}, {}
    for xs in in_order(rows).values():
        n = s = 0
        last = before = None
        for k, us, i, v, _ in xs:
            n, s = n + 1, s + (v or 0)
            want_b[i] = before
            want_l[i] = last = v if v is not None else last
            want_n[i], want_s[i], before = n, s, (us, v)
    order = ["us", "id"]
    assert {r.id: r.n for r in scan.running_count(df, "key", order, "n", parts).collect()} == want_n
    assert {r.id: r.s for r in scan.running_sum(df, "key", order, "v", "s", parts).collect()} == want_s
    assert {r.id: r.l for r in scan.running_last(df, "key", order, F.col("v"), "l", True, parts).collect()} == want_l
    assert {r.id: r.b and tuple(r.b) for r in scan.row_before(df, "key", order, ["us", "v"], "b", parts).collect()} == want_b


def test_no_block_is_large(spark):
    df = spark.createDataFrame(made(20_000), SCHEMA)
    cut, any_cut = scan.blocks(df, "key", ["us", "id"], 16)
    sizes = {(r.key, r._block): r["count"] for r in cut.groupBy("key", "_block").count().collect()}
    hot = [n for (k, _), n in sizes.items() if k == "hot"]
    assert any_cut and len(hot) > 10 and max(hot) < 2 * 20_000 / 16 and sum(sizes.values()) == 20_000
    plain, none = scan.blocks(spark.range(1000).withColumn("key", F.col("id") % 500), "key", ["id"])
    assert not none and plain.filter("_block > 0").count() == 0


def test_as_of_and_episodes_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(scan, "PARTS", 4)
    for f in (scan.running_count, scan.running_sum, scan.running_last, scan.row_before):
        monkeypatch.setattr(f, "__defaults__", tuple(4 if d == 64 else d for d in f.__defaults__))
    rows = made(2000, 0.7)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: r.sid for r in latest.as_of(df.filter("id % 2 = 0").select("key", "us", "id"), df.filter("id % 2 = 1").select("key", F.col("us").alias("sus"), F.col("id").alias("sid")), "key", "us", "sus").collect()}
    at = {x[2]: x[1] for x in rows}
    for xs in in_order(rows).values():
        states = [x for x in xs if x[2] % 2]
        for x in (x for x in xs if x[2] % 2 == 0):
            newest = max((s[1] for s in states if s[1] <= x[1]), default=None)
            assert (got[x[2]] is None) == (newest is None) and (newest is None or at[got[x[2]]] == newest)
    attempts = df.select(F.coalesce("key", F.lit("none")).alias("channel_id"), "us", "id", "ok")
    announced = sorted((r.channel_id, r.us) for r in queues.degraded_episodes(attempts, 30).collect())
    want = []
    for k, xs in in_order(rows).items():
        began, told = None, False
        for _, us, _, _, ok in xs:
            if ok:
                began, told = None, False
            else:
                began = us if began is None else began
                if us - began >= 30 and not told:
                    want.append((k or "none", us))
                    told = True
    assert announced == sorted(want) and want


def test_user_changes_of_a_hot_user(spark, monkeypatch):
    monkeypatch.setattr(scan.running_last, "__defaults__", (True, 4))
    monkeypatch.setattr(scan.row_before, "__defaults__", (4,))
    r = random.Random(3)
    rows = [("U1" if i % 5 else f"U{i % 7}", i, r.choice(["a", "b", None]), r.choice(["x", None])) for i in range(800)]
    got = sorted((x.user_id, x.off, x.change) for x in queues.user_changes(spark.createDataFrame(rows, "user_id string, off long, display string, real string")).collect())
    seen, want = {}, []
    for u, i, d, real in rows:
        if u not in seen:
            want.append((u, i, "added"))
        else:
            want += [(u, i, "renamed")] * (d != seen[u][0]) + [(u, i, "profile")] * (real != seen[u][1])
        seen[u] = (d, real)
    assert got == sorted(want)


def test_a_written_table_follows_its_source(spark, tmp_path):
    import shutil

    from strandlog.sources import shared

    source = str(tmp_path)
    read = lambda: shared.written_once(spark, source, "odd", lambda: spark.read.parquet(f"{source}/t.parquet").filter("id % 2 = 1"), ["id"], ["t"])
    spark.range(10).write.parquet(f"{source}/t.parquet")
    first = read()
    assert first.count() == 5 and read().inputFiles() == first.inputFiles()
    spark.range(30).write.mode("overwrite").parquet(f"{source}/t.parquet")
    assert read().count() == 15
    folder = read().inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    shutil.rmtree(folder)
    assert read().count() == 15


def test_runs_are_shuffled_once(spark, sf):
    """The run log's derivation brings an order's lines together once, and the marks of a walk come of one pass over the pages."""
    from strandlog.operators import inventory
    from strandlog.sources import adapter as a

    exchanges = lambda d: d._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert exchanges(a.derived_run_log(spark, sf)) == 1
    assert exchanges(inventory.walk_marks(a.run_log(spark, sf), 60, 40, 150)) == 1
