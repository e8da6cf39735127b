"""Streams whose events come late, twice and with holes, against a loop that applies them in order."""

from __future__ import annotations

import random

from pyspark.sql import Row

from strandlog.streaming import apply, ordered

C = ordered.COLUMNS


def made(seed: int = 4) -> list[Row]:
    r, out = random.Random(seed), []
    for s in ("a", "b", "c"):
        for off in range(1, 60):
            ts = f"t{r.randrange(12)}"
            kind = r.choice(["message", "message", "message_changed", "message_deleted", "parent_replied", "parent_replied", "other"])
            e = {"off": off, "kind": kind, "reply_count": r.choice([None, 1, 2])}
            e |= {"message": {"msg_ts": ts}, "message_changed": {"msg_ts": ts, "previous_ts": r.choice([ts, None, f"t{r.randrange(12)}"])}, "message_deleted": {"deleted_ts": ts}, "parent_replied": {"parent_ts": ts}, "other": {}}[kind]
            out.append(Row("stream", *C)(s, *(e.get(c) for c in C)))
    return out


def plain(events: list[Row]) -> tuple[dict, dict]:
    """(cursor of each stream, what stands) by a loop over each stream's gapless beginning."""
    per: dict = {}
    for e in events:
        per.setdefault(e.stream, {})[e.off] = e
    cursors, standing = {}, {}
    for s, by_off in per.items():
        n, here = 0, {}
        while n + 1 in by_off:
            n += 1
            e = by_off[n]
            if e.kind == "message_changed" and e.previous_ts and e.previous_ts != e.msg_ts:
                here.pop(e.previous_ts, None)
            if e.kind in ("message", "message_changed") and e.msg_ts:
                here[e.msg_ts] = (n, max(e.reply_count or 0, here[e.msg_ts][1] if e.msg_ts in here else 0))
            elif e.kind == "message_deleted":
                here.pop(e.deleted_ts, None)
            elif e.kind == "parent_replied" and e.parent_ts in here:
                here[e.parent_ts] = (n, here[e.parent_ts][1] + 1)
        cursors[s] = n
        standing |= {(s, ts): x for ts, x in here.items()}
    return cursors, standing


def test_events_are_applied_in_order_over_batches_and_restarts(spark, tmp_path):
    events = made()
    r = random.Random(9)
    missing = {("b", 31), ("c", 1)}
    batches = [[], [], []]
    for e in events:
        if (e.stream, e.off) not in missing:
            batches[r.randrange(3)].append(e)
    batches[1] += r.sample(batches[0], 20)  # again, in a later batch and in one batch
    batches[2] += r.sample(batches[2], 20)
    schema = f"stream string, {ordered.EVENT}"
    so_far, cursors = [], []
    for n, b in enumerate(batches):
        spark.createDataFrame(b, schema).write.mode("append").parquet(str(tmp_path / "in"))
        with ordered.with_rocks(spark):  # started anew each time
            q = ordered.in_order(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in")))
            apply.keep_changes(q, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
        so_far += b
        changes = spark.read.parquet(str(tmp_path / "out"))
        want_cursors, want = plain(so_far)
        got = {x.stream: x.applied for x in ordered.cursors_of(changes).collect()}
        assert got == want_cursors
        assert {(x.stream, x.ts): (x.off, x.reply_count) for x in ordered.messages_of(changes).collect()} == want
        assert {x.stream: x.applied for x in apply.cursors(spark.read.parquet(str(tmp_path / "in"))).collect()} == want_cursors
        cursors.append(got)
    assert cursors[-1]["b"] == 30 and cursors[-1]["c"] == 0 and cursors[-1]["a"] == 59
    assert all(x.get(s, 0) <= y[s] for x, y in zip(cursors, cursors[1:]) for s in x)


def test_cursors_of_odd_tables(spark):
    d = spark.createDataFrame([("a", 2), ("a", 3), ("b", 1), ("b", 1), ("b", 2), ("b", 4)], "stream string, off long")
    assert {tuple(x) for x in apply.cursors(d).collect()} == {("a", 0), ("b", 2)}
    assert apply.cursors(d.limit(0)).count() == 0


def test_a_page_is_a_batch_and_a_stopped_run_goes_on_behind_it(spark, tmp_path):
    from pyspark.sql import functions as F

    from strandlog.plans.streams import copy_pages
    from strandlog.sources import pages

    archive, out, progress = (str(tmp_path / x) for x in ("archive", "out", "progress"))
    rows = spark.range(1000).select((F.col("id") % 9).alias("page"), "id")
    schema = "page long, id long"
    read = lambda: pages.read_pages(spark, schema, archive, progress)
    kept = lambda: {(r.batch, r.page, r.n) for r in spark.read.parquet(out).groupBy("batch", "page").agg(F.count("*").alias("n")).collect()}
    pages.write_pages(rows.filter("page < 4"), archive, ended=False)
    copy_pages(read(), out, progress)
    assert {x[:2] for x in kept()} == {(k, k) for k in range(3)}  # the fourth may still be written
    copy_pages(read(), out, progress)
    assert {x[:2] for x in kept()} == {(k, k) for k in range(3)}
    pages.write_pages(rows.filter("page >= 4"), archive)
    copy_pages(read(), out, progress)
    assert kept() == {(k, k, 112 if k == 0 else 111) for k in range(9)}
    back = pages.read_pages(spark, schema, archive)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_silence_alone_fires(spark, tmp_path):
    """By the clock of the machine: nothing comes any more, and the key falls silent all the same."""
    import time

    from strandlog.streaming import keyed

    spark.createDataFrame([("a",), ("b",)], "key string").write.parquet(str(tmp_path / "in"))
    frames = spark.readStream.schema("key string").parquet(str(tmp_path / "in"))
    got = lambda: {(r.key, r.silent) for r in spark.read.schema("key string, ms long, silent boolean").parquet(str(tmp_path / "out")).collect()}

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")

    with ordered.with_rocks(spark):
        q = keyed.silences(frames, 1500).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(tmp_path / "progress")).trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 90
        while time.time() < until and not ((tmp_path / "out").exists() and got() == {("a", True), ("b", True)}):
            assert q.exception() is None
            time.sleep(0.5)
    finally:
        q.stop()
    assert got() == {("a", True), ("b", True)}


def test_corrections_of_the_stream_equal_the_batch(spark):
    from pyspark.sql import functions as F

    from strandlog.operators import queues
    from strandlog.plans.streams import kept
    from strandlog.streaming import keyed

    r = random.Random(8)
    rows = [(i, f"s{r.randrange(3)}", r.choice(["message", "message", "message_changed"]), r.choice(["1", "2", None]), f"c{r.randrange(4)}") for i in range(120)]
    d = spark.createDataFrame(rows, "id long, stream string, kind string, msg_ts string, content string")
    want = sorted(map(tuple, queues.corrections(d).collect()))
    assert sorted(map(tuple, kept(d.withColumn("arrival", F.floor(F.col("id") / 40)), keyed.corrections).select("stream", "msg_ts", "id", "content").collect())) == want and want


def test_keys_of_a_shard_share_their_calls_of_state(spark, tmp_path):
    """A batch of many keys touches as many rows of state as there are shards, by each of the operators on keyed state."""
    from pyspark.sql import functions as F

    from strandlog.streaming import keyed, shards

    rows = spark.range(600).select("id", F.concat(F.lit("s"), F.col("id") % 300).alias("key"), F.lit(1).cast("long").alias("off"), F.lit("message").alias("kind"), F.format_string("1704%06d.0", "id").alias("msg_ts"), F.lit("c").alias("content"))
    rows = rows.select("*", F.col("key").alias("stream"), *(F.lit(None).cast(t).alias(c) for c, t in (("previous_ts", "string"), ("deleted_ts", "string"), ("parent_ts", "string"), ("reply_count", "long"))))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    made = {"corrections": shards.by_rule(stream, keyed._Corrections(), "stream string, msg_ts string, id long, content string", shards=4), "in_order": ordered.in_order(stream, shards=4)}
    updated = {}
    for name, state in made.items():
        with ordered.with_rocks(spark):
            q = apply.keep_changes(state, str(tmp_path / name), str(tmp_path / f"{name}-progress"))
            q.awaitTermination()
        updated[name] = sum(s["numRowsUpdated"] for p in q.recentProgress for s in p["stateOperators"])
    assert 0 < updated["corrections"] <= 4 and 0 < updated["in_order"] <= 4 * (1 + 4)  # a value for each shard, and few blocks of messages
    assert spark.read.parquet(str(tmp_path / "in_order")).filter("what = 'cursor'").count() == 300


def test_due_moments_of_a_shard(spark):
    """Keys of one shard fall silent each at its own moment, with one timer for all, also exactly at the watermark."""
    from pyspark.sql import functions as F

    from strandlog.plans.streams import kept
    from strandlog.streaming import keyed, shards

    rows = [("a", 1000, 0), ("b", 1499, 0), ("c", 1500, 0), ("d", 1501, 0), ("z", 2500, 0), ("a", 2600, 1), ("y", 2601, 1)]
    d = spark.createDataFrame(rows, "key string, ms long, arrival long").withColumn("at", F.timestamp_millis("ms"))
    of = lambda f: shards.by_rule(f.withWatermark("at", "0 seconds"), keyed._Silence(1000), "key string, ms long, silent boolean", "eventTime", shards=1)
    got = {(r.key, r.ms, r.silent, r.run) for r in kept(d, of, 2).select("key", "ms", "silent", "run").collect()}
    assert got == {("a", 2000, True, 0), ("b", 2499, True, 0), ("c", 2500, True, 1), ("d", 2501, True, 1), ("a", 2600, False, 1)}
