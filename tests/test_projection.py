"""The projection against a service that applies events one by one, and small rules of walks and keys."""

from __future__ import annotations

import random

import pytest

from strandlog.operators import ingest, projection, resume

LOG = "channel_id string, off long, kind string, msg_ts string, deleted_ts string, thread_ts string, previous_thread_ts string, reply_count long"


def random_log(seed: int, n: int = 600) -> list[tuple]:
    r, out = random.Random(seed), []
    for off in range(1, n + 1):
        ts, thread = f"{r.randrange(12)}.0", r.choice([None, f"{r.randrange(4)}.0"])
        kind = r.choice(["message", "message", "message_changed", "message_deleted"])
        if kind == "message_deleted":
            out.append((f"C{r.randrange(3)}", off, kind, None, r.choice([ts, ts, ts, None]), None, r.choice([None, None, thread]), None))
        else:
            out.append((f"C{r.randrange(3)}", off, kind, r.choice([ts, ts, ts, None]), None, thread, None, r.choice([None, 0, 1, 3])))
    return out


def applied(rows):
    """(rows of messages with their counts, replies) after each event in turn."""
    top, replies = {}, {}

    def refresh(c, thread, down=False):
        if (c, thread) in top:
            n = sum(k[:2] == (c, thread) for k in replies)
            top[c, thread] = n if down else max(n, top[c, thread])

    for c, off, kind, ts, gone, thread, before, n in rows:
        if kind != "message_deleted":
            if ts is None:
                continue
            if thread is not None and thread != ts:
                replies[c, thread, ts] = off
                refresh(c, thread)
            else:
                top[c, ts] = max(top.get((c, ts), 0), n or 0)
                refresh(c, ts)
        elif gone is not None:
            if before is not None and before != gone:
                replies.pop((c, before, gone), None)
                refresh(c, before, down=True)
            elif (c, gone) in top:
                del top[c, gone]
            else:
                for key in [k for k in replies if (k[0], k[2]) == (c, gone)]:
                    del replies[key]
                    refresh(c, key[1], down=True)
    return top, replies


@pytest.mark.parametrize("seed", range(4))
def test_projection_event_by_event(spark, seed):
    rows = random_log(seed)
    top, replies = applied(rows)
    l = spark.createDataFrame(rows, LOG).repartition(3)
    assert {(r.channel_id, r.thread_ts, r.ts): r.off for r in projection.thread_rows(l).collect()} == replies
    assert {(r.channel_id, r.ts): r.reply_count for r in projection.reply_counts(l).collect()} == top


def test_thread_merge_event_by_event(spark):
    rows = random_log(9)
    base = [(c, "1.0", ts) for c in ("C0", "C1") for ts in ("1.0", "2.0", "3.0")]
    state = {(c, t): {x for a, b, x in base if (a, b) == (c, t)} for c, t, _ in base}
    for c, _, kind, ts, gone, thread, *_ in rows:
        if kind != "message_deleted" and ts is not None and (c, thread or ts) in state:
            state[c, thread or ts].add(ts)
        elif gone is not None:
            for (a, t), own in state.items():
                if a == c and gone != t:
                    own.discard(gone)
    l = spark.createDataFrame(rows, LOG)
    got = projection.thread_merge(spark.createDataFrame(base, "channel_id string, thread_ts string, ts string"), l).collect()
    assert {(r.channel_id, r.thread_ts, r.ts) for r in got} == {(c, t, x) for (c, t), own in state.items() for x in own}
    assert all(r.is_parent == (r.ts == r.thread_ts) for r in got)


def test_bumps_never_fall_below_zero(spark):
    r = random.Random(4)
    base = [("C", f"{i}", r.choice([0, 1, 2]), None) for i in range(30)]
    bumps = [("C", f"{r.randrange(33)}", off, r.choice([-3, -1, 1, 2]), r.choice([None, f"t{off}"])) for off in range(300)]
    want = {ts: (n, last) for _, ts, n, last in base}
    for _, ts, _, delta, last in bumps:
        if ts in want:
            want[ts] = (max(0, want[ts][0] + delta), last or want[ts][1])
    got = projection.bumped(spark.createDataFrame(base, "channel_id string, ts string, reply_count long, latest_reply string"), spark.createDataFrame(bumps, "channel_id string, ts string, off long, delta long, latest_reply string"))
    assert {x.ts: (x.reply_count, x.latest_reply) for x in got.collect()} == want


def test_families_event_by_event(spark):
    r, names = random.Random(6), sorted({c for cols in ingest.FAMILIES.values() for c in cols})
    shape = "id long, stream string, kind string, payload struct<" + ",".join(f"{c}:string" for c in names) + ">"
    rows = [(i, f"s{r.randrange(2)}", r.choice([*ingest.FAMILIES, "reaction_added"]), tuple(r.choice([None, "1", "2"]) if r.random() < 0.5 else "1" for _ in names)) for i in range(800)]
    seen, want = set(), set()
    for i, stream, kind, payload in rows:
        key = tuple(payload[names.index(c)] for c in ingest.FAMILIES.get(kind, ()))
        if not key or None in key or (stream, kind, key) not in seen:
            want.add(i)
            seen.add((stream, kind, key))
    assert {x.id for x in ingest.first_of_family(spark.createDataFrame(rows, shape)).collect()} == want


def test_worklist(spark):
    plan = spark.createDataFrame([("C", "a", "", True, 1, "x"), ("C", "b", "cur", False, 1, "x"), ("C", "c", "", False, 1, "x"), ("C", "d", "", False, 1, "x")], "channel_id string, thread_ts string, cursor string, done boolean, reply_count long, latest_reply string")
    found = spark.createDataFrame([("C", t, 9, "y") for t in "abce"], "channel_id string, thread_ts string, reply_count long, latest_reply string")
    got = {tuple(r)[1:] for r in resume.thread_worklist(plan, found).collect()}
    assert got == {("b", "cur", 1, "x"), ("c", "", 9, "y"), ("d", "", 1, "x"), ("e", "", 9, "y")}


def test_thread_lines(spark):
    blocks = [("C", "1", "text\n\n> Thread: 1 reply\n", 1), ("C", "2", "text\n", 0), ("C", "3", "text\n\n> Thread: 3 replies\n", 3), ("C", "4", "a\n> Thread: 2 replies\nb > Thread: 1 reply\n", 2), ("C", "5", "left\n", 7), ("C", "6", "", 0)]
    counts = [("C", "1", 2), ("C", "2", 1), ("C", "3", 0), ("C", "4", 5), ("C", "6", 1), ("X", "1", 9)]
    got = projection.thread_blocks(spark.createDataFrame(blocks, "channel_id string, ts string, block string, reply_count long"), spark.createDataFrame(counts, "channel_id string, ts string, reply_count long"))
    want = {"1": ("text\n\n> Thread: 2 replies\n", 2, True), "2": ("text\n\n> Thread: 1 reply\n", 1, True), "3": ("text\n", 0, True), "4": ("a\n> Thread: 5 replies\nb > Thread: 5 replies\n", 5, True), "5": ("left\n", 7, False), "6": ("\n\n> Thread: 1 reply\n", 1, True)}
    assert {r.ts: (r.block, r.reply_count, r.changed) for r in got.collect()} == want


def test_walk_marks_against_a_loop(spark):
    import random

    from strandlog.operators import inventory

    r, rows, want = random.Random(6), [], set()
    for run in range(30):
        total = last = 0
        warned = cut = False
        for page in range(r.randrange(1, 25)):
            n = r.choice([0, None, 5, 20, 60, 130])
            rows.append(("C", f"R{run}", "page", page, page, n))
            if not cut and total + (n or 0) > 300:
                cut = True
                want.add((f"R{run}", page, "aborted", total))
            if cut:
                continue
            total += n or 0
            if not warned and total >= 150 and n:
                warned = True
                want.add((f"R{run}", page, "warn_large", total))
            if total >= last + 50:
                last = total
                want.add((f"R{run}", page, "progress", total))
    d = spark.createDataFrame(rows, "channel_id string, run_id string, kind string, page long, id long, messages long")
    assert {(x.run_id, x.page, x.mark, x.messages) for x in inventory.walk_marks(d, 150, 50, 300).collect()} == want
    assert inventory.walk_marks(d.limit(0), 1, 1, 1).count() == 0


def test_own_joins_are_told_from_others(spark):
    from strandlog.operators import ingest

    pushes = [(1, 10, "member_joined_channel", "C", "ME", "1.0"), (2, 10, "member_joined_channel", "C", "U", "1.1"), (3, 1, "member_joined_channel", "C", "ME", None), (4, 20, "member_left_channel", "C", "ME", "2.0"), (5, 20, "channel_rename", "C", None, None), (6, 20, "channel_rename", "D", None, None), (7, 20, "channel_archive", None, None, None), (8, 20, "strange", "C", "ME", None)]
    states = spark.createDataFrame([("C", 5, "old"), ("C", 15, "new")], "channel_id string, valid_us long, name string")
    got = ingest.structural_events(spark.createDataFrame(pushes, "push_id long, us long, type string, channel string, user string, event_ts string"), states, "ME").collect()
    assert sorted((r.push_id, r.part, r.kind, r.payload) for r in got) == [
        (1, 0, "channel_added", '{"id":"C","name":"old"}'), (1, 1, "channel_member_joined", '{"channel_id":"C","user_id":"ME","event_ts":"1.0"}'), (2, 1, "channel_member_joined", '{"channel_id":"C","user_id":"U","event_ts":"1.1"}'),
        (3, 1, "channel_member_joined", '{"channel_id":"C","user_id":"ME"}'), (4, 1, "channel_member_left", '{"channel_id":"C","user_id":"ME","event_ts":"2.0"}'), (4, 2, "channel_member_changed", '{"channel_id":"C","is_member":false}'), (5, 0, "channel_renamed", '{"channel_id":"C","new_name":"new"}'),
    ]
