"""Small logs that pin what the folds mean, also under another order of rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strandlog.operators import completeness, folds, inventory, latest, queues

LOG = "id long, stream string, channel_id string, off long, kind string, us long, k long, msg_ts string, previous_ts string, deleted_ts string, thread_ts string, reply_count long, latest_reply string, parent_ts string"
FIELDS = [f.split()[0] for f in LOG.split(", ")]
A, B, C = "1700000000.000001", "1700000001.000001", "1700000002.000001"


def log(spark, *events):
    out = []
    for i, e in enumerate(events, 1):
        row = {"id": i, "stream": "channel:C1", "channel_id": "C1", "off": i, "us": i * 1_000_000, "k": i} | e
        out.append(tuple(row.get(f) for f in FIELDS))
    return spark.createDataFrame(out, LOG)


def msg(ts, **x):
    return {"kind": "message", "msg_ts": ts} | x


def edit(ts, before, **x):
    return {"kind": "message_changed", "msg_ts": ts, "previous_ts": before} | x


def gone(ts):
    return {"kind": "message_deleted", "deleted_ts": ts}


def times(df, c="ts"):
    return sorted(r[c] for r in df.collect())


@pytest.mark.parametrize("shuffle", [False, True])
def test_active_messages(spark, shuffle):
    l = log(spark, msg(A), edit(A, A), msg(B), edit(C, B), gone(A), edit(A, A), msg("bad"), msg(None))
    l = l.repartition(3, "off") if shuffle else l
    assert times(folds.active_messages(l), "msg_ts") == [C]  # a deletion is final, a moved message leaves its old time


def test_latest_base_beats_earlier_edit(spark):
    assert folds.active_messages(log(spark, edit(A, A), msg(A))).first()["off"] == 2


def test_snapshot_brings_back(spark):
    l = log(spark, msg(A), gone(A), msg(A), msg(B), gone(B))
    assert times(folds.snapshot_messages(l)) == [A]
    assert times(folds.active_messages(l), "msg_ts") == []
    assert [r["id"] for r in folds.active_candidates(l).collect()] == [3]


def test_thread_parents(spark):
    notice = {"kind": "parent_replied", "parent_ts": A, "reply_count": 5, "latest_reply": B}
    l = log(spark, notice | {"parent_ts": C}, msg(A, reply_count=2), msg(B, reply_count=0), notice)
    assert [(r.parent_ts, r.reply_count, r.off) for r in folds.active_thread_parents(l).collect()] == [(A, 5, 4)]


CL = "channel_id string, off long, kind string, name string, is_member boolean, is_archived boolean, num_members long, is_im boolean, is_mpim boolean, created long"


def test_channels_two_stages(spark):
    rows = [
        ("C1", 1, "channel_added", "old", True, False, 5, False, False, 1), ("C1", 2, "channel_added", None, None, None, None, False, False, 1),
        ("C1", 3, "channel_renamed", "new", None, None, None, None, None, None), ("C2", 4, "channel_archived", None, None, True, None, None, None, None), ("C3", 5, "channel_member_joined", None, None, None, None, None, None, None),
    ]
    got = {r.channel_id: tuple(r)[1:] for r in folds.channels(spark.createDataFrame(rows, CL)).collect()}
    assert got == {"C1": ("new", None, None, None), "C2": (None, None, True, None)}


CHANNEL_ROWS = "channel_id string, off long, kind string, name string, is_member boolean, is_archived boolean, num_members long, is_im boolean, is_mpim boolean, im_user_id string, topic string, purpose string"
NARROW = ("channel_renamed", "channel_archived", "channel_unarchived", "channel_member_changed")


def channel_rows(seed: int, n: int = 400) -> list[tuple]:
    """Rows of a channel list with absent fields, narrow rows of unknown channels and rows of kinds that change nothing."""
    import random

    r, out = random.Random(seed), []
    some = lambda *x: r.choice([None, *x])
    for off in range(1, n + 1):
        kind = r.choice(["channel_added", "channel_info_refreshed", *NARROW, *NARROW, "channel_member_joined"])
        full = kind in ("channel_added", "channel_info_refreshed")
        row = {"channel_id": f"C{r.randrange(40)}", "off": off, "kind": kind}
        if full:
            row |= {"name": some("a", "b"), "is_member": some(True, False), "is_archived": some(True, False), "num_members": some(1, 2), "is_im": some(True, False), "is_mpim": some(True, False), "im_user_id": some("U1"), "topic": some("t"), "purpose": some("", "p")}
        elif kind == "channel_renamed":
            row["name"] = some("x", "y")
        elif kind == "channel_member_changed":
            row["is_member"] = some(True, False)
        elif kind in ("channel_archived", "channel_unarchived"):
            row["is_archived"] = kind == "channel_archived"
        out.append(tuple(row.get(c.split()[0]) for c in CHANNEL_ROWS.split(", ")))
    return out


def replayed(rows, full) -> dict[str, dict]:
    """Row by row, as a service would apply them."""
    state: dict[str, dict] = {}
    for row in rows:
        e = dict(zip([c.split()[0] for c in CHANNEL_ROWS.split(", ")], row, strict=True))
        if e["kind"] in full:
            state[e["channel_id"]] = e
        elif e["channel_id"] in state and e["kind"] in NARROW:
            c = {"channel_renamed": "name", "channel_member_changed": "is_member"}.get(e["kind"], "is_archived")
            if e[c] is not None:
                state[e["channel_id"]] = state[e["channel_id"]] | {c: e[c]}
    return state


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_channel_state_row_by_row(spark, seed):
    rows = channel_rows(seed)
    l = spark.createDataFrame(rows, CHANNEL_ROWS).repartition(3)
    blocked = spark.createDataFrame([("C1",), ("C2",)], "channel_id string")
    live = lambda e: not e["is_archived"] and bool(e["is_member"] or e["is_im"] or e["is_mpim"])
    want = {i for i, e in replayed(rows, folds.FULL_KINDS).items() if live(e) and i not in ("C1", "C2")}
    assert {r.channel_id for r in folds.probe_scope(l, blocked).collect()} == want
    manual = spark.createDataFrame([("C3", "blocked"), ("C4", "hot"), ("C99", "hot")], "channel_id string, tier string")
    want = {i: {"C3": "blocked", "C4": "hot"}.get(i, "hot" if live(e) else "hidden") for i, e in replayed(rows, folds.FULL_KINDS[:1]).items()}
    assert {r.channel_id: r.tier for r in folds.tiers(l, manual).collect()} == want
    # without order: the last full row, the last change of membership, the last of archival
    last = lambda kinds: {e[0]: e for e in rows if e[2] in kinds}
    full, member, archived = last(folds.FULL_KINDS), last(["channel_member_changed"]), last(["channel_archived", "channel_unarchived"])
    first = lambda *x: next((v for v in x if v is not None), False)
    want = {i for i, e in full.items() if not first(archived.get(i, e)[5], e[5]) and (first(member.get(i, e)[4], e[4]) or e[7] or e[8])}
    assert {r.channel_id for r in folds.current_scope(l).collect()} == want


@pytest.mark.parametrize("seed", [4, 5])
def test_channels_row_by_row(spark, seed):
    rows = [r for r in channel_rows(seed) if r[2] != "channel_member_joined" and not (r[2] == "channel_renamed" and r[3] is None) and not (r[2] == "channel_member_changed" and r[4] is None)]
    names = [c.split()[0] for c in CHANNEL_ROWS.split(", ")]
    latest_of: dict = {}
    for r in rows:
        latest_of[r[0], r[2]] = r
    want = {}
    for i in {r[0] for r in rows}:
        own = sorted((r for (c, _), r in latest_of.items() if c == i), key=lambda r: r[1])
        want[i] = {c: next(((r[names.index(c)], r[1]) for r in reversed(own) if r[names.index(c)] is not None), (None, None)) for c in folds.ALL_COLUMNS}
    got = {r.channel_id: {c: (r[c], r[f"{c}_off"]) for c in folds.ALL_COLUMNS} for r in folds.channels(spark.createDataFrame(rows, CHANNEL_ROWS), folds.ALL_COLUMNS, offsets=True).collect()}
    assert got == want


def test_first_wins_keeps_null_keys(spark):
    d = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "id long, key string")
    assert [r.id for r in latest.first_wins(d, [F.col("key")], [F.col("id")]).orderBy("id").collect()] == [1, 3, 4]


def test_gaps_and_created_day(spark):
    day = 86_400_000_000
    l = log(spark, msg(A, us=day), msg(B, us=4 * day), msg(C, us=5 * day))
    d = lambda n: f"1970-01-{n:02}"
    assert [tuple(map(str, r)) for r in completeness.gaps(l).collect()] == [("C1", d(3), d(4), "2")]
    inside = spark.createDataFrame([("C1", "1970-01-04")], "channel_id string, day string").withColumn("day", F.col("day").cast("date"))
    assert [tuple(map(str, r)) for r in completeness.gaps(l, inside).collect()] == [("C1", d(3), d(3), "1")]
    assert completeness.gaps(l.limit(0)).count() == 0


@pytest.mark.parametrize(
    "total, ingested, member, blocked, refresh, want",
    [(5, 5, True, True, "ok", "blocked"), (None, 5, True, False, "ok", "unavailable"), (9, 9, True, False, "error", "unavailable"), (0, 0, False, False, "ok", "done"), (100, 99, True, False, "ok", "done"), (100, 98, True, False, "ok", "in_progress"), (5, 0, False, False, "ok", "not_joined"), (5, 0, True, False, "ok", "not_started")],
)
def test_status_ladder(spark, total, ingested, member, blocked, refresh, want):
    d = spark.createDataFrame([(total, ingested, member, blocked, refresh)], "t long, i long, m boolean, b boolean, r string")
    assert d.select(inventory.status(F.col("t"), F.col("i"), F.col("m"), F.col("b"), F.col("r"))).first()[0] == want


RUN = "channel_id string, run_id string, id long, kind string, page long, has_more boolean, cursor string, messages long, outcome string, bounded boolean"


@pytest.mark.parametrize(
    "events, want",
    [
        ([("a", 1, "started")], None), ([("a", 1, "started"), ("a", 2, "page")], "a"), ([("a", 1, "started"), ("a", 2, "page"), ("a", 3, "finished")], None),
        ([("a", 1, "started"), ("a", 2, "page"), ("b", 3, "started")], "a"), ([("a", 1, "started"), ("a", 2, "page"), ("x", 3, "started"), ("x", 4, "finished"), ("b", 5, "started")], None),
        ([("a", 1, "started"), ("a", 2, "page"), ("b", 3, "started"), ("b", 4, "page")], "b"), ([("a", 1, "started"), ("a", 2, "page"), ("b", 3, "started"), ("b", 4, "finished")], None),
    ],
)
def test_resume_anchor(spark, events, want):
    d = spark.createDataFrame([("C1", r, i, k, 0 if k == "page" else None, True if k == "page" else None, "c", 1, None, False) for r, i, k in events], RUN)
    got = [r.run_id for r in inventory.resume_anchor(d).collect()]
    assert got == ([want] if want else [])


def test_staleness_order(spark):
    now = 1_000_000_000
    d = spark.createDataFrame([("auth_failed", False, None), ("degraded", True, now), (None, False, now), ("healthy", True, now - 61_000_000), ("healthy", True, now), (None, None, None)], "health string, caught_up boolean, last_frame_us long")
    assert [r.reason for r in queues.staleness(d, now).collect()] == ["auth token invalid", "slack ingestion unhealthy", "catching up after reconnect", "server unreachable", None, "catching up after reconnect"]


def test_offsets_go_on_behind_heads(spark):
    new = spark.createDataFrame([("s", 5), ("s", 7), ("t", 1)], "stream string, id long")
    heads = spark.createDataFrame([("s", 10)], "stream string, offset_in_stream long")
    got = {(r.stream, r.id): r.offset_in_stream for r in latest.assign_offsets(new, heads, ["id"]).collect()}
    assert got == {("s", 5): 11, ("s", 7): 12, ("t", 1): 1}


def test_replay_twice_is_once(spark):
    l = log(spark, msg(A), edit(A, A), gone(B), msg(B))
    assert sorted(folds.snapshot_messages(l.unionByName(l)).collect()) == sorted(folds.snapshot_messages(l).collect())
