"""Folds of an event log to current state. Variants that differ on purpose (what a deletion means) have names of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import is_valid_ts
from .latest import latest_per_key, latest_values


def _strict(log: DataFrame, kind: str, ts: str) -> DataFrame:
    return log.filter((F.col("kind") == kind) & is_valid_ts(F.col(ts)))


def active_messages(log: DataFrame) -> DataFrame:
    """The current messages: per stream and time the latest base or edit, unless an edit moved it away or any deletion
    names it. A deletion is final, whatever its place in the stream. Malformed times are passed over on every input."""
    base = _strict(log, "message", "msg_ts").withColumn("priority", F.lit(0))
    edits = _strict(log, "message_changed", "msg_ts").withColumn("priority", F.lit(1))
    latest = latest_per_key(base.unionByName(edits), ["stream", "msg_ts"], [F.desc("off"), F.desc("priority")])
    moved = edits.filter(is_valid_ts(F.col("previous_ts")) & (F.col("previous_ts") != F.col("msg_ts"))).select("stream", F.col("previous_ts").alias("msg_ts"))
    gone = _strict(log, "message_deleted", "deleted_ts").select("stream", F.col("deleted_ts").alias("msg_ts"))
    # both kinds of absence in one anti join
    return latest.join(moved.unionByName(gone).distinct(), ["stream", "msg_ts"], "left_anti").drop("priority")


def active_thread_parents(log: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """(stream, channel_id, parent_ts, reply_count, latest_reply, off): active parents with replies, with the latest of
    their own row and of reply notices. Notices of other messages count for nothing."""
    cols = ["stream", "channel_id", "parent_ts", "reply_count", "latest_reply", "off"]
    parents = (active if active is not None else active_messages(log)).filter("reply_count > 0").withColumn("parent_ts", F.col("msg_ts")).select(*cols)
    notices = _strict(log, "parent_replied", "parent_ts").select(*cols).join(parents.select("stream", "parent_ts"), ["stream", "parent_ts"], "left_semi")
    return latest_per_key(parents.unionByName(notices), ["stream", "parent_ts"], [F.desc("off")]).select(*cols)


FULL_KINDS = ("channel_added", "channel_info_refreshed")
COLUMNS = ("name", "is_member", "is_archived", "num_members")
ALL_COLUMNS = ("name", "is_im", "is_mpim", "is_member", "is_archived", "im_user_id", "topic", "purpose", "num_members")


def channels(log: DataFrame, columns: Sequence[str] = COLUMNS, offsets: bool = False) -> DataFrame:
    """Each channel's columns, each by the latest event kind that has a value for it; with ``offsets`` also
    ``<column>_off``, the offset that it comes from.

    Two stages: the latest row of each kind first, then the latest value of each column among those. A full row without a
    value masks an older one of its kind with one; a rename or a change of membership without its value is no row at all.
    Narrow events of unknown ids give a row; per-user joins do not.
    """
    kinds = [*FULL_KINDS, "channel_renamed", "channel_archived", "channel_unarchived", "channel_member_changed"]
    empty = "(kind = 'channel_renamed' and name is null) or (kind = 'channel_member_changed' and is_member is null)"
    per_kind = latest_per_key(log.filter(F.col("kind").isin(kinds) & F.col("channel_id").isNotNull() & ~F.expr(empty)), ["channel_id", "kind"], [F.desc("off")])
    places = [F.expr(f"max(off) FILTER (WHERE {c} IS NOT NULL)").alias(f"{c}_off") for c in columns if offsets]
    return per_kind.groupBy("channel_id").agg(*latest_values(["channel_id"], "off", columns), *places)


def snapshot_messages(log: DataFrame) -> DataFrame:
    """(stream, ts, off): a replay in order, where a message posted again after its deletion is back, and an edit that
    moves a message takes the old time away. Times are not checked."""
    sets = log.filter("kind in ('message', 'message_changed') and msg_ts is not null").select("stream", F.col("msg_ts").alias("ts"), "off", F.lit(1).alias("seq"), F.lit(True).alias("is_set"))
    moves = log.filter("kind = 'message_changed' and previous_ts is not null and not (previous_ts <=> msg_ts)").select("stream", F.col("previous_ts").alias("ts"), "off", F.lit(0).alias("seq"), F.lit(False).alias("is_set"))
    gone = log.filter("kind = 'message_deleted' and deleted_ts is not null").select("stream", F.col("deleted_ts").alias("ts"), "off", F.lit(0).alias("seq"), F.lit(False).alias("is_set"))
    return latest_per_key(sets.unionByName(moves).unionByName(gone), ["stream", "ts"], [F.desc("off"), F.desc("seq")]).filter("is_set").select("stream", "ts", "off")


def active_candidates(log: DataFrame) -> DataFrame:
    """(stream, ts, id): messages and edits, but for those that a deletion or a moving edit of greater id names."""
    c = log.filter("kind in ('message', 'message_changed') and msg_ts is not null").select("stream", F.col("msg_ts").alias("ts"), "id")
    gone = log.filter("kind = 'message_deleted'").select("stream", F.col("deleted_ts").alias("ts"), F.col("id").alias("gone_id"))
    moved = log.filter("kind = 'message_changed' and previous_ts <> msg_ts").select("stream", F.col("previous_ts").alias("ts"), F.col("id").alias("gone_id"))
    # an earlier row goes if any later removal exists, so the latest removal decides: an aggregate instead of an inequality join
    last = gone.unionByName(moved).filter("ts is not null").groupBy("stream", "ts").agg(F.max("gone_id").alias("gone_id"))
    return c.join(last, ["stream", "ts"], "left").filter("gone_id is null or gone_id < id").select("stream", "ts", "id")


def users_snapshot(log: DataFrame) -> DataFrame:
    """(user_id, name, display, real): user_added replaces all, a rename the display name, a profile change display and
    real name. Changes before a user is known are ignored."""
    known = latest_per_key(log.filter("kind = 'user_added'"), ["user_id"], [F.desc("off")]).select("user_id", F.col("off").alias("since"), F.col("name").alias("_name"), F.col("display").alias("_display"), F.col("real").alias("_real"))
    # a rename after the last whole profile changes the display name only
    later = log.filter("kind in ('user_renamed', 'user_profile_changed')").join(known.select("user_id", "since"), "user_id").filter("off > since")
    changed = later.groupBy("user_id").agg(
        F.expr("max_by(struct(display, real), off) FILTER (WHERE kind = 'user_profile_changed')").alias("profile"),
        F.expr("max_by(display, off) FILTER (WHERE kind = 'user_profile_changed' OR display IS NOT NULL)").alias("last_display"),
        F.count("*").alias("n"),
    )
    one = known.join(changed, "user_id", "left")
    return one.select("user_id", F.col("_name").alias("name"), F.when(F.col("n") > 0, F.col("last_display")).otherwise(F.col("_display")).alias("display"), F.when(F.col("profile").isNotNull(), F.col("profile.real")).otherwise(F.col("_real")).alias("real"))


def users_client(log: DataFrame) -> DataFrame:
    """(user_id, display_name): the latest of any kind; unknown users are inserted. Fallbacks differ by kind: a profile
    change never falls back to the account's name."""
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    added = F.coalesce(filled("display"), filled("real"), filled("name"), F.col("user_id"))
    profile = F.coalesce(filled("display"), filled("real"), F.col("user_id"))
    shown = F.when(F.col("kind") == "user_added", added).when(F.col("kind") == "user_renamed", F.col("display")).otherwise(profile)
    return latest_per_key(log.withColumn("display_name", shown), ["user_id"], [F.desc("off")]).select("user_id", "display_name")


def user_state(log: DataFrame) -> DataFrame:
    """(user_id, last_display, last_real) of users that were added, the last of each told apart, for finding changes."""
    known = log.filter("kind = 'user_added'").select("user_id").distinct()
    return log.join(known, "user_id", "left_semi").groupBy("user_id").agg(F.expr("max_by(display, off)").alias("last_display"), F.expr("max_by(real, off) FILTER (WHERE kind <> 'user_renamed')").alias("last_real"))


def channel_list_snapshot(log: DataFrame) -> DataFrame:
    """Replay in order: channel_added replaces all, narrow events patch a known channel, refreshes do nothing."""
    known = latest_per_key(log.filter("kind = 'channel_added'"), ["channel_id"], [F.desc("off")]).select("channel_id", F.col("off").alias("since"), *[F.col(c).alias(f"_{c}") for c in COLUMNS])
    narrow = log.filter("kind in ('channel_renamed', 'channel_archived', 'channel_unarchived', 'channel_member_changed')").join(known.select("channel_id", "since"), "channel_id").filter("off > since")
    patched = narrow.groupBy("channel_id").agg(*latest_values(["channel_id"], "off", COLUMNS[:3]))
    return known.join(patched, "channel_id", "left").select("channel_id", *[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) for c in COLUMNS[:3]], F.col("_num_members").alias("num_members"))


def replayed_channels(log: DataFrame, full: Sequence[str]) -> DataFrame:
    """(channel_id, name, is_member, is_archived, is_im, is_mpim, im_user_id, topic, purpose): a replay in order, in which
    a row of a ``full`` kind replaces all of a channel, fields that it lacks included, and later narrow rows patch one
    column each. Narrow rows of channels unknown at that point do nothing, nor does a change without a value."""
    columns = ("name", "is_member", "is_archived", "is_im", "is_mpim", "im_user_id", "topic", "purpose")
    known = latest_per_key(log.filter(F.col("kind").isin(*full) & F.col("channel_id").isNotNull()), ["channel_id"], [F.desc("off")]).select("channel_id", F.col("off").alias("_since"), *[F.col(c).alias(f"_{c}") for c in columns])
    narrow = log.filter("kind in ('channel_renamed', 'channel_archived', 'channel_unarchived', 'channel_member_changed')").join(known.select("channel_id", "_since"), "channel_id").filter("off > _since")
    patched = narrow.groupBy("channel_id").agg(*latest_values(["channel_id"], "off", columns[:3]))
    return known.join(patched, "channel_id", "left").select("channel_id", *[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) for c in columns[:3]], *[F.col(f"_{c}").alias(c) for c in columns[3:]])


def _is_true(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def probe_scope(log: DataFrame, blocked: DataFrame) -> DataFrame:
    """(channel_id): members, direct and group messages, neither archived nor blocked, after a replay in which both full
    kinds replace; nulls count as false."""
    state = replayed_channels(log, FULL_KINDS)
    return state.filter(~_is_true("is_archived") & (_is_true("is_member") | _is_true("is_im") | _is_true("is_mpim"))).join(blocked.select("channel_id"), "channel_id", "left_anti").select("channel_id")


def current_scope(log: DataFrame) -> DataFrame:
    """(channel_id): as ``probe_scope`` but read off without order: the latest full row, over it the latest change of
    membership and of archival, whenever they came, and no block list."""
    full = latest_per_key(log.filter(F.col("kind").isin(*FULL_KINDS) & F.col("channel_id").isNotNull()), ["channel_id"], [F.desc("off")]).select("channel_id", "is_member", "is_archived", "is_im", "is_mpim")
    changes = log.groupBy("channel_id").agg(
        F.expr("max_by(is_member, off) FILTER (WHERE kind = 'channel_member_changed')").alias("_member"), F.expr("max_by(kind = 'channel_archived', off) FILTER (WHERE kind in ('channel_archived', 'channel_unarchived'))").alias("_archived")
    )
    state = full.join(changes, "channel_id", "left").select("channel_id", F.coalesce("_member", "is_member", F.lit(False)).alias("m"), F.coalesce("_archived", "is_archived", F.lit(False)).alias("a"), _is_true("is_im").alias("i"), _is_true("is_mpim").alias("g"))
    return state.filter("not a and (m or i or g)").select("channel_id")


def client_channels(log: DataFrame, manual: DataFrame) -> DataFrame:
    """The replayed columns of channels that were added, flags without nulls, with ``tier`` and ``subscribed``: archived
    hidden, direct and group messages hot, members hot, others hidden; a tier set by hand (channel_id, tier) stays."""
    flags = ("is_member", "is_archived", "is_im", "is_mpim")
    state = replayed_channels(log, FULL_KINDS[:1]).withColumns({c: _is_true(c) for c in flags}).join(manual.select("channel_id", F.col("tier").alias("_by_hand")), "channel_id", "left")
    default = F.when(F.col("is_archived"), "hidden").when(F.col("is_im") | F.col("is_mpim") | F.col("is_member"), "hot").otherwise("hidden")
    return state.withColumn("tier", F.coalesce("_by_hand", default)).withColumn("subscribed", F.col("tier") != "blocked").drop("_by_hand")


def tiers(log: DataFrame, manual: DataFrame) -> DataFrame:
    """(channel_id, tier, subscribed)."""
    return client_channels(log, manual).select("channel_id", "tier", "subscribed")


def sync_blocks(current: DataFrame, blocked: DataFrame) -> DataFrame:
    """(channel_id, tier, prior): current (channel_id, tier, prior) against the block list. A block keeps the tier before
    it once; a release restores it, or the default."""
    j = current.join(blocked.select("channel_id", F.lit(True).alias("_b")), "channel_id", "left")
    on, was = F.col("_b").isNotNull(), F.col("tier") == "blocked"
    prior = F.when(on, F.coalesce("prior", F.when(~was, F.col("tier"))))
    return j.select("channel_id", F.when(on, "blocked").when(was, F.coalesce("prior", F.lit("hidden"))).otherwise(F.col("tier")).alias("tier"), prior.alias("prior"))


def backfill_state(runs: DataFrame) -> DataFrame:
    """Per channel its latest started run, that run's end and its highest page."""
    started = latest_per_key(runs.filter("kind = 'started' and run_id is not null"), ["channel_id"], [F.desc("id")]).select("channel_id", "run_id")
    finished = latest_per_key(runs.filter("kind = 'finished' and run_id is not null"), ["channel_id", "run_id"], [F.desc("id")]).select("channel_id", "run_id", "outcome")
    page = latest_per_key(runs.filter("kind = 'page' and run_id is not null and page is not null"), ["channel_id", "run_id"], [F.desc("page"), F.desc("id")]).select("channel_id", "run_id", F.col("page").alias("latest_page"), F.col("has_more").alias("latest_has_more"), F.col("cursor").alias("latest_cursor"))
    return started.join(finished, ["channel_id", "run_id"], "left").join(page, ["channel_id", "run_id"], "left")


def ingest_head(log: DataFrame) -> DataFrame:
    """(channel_id, latest_ts): text order is time order for valid times."""
    return _strict(log, "message", "msg_ts").groupBy("channel_id").agg(F.max("msg_ts").alias("latest_ts"))


def originals(log: DataFrame, from_us: int, to_us: int) -> DataFrame:
    """(stream, ts, original_id, n_edits, edit_times, deleted_us) of what was posted in [from, to), whatever came later.

    The first message event that is no reply is the original; replies and times that only edits name are left out.
    """
    ts = F.coalesce("msg_ts", "deleted_ts")
    at = F.replace(ts, F.lit("."), F.lit("")).try_cast("bigint")
    e = log.filter(F.col("kind").isin("message", "message_changed", "message_deleted")).withColumn("ts", ts).filter((at >= from_us) & (at < to_us))
    own = "kind = 'message' AND (thread_ts IS NULL OR thread_ts = msg_ts)"
    folded = e.groupBy("stream", "ts").agg(
        F.expr(f"min(id) FILTER (WHERE {own})").alias("original_id"),
        F.expr("array_sort(collect_list(us) FILTER (WHERE kind = 'message_changed'))").alias("edits"),
        F.expr("max_by(us, id) FILTER (WHERE kind = 'message_deleted')").alias("deleted_us"),
    )
    return folded.filter("original_id is not null").select("stream", "ts", "original_id", F.size("edits").cast("bigint").alias("n_edits"), F.array_join(F.transform("edits", lambda x: x.cast("string")), ",").alias("edit_times"), "deleted_us")


def chunks(log: DataFrame) -> DataFrame:
    """(channel_id, ts, is_reply, off, reply_count): rows of the projection. The latest message or edit after the last
    deletion of its time gives the content; the count never falls but by a deletion. An edit that moves a message leaves
    the old row. Reply notices change nothing here."""
    m = log.filter("kind in ('message', 'message_changed') and msg_ts is not null")
    gone = log.filter("kind = 'message_deleted' and deleted_ts is not null").groupBy("channel_id", F.col("deleted_ts").alias("msg_ts")).agg(F.max("off").alias("gone"))
    live = m.join(gone, ["channel_id", "msg_ts"], "left").filter("gone is null or off > gone")
    return live.groupBy("channel_id", F.col("msg_ts").alias("ts")).agg(
        F.expr("max_by(coalesce(thread_ts <> msg_ts, false), off)").alias("is_reply"), F.max("off").alias("off"), F.coalesce(F.max("reply_count"), F.lit(0)).cast("bigint").alias("reply_count")
    )


def day_merge(base: DataFrame, log: DataFrame) -> DataFrame:
    """Replay over a cached set of messages (channel_id, ts, reply_count): append and replace set, delete removes, and a
    reply notice adds one to a parent that is present. One pass per message time, rows in order of the log."""
    ops = base.select("channel_id", "ts", F.lit(0).cast("bigint").alias("off"), F.lit("set").alias("op"), F.coalesce("reply_count", F.lit(0)).cast("bigint").alias("n"))
    m = log.filter("kind in ('message', 'message_changed') and msg_ts is not null").select("channel_id", F.col("msg_ts").alias("ts"), "off", F.lit("set").alias("op"), F.coalesce("reply_count", F.lit(0)).cast("bigint").alias("n"))
    d = log.filter("kind = 'message_deleted' and deleted_ts is not null").select("channel_id", F.col("deleted_ts").alias("ts"), "off", F.lit("del").alias("op"), F.lit(0).cast("bigint").alias("n"))
    b = log.filter("kind = 'parent_replied' and parent_ts is not null").select("channel_id", F.col("parent_ts").alias("ts"), "off", F.lit("bump").alias("op"), F.lit(1).cast("bigint").alias("n"))
    ops = ops.unionByName(m).unionByName(d).unionByName(b)
    last = ops.filter("op <> 'bump'").groupBy("channel_id", "ts").agg(F.max("off").alias("since"), F.expr("max_by(op, off)").alias("state"), F.expr("max_by(n, off)").alias("n"))
    bumps = ops.filter("op = 'bump'").select("channel_id", "ts", F.col("off").alias("bump_off")).join(last, ["channel_id", "ts"]).filter("bump_off > since").groupBy("channel_id", "ts").agg(F.count("*").alias("bumps"))
    return last.filter("state = 'set'").join(bumps, ["channel_id", "ts"], "left").select("channel_id", "ts", F.greatest(F.col("n") + F.coalesce("bumps", F.lit(0)), F.lit(0)).cast("bigint").alias("reply_count"))


def keep_last(log: DataFrame, n: int) -> DataFrame:
    """The last n events of each stream."""
    return latest_n(log, n)


def latest_n(log: DataFrame, n: int) -> DataFrame:
    from pyspark.sql import Window as W

    return log.withColumn("_r", F.row_number().over(W.partitionBy("stream").orderBy(F.desc("off")))).filter(F.col("_r") <= n).drop("_r")


#: What the projection does with each kind of a channel stream.
ROUTES = {"message": "apply", "message_changed": "apply", "message_deleted": "apply", "reaction_added": "ignore", "reaction_removed": "ignore", "member_joined": "ignore", "member_left": "ignore", "channel_message_count_probed": "ignore"}


def dispatch(log: DataFrame) -> DataFrame:
    """Adds ``route``: apply, ignore, or reject for unknown kinds, which are counted and never fatal."""
    table = F.create_map(*[F.lit(x) for pair in ROUTES.items() for x in pair])
    return log.withColumn("route", F.coalesce(table[F.col("kind")], F.lit("reject")))
