"""Raw pushes to log events: translation, validation of requests, promotion of JSON fields to typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .latest import as_of, first_wins

#: The log's schema at rest, and structural pushes by type with the kind that each becomes.
EVENT = "id bigint, stream string, offset_in_stream bigint, kind string, ts string, payload string, source string, created_at timestamp"
STRUCTURAL = {
    "channel_created": "channel_added", "channel_rename": "channel_renamed", "channel_archive": "channel_archived", "channel_unarchive": "channel_unarchived", "group_rename": "channel_renamed",
    "group_archive": "channel_archived", "group_unarchive": "channel_unarchived", "channel_left": "channel_member_changed", "group_left": "channel_member_changed", "channel_joined": "channel_member_changed",
    "group_joined": "channel_member_changed", "member_joined_channel": "channel_member_joined", "member_left_channel": "channel_member_left",
}


def promote(events: DataFrame) -> DataFrame:
    """Adds the typed columns that folds read, each JSON path read once; Spark can push filters on these, not on JSON."""
    p = lambda path: F.get_json_object("payload", path)
    changed = F.col("kind") == "message_changed"
    inner = lambda name: F.when(changed, p(f"$.message.{name}")).when(F.col("kind") == "message", p(f"$.{name}"))
    count = F.when(F.col("kind") == "parent_replied", p("$.reply_count")).otherwise(inner("reply_count"))
    return events.select(
        "*", F.col("offset_in_stream").alias("off"), F.when(F.col("stream").startswith("channel:"), F.substring("stream", 9, 1_000)).alias("channel_id"), F.unix_micros("created_at").alias("us"),
        inner("ts").alias("msg_ts"), F.when(changed, p("$.previous_ts")).alias("previous_ts"), F.when(F.col("kind") == "message_deleted", p("$.deleted_ts")).alias("deleted_ts"),
        inner("thread_ts").alias("thread_ts"), count.try_cast("bigint").alias("reply_count"), F.when(F.col("kind") == "parent_replied", p("$.latest_reply")).otherwise(inner("latest_reply")).alias("latest_reply"),
        F.when(F.col("kind") == "parent_replied", p("$.parent_ts")).alias("parent_ts"),
    )


def translate(pushes: DataFrame) -> DataFrame:
    """(stream, kind, ts) of pushes (``body`` JSON with type, subtype, channel, ...); unknown types give kind null.

    A change push that only counts up its parent's replies is a reply notice; the message nested in a push is preferred.
    """
    p = lambda path: F.get_json_object("body", path)
    type_, subtype, channel = p("$.type"), p("$.subtype"), F.coalesce(p("$.channel.id"), p("$.channel"), p("$.item.channel"))
    notice = (subtype == "message_replied") | ((subtype == "message_changed") & p("$.message.reply_count").isNotNull() & (p("$.message.thread_ts") == p("$.message.ts")) & p("$.message.edited").isNull())
    table = F.create_map(*[F.lit(x) for pair in STRUCTURAL.items() for x in pair])
    message = F.when(notice, "parent_replied").when(subtype == "message_changed", "message_changed").when(subtype == "message_deleted", "message_deleted").otherwise("message")
    kind = F.when(type_ == "message", message).when(type_.isin("reaction_added", "reaction_removed"), type_).otherwise(table[type_])
    stream = F.when(type_.isin("message", "reaction_added", "reaction_removed"), F.concat(F.lit("channel:"), channel)).when(table[type_].isNotNull(), "channel-list").when(type_ == "user_change", "users")
    ts = F.when(kind == "message_deleted", p("$.deleted_ts")).when(kind.isin("message_changed", "parent_replied"), p("$.message.ts")).otherwise(F.coalesce(p("$.ts"), p("$.event_ts")))
    return pushes.select("*", stream.alias("stream"), F.when(type_ == "user_change", "user_profile_changed").otherwise(kind).alias("kind"), ts.alias("ts"))


#: Pushes by what is written for them; archive, unarchive and rename go by the kinds above.
_LOST, _CREATED = ("channel_deleted", "channel_left", "group_deleted"), ("channel_created", "im_created")


def structural_events(pushes: DataFrame, channels: DataFrame, self_id: str) -> DataFrame:
    """(push_id, part, stream, kind, payload) of structural pushes (push_id, us, type, channel, user, event_ts).

    ``channels`` has channel_id, valid_us and what is known of the channel from then on; a push that needs it (a channel
    that is new or renamed, or that one joins oneself) takes the state as of its own time. Where nothing is known yet, such a
    push gives nothing, and is to come again; what does not need it is written all the same. A member's coming or going is a fact of
    its own; one's own coming also adds the channel before it, one's own going ends the membership behind it.
    """
    known = [c for c in channels.columns if c not in ("channel_id", "valid_us")]
    asked = pushes.withColumnRenamed("channel", "channel_id")
    j = as_of(asked, channels, "channel_id", "us", "valid_us")
    type_, there, own = F.col("type"), F.col("valid_us").isNotNull(), F.col("user").eqNullSafe(F.lit(self_id))
    info = F.to_json(F.struct(F.col("channel_id").alias("id"), *known))
    channel = F.col("channel_id")
    pairs = lambda **c: F.to_json(F.struct(*[x.alias(k) for k, x in c.items()]))
    event = lambda part, kind, payload: F.struct(F.lit(part).alias("part"), F.lit(kind).alias("kind"), payload.alias("payload"))
    gone = pairs(channel_id=channel, is_member=F.lit(False))
    member = pairs(channel_id=channel, user_id=F.col("user"), event_ts=F.col("event_ts"))
    whole_member = channel.isNotNull() & F.col("user").isNotNull()
    parts = F.array_compact(F.array(
        F.when((type_.isin(*_CREATED) | ((type_ == "member_joined_channel") & own)) & there & channel.isNotNull(), event(0, "channel_added", info)),
        F.when((type_ == "member_joined_channel") & whole_member, event(1, "channel_member_joined", member)),
        F.when((type_ == "member_left_channel") & whole_member, event(1, "channel_member_left", member)),
        F.when((type_.isin(*_LOST) | ((type_ == "member_left_channel") & own)) & channel.isNotNull(), event(2, "channel_member_changed", gone)),
        F.when(type_.isin("channel_archive", "group_archive") & channel.isNotNull(), event(0, "channel_archived", pairs(channel_id=channel))),
        F.when(type_.isin("channel_unarchive", "group_unarchive") & channel.isNotNull(), event(0, "channel_unarchived", pairs(channel_id=channel))),
        F.when(type_.isin("channel_rename", "group_rename") & there & channel.isNotNull(), event(0, "channel_renamed", pairs(channel_id=channel, new_name=F.col("name")))),
    ))
    return j.select("push_id", F.explode(parts).alias("e")).select("push_id", "e.part", F.lit("channel-list").alias("stream"), "e.kind", "e.payload")


def subscribe_status(stream: Column, since: Column, head: Column) -> Column:
    """What a subscription is answered: an error, or ok. Internal streams are unknown; an empty stream is fine at 0."""
    hidden = stream.startswith("backfill-run:")
    known = stream.startswith("channel:") | stream.isin("channel-list", "users", "slurper-health")
    return F.when(hidden | ~known, "unknown_stream").when(since < 0, "bad_since").when(since > F.coalesce(head, F.lit(0)), "since_beyond_head").otherwise("ok")


def replace_state(current: DataFrame, snapshot: DataFrame, keys: list[str], scope: str) -> DataFrame:
    """The projection after a whole snapshot of some scopes: these hold the snapshot's rows only, other scopes stay.

    ``snapshot`` has the projection's columns; a scope with a row of null keys is one whose snapshot is empty.
    """
    scopes = snapshot.select(scope).distinct()
    whole = snapshot.dropna(subset=keys)
    return current.join(scopes, scope, "left_anti").unionByName(whole.select(*current.columns))


def rerender(current: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Fresh rows replace or join the projection's; nothing goes."""
    return current.join(fresh, keys, "left_anti").unionByName(fresh.select(*current.columns))


#: By which fields of their payload events of a kind are the same event; other kinds may repeat.
FAMILIES = {
    "message": ("ts",), "user_added": ("id",), "parent_replied": ("parent_ts", "reply_count"), "channel_id_changed": ("old_channel_id", "new_channel_id", "event_ts"), "channel_history_changed": ("channel_id", "latest", "ts", "event_ts"),
    "channel_member_joined": ("channel_id", "user_id", "event_ts"), "channel_member_left": ("channel_id", "user_id", "event_ts"), "tokens_revoked": ("tokens",), "backfill_run_started": ("run_id",), "backfill_run_finished": ("run_id",), "backfill_page_committed": ("run_id", "page_index"),
}


def family_key(kind: Column) -> Column:
    """The key of an event with ``payload``, by its kind's family, as JSON; null for other kinds and where a part is absent."""
    text = lambda c: F.col(f"payload.{c}").cast("string")
    keys = F.create_map(*[x for k, cols in FAMILIES.items() for x in (F.lit(k), F.array(*[text(c) for c in cols]))])[kind]
    return F.when(keys.isNotNull() & ~F.exists(keys, lambda x: x.isNull()), F.to_json(keys))


def first_of_family(events: DataFrame, order: str = "id") -> DataFrame:
    """The events (stream, kind, payload struct, ...) that a log would take, one after the other: of a kind with a key the
    first of each stream and key; of other kinds all. A key with an absent part equals none. All families in one pass."""
    return first_wins(events.withColumn("_key", family_key(F.col("kind"))), [F.col("stream"), F.col("kind"), F.col("_key")], [F.col(order)]).drop("_key")


def replay_then_live(requests: DataFrame, log: DataFrame) -> DataFrame:
    """(stream, since, off, phase) of subscriptions (stream, since, at_us): what lies behind ``since`` up to the head at that
    moment is replayed, then ``caught_up`` at the head, then what comes later is live; each event once. A ``since`` beyond
    the head gives one row with that error; a stream without events yet is caught up at 0."""
    heads = requests.select("stream", "at_us").distinct().join(log.select("stream", "us", "off"), "stream", "left").groupBy("stream", "at_us").agg(F.coalesce(F.max(F.when(F.col("us") <= F.col("at_us"), F.col("off"))), F.lit(0)).alias("head"))
    j = requests.join(heads, ["stream", "at_us"])
    marks = j.select("stream", "since", F.col("head").alias("off"), F.when(F.col("since") > F.col("head"), "since_beyond_head").otherwise("caught_up").alias("phase"))
    events = j.filter("since <= head").join(log.select("stream", F.col("off").alias("_off")), "stream").filter("_off > since")
    return marks.unionByName(events.select("stream", "since", F.col("_off").alias("off"), F.when(F.col("_off") <= F.col("head"), "replay").otherwise("live").alias("phase")))


def dirty_batches(marks: DataFrame, from_us: int, tick_us: int, most: int) -> DataFrame:
    """(path, tick, first_us, drain) of marks (path, us): each path once a tick, at its first mark, drained ``most`` at a time."""
    first = marks.withColumn("tick", F.floor((F.col("us") - from_us) / tick_us)).groupBy("path", "tick").agg(F.min("us").alias("first_us"))
    place = F.row_number().over(W.partitionBy("tick").orderBy("first_us", "path")) - 1
    return first.withColumn("drain", F.floor(place / most).cast("bigint"))


def drifted(rendered: DataFrame, current: DataFrame) -> DataFrame:
    """(path) of what was rendered at other offsets than its dependencies (path, stream, off) have now: to be marked again."""
    j = rendered.select("path", "stream", F.col("off").alias("_was")).join(current.select("stream", F.col("off").alias("_is")), "stream")
    return j.filter("_is <> _was").select("path").distinct()
