"""Which conversations are listed and under which names; tiers set by hand; the block list; paths and links to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .inventory import conversation_root, unique_slugs

ROOTS = ("dms", "group-dms", "channels", "other-channels")


def rooted(channels: DataFrame) -> DataFrame:
    """Client channels that are not blocked, with ``root``."""
    return channels.filter("tier <> 'blocked'").withColumn("root", conversation_root(F.col("is_im"), F.col("is_mpim"), F.col("is_member")))


def listed(channels: DataFrame, hidden: bool = False) -> DataFrame:
    """(channel_id, root, tier): what a root's listing shows, hot ones; with ``hidden`` what a name in it may reach."""
    return rooted(channels).filter(F.lit(hidden) | (F.col("tier") == "hot")).select("channel_id", "root", "tier")


def named(channels: DataFrame, slug: Column) -> DataFrame:
    """(channel_id, root, tier, slug): names without repeats in a root. They are dealt out over hot and hidden ones alike,
    hot ones first, so that listing and reaching agree."""
    own = rooted(channels).withColumn("slug", slug)
    return unique_slugs(own, "root", "slug", [F.col("tier") != "hot"], "channel_id").select("channel_id", "root", "tier", F.col("unique_slug").alias("slug"))


def resolve_targets(targets: DataFrame, names: DataFrame, channels: DataFrame) -> DataFrame:
    """(target, channel_id, error) of what was asked for: ``root/slug``, else a slug in any root (in several roots: an
    error), else an id."""
    parts = F.split("target", "/", 2)
    asked = targets.select("target", F.when(F.contains("target", F.lit("/")), F.get(parts, F.lit(0))).alias("in_root"), F.when(F.contains("target", F.lit("/")), F.get(parts, F.lit(1))).otherwise(F.col("target")).alias("asked_slug"))
    hits = asked.join(names, F.col("asked_slug") == F.col("slug"), "inner").filter("in_root is null or in_root = root")
    by_name = hits.groupBy("target").agg(F.min("channel_id").alias("_id"), F.count("*").alias("_n"))
    ids = channels.select(F.col("channel_id").alias("_literal"))
    j = asked.select("target").distinct().join(by_name, "target", "left").join(ids, F.col("target") == F.col("_literal"), "left")
    found = F.when(F.col("_n") > 1, None).otherwise(F.coalesce("_id", "_literal"))
    return j.select("target", found.alias("channel_id"), F.when(F.col("_n") > 1, "ambiguous").when(found.isNull(), "unknown").alias("error"))


def dormant(channels: DataFrame, walked: DataFrame, messages: DataFrame) -> DataFrame:
    """(channel_id): direct messages that were walked and hold no message."""
    own = channels.filter("is_im").select("channel_id").join(walked.select("channel_id"), "channel_id", "left_semi")
    return own.join(messages.select("channel_id"), "channel_id", "left_anti")


def to_walk(channels: DataFrame, blocked: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """(channel_id): members, direct and group messages that are not blocked and whose name, in any case, holds none of ``skip``."""
    name = F.lower(F.coalesce("name", F.lit("")))
    own = channels.filter("is_member or is_im or is_mpim")
    for s in skip:
        own = own.filter(~F.contains(name, F.lit(s)))
    return own.select("channel_id").join(blocked.select("channel_id"), "channel_id", "left_anti")


def passes_since(ts: Column, since: Column) -> Column:
    """Later than ``since``, or no time at all."""
    return F.coalesce(ts.try_cast("decimal(20,6)") > since, F.lit(True))


def is_thread_parent(ts: Column, thread_ts: Column, reply_count: Column, strict: bool = False) -> Column:
    """Has replies, and is its thread's own first message; ``strict``: and says so."""
    own = thread_ts.eqNullSafe(ts) if strict else thread_ts.isNull() | (thread_ts == ts)
    return (F.coalesce(reply_count, F.lit(0)) > 0) & own


def set_tiers(channels: DataFrame, wanted: DataFrame) -> DataFrame:
    """``channels`` (channel_id, tier, by_hand, subscribed, default_tier) after ``wanted`` (channel_id, tier): a tier set by
    hand, or, where it is null, the default again."""
    j = channels.join(wanted.select("channel_id", F.col("tier").alias("_to"), F.lit(True).alias("_set")), "channel_id", "left")
    tier = F.when(F.col("_set") & F.col("_to").isNull(), F.col("default_tier")).otherwise(F.coalesce("_to", "tier"))
    by_hand = F.when(F.col("_set"), F.col("_to").isNotNull()).otherwise(F.col("by_hand"))
    return j.select("channel_id", tier.alias("tier"), by_hand.alias("by_hand"), (tier != "blocked").alias("subscribed"), "default_tier")


def edit_blocks(blocked: DataFrame, edits: DataFrame) -> DataFrame:
    """The block list (channel_id, reason, blocked_us) after ``edits`` (id, channel_id, us, block, reason), the last of each
    channel, of one moment that of the greatest id: an addition to a blocked channel gives it the new reason and keeps its time; a removal of another does nothing."""
    first = F.row_number().over(W.partitionBy("channel_id").orderBy(F.desc("us"), F.desc("id")))
    last = edits.withColumn("_n", first).filter("_n = 1").select("channel_id", F.col("us").alias("_us"), F.col("block").alias("_block"), F.col("reason").alias("_reason"))
    j = blocked.join(last, "channel_id", "full_outer").filter("coalesce(_block, true)")
    return j.select("channel_id", F.when(F.col("_block"), F.col("_reason")).otherwise(F.col("reason")).alias("reason"), F.coalesce("blocked_us", "_us").alias("blocked_us"))


DAY_FILES, THREAD_FILES = ("channel.md", "feed.md"), ("thread.md", "feed.md")


def parsed_path(path: Column, mount: str) -> Column:
    """struct<kind, root, slug, day, thread_slug, error> of a path below ``mount``: told apart by how deep it lies."""
    inside = path.eqNullSafe(mount) | F.startswith(path, F.lit(mount.rstrip("/") + "/"))
    raw = F.filter(F.split(F.substring(path, len(mount.rstrip("/")) + 1, 10_000), "/"), lambda x: (x != "") & (x != "."))
    parts = F.when(F.get(raw, F.lit(0)) == ".cached-only", F.slice(raw, 2, 1_000)).otherwise(raw)
    at = lambda i: F.get(parts, F.lit(i))
    n = F.size(parts)
    shaped = F.concat_ws("-", at(2), at(3))
    day = F.when(shaped.rlike(r"\A[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z") & shaped.try_cast("date").isNotNull(), F.date_format(shaped.try_cast("date"), "yyyy-MM-dd"))
    error = (
        F.when(~F.coalesce(inside, F.lit(False)), "outside").when(n == 0, "root of the mount").when(~at(0).isin(*ROOTS), "no such root").when(n == 1, "no channel").when((n == 3) & (at(2) != "channel.md"), "no such file")
        .when(n == 4, "a directory").when((n > 4) & day.isNull(), "no such day").when((n == 5) & ~at(4).isin(*DAY_FILES), "no such file").when((n == 6) & ~at(5).isin(*THREAD_FILES), "no such file").when(n > 6, "too deep")
    )
    kind = F.when(error.isNotNull(), None).when(n == 2, "channel_dir").when(n == 3, "channel_file").when(n == 5, "day_file").otherwise("thread_file")
    good = lambda c: F.when(error.isNull(), c)
    return F.struct(kind.alias("kind"), good(at(0)).alias("root"), good(at(1)).alias("slug"), good(F.when(n > 4, day)).alias("day"), good(F.when(n == 6, at(4))).alias("thread_slug"), error.alias("error"))


def link_paths(links: DataFrame, names: DataFrame, parents: DataFrame, mount: str) -> DataFrame:
    """(id, path, error) of parsed links (id, channel_id, message_ts, thread_ts, month, day of the message or thread).

    A link to a thread, or to a message that is a thread's parent (``parents``: channel_id, ts, thread_slug), leads to the
    thread's document; any other to its day's. A link that names a thread which is not known is an error, not its day.
    """
    target = F.coalesce("thread_ts", "message_ts")
    j = links.withColumn("_ts", target).join(names.select("channel_id", "root", "slug"), "channel_id", "left").join(parents.select("channel_id", F.col("ts").alias("_ts"), "thread_slug"), ["channel_id", "_ts"], "left")
    channel = F.concat_ws("/", F.lit(mount), "root", "slug")
    day = F.concat_ws("/", channel, "month", "day")
    error = F.when(F.col("root").isNull(), "unknown channel").when(F.col("thread_slug").isNull() & F.col("thread_ts").isNotNull(), "unknown thread")
    path = F.when(error.isNotNull(), None).when(F.col("_ts").isNull(), channel).when(F.col("thread_slug").isNotNull(), F.concat_ws("/", day, "thread_slug", F.lit("thread.md"))).otherwise(F.concat_ws("/", day, F.lit("channel.md")))
    return j.select("id", path.alias("path"), error.alias("error"))


def frontmatter(document: Column) -> Column:
    """map<string, string> of a document's head between two lines ``---``; values lose their quotes. No head, no entries."""
    lines = F.split(document, "\n")
    last = F.array_position(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "---")
    pairs = F.filter(F.slice(lines, 2, F.greatest(last - 1, F.lit(0)).cast("int")), lambda x: F.contains(x, F.lit(":")))
    value = lambda x: F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x)))
    bare = lambda v: F.when((F.length(v) >= 2) & (F.left(v, F.lit(1)) == F.right(v, F.lit(1))) & F.left(v, F.lit(1)).isin("'", '"'), F.substring(v, 2, F.length(v) - 2)).otherwise(v)
    entries = F.transform(pairs, lambda x: F.struct(F.trim(F.split(x, ":", 2)[0]).alias("key"), bare(value(x)).alias("value")))
    # a key that comes again has its last value
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    own = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]))
    return F.when((F.get(lines, F.lit(0)) == "---") & (last > 0), own).otherwise(F.create_map().cast("map<string,string>"))


def approximate_total(total: Column, paging_total: Column) -> Column:
    """Whether a search's total is only near the truth."""
    return (total >= 10_000) & (paging_total != total)


def day_contents(chunks: DataFrame, day: Column) -> DataFrame:
    """(channel_id, day, ts, is_parent): the messages' own rows by local day, and which of them have a thread."""
    return chunks.select("channel_id", day.alias("day"), "ts", (F.col("reply_count") > 0).alias("is_parent"))


def thread_contents(chunks: DataFrame, replies: DataFrame) -> DataFrame:
    """(channel_id, thread_ts, place, ts, reply_count): each thread's parent, place 0, if its row is there, then its
    replies by time; the count is the parent's, or 0 without one."""
    own = replies.filter("ts <> thread_ts").select("channel_id", "thread_ts", "ts")
    threads = own.select("channel_id", "thread_ts").distinct()
    parents = chunks.select("channel_id", F.col("ts").alias("thread_ts"), "reply_count").join(threads, ["channel_id", "thread_ts"], "left_semi")
    place = F.row_number().over(W.partitionBy("channel_id", "thread_ts").orderBy("ts"))
    rows = own.withColumn("place", place.cast("bigint")).unionByName(parents.select("channel_id", "thread_ts", F.col("thread_ts").alias("ts"), F.lit(0).cast("bigint").alias("place")))
    return rows.join(parents, ["channel_id", "thread_ts"], "left").select("channel_id", "thread_ts", "place", "ts", F.coalesce("reply_count", F.lit(0)).cast("bigint").alias("reply_count"))
