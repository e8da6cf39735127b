"""Messages to blocks, references to names, blocks to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CHANNEL, USER, mentions, slugify, structural
from ..functions.times import local
from .inventory import unique_slugs


def attachment(a: Column) -> Column:
    """pretext, title with or without its link, text, a bare link if the title has none; the fallback if nothing else."""
    filled = lambda c: F.nullif(c, F.lit(""))
    title = F.when(filled(a["title_link"]).isNotNull(), F.concat(F.lit("**["), a["title"], F.lit("]("), a["title_link"], F.lit(")**"))).otherwise(F.concat(F.lit("**"), a["title"], F.lit("**")))
    parts = F.array_compact(F.array(
        F.when(filled(a["pretext"]).isNotNull(), structural(a["pretext"])), F.when(filled(a["title"]).isNotNull(), title), F.when(filled(a["text"]).isNotNull(), structural(a["text"])),
        F.when(filled(a["from_url"]).isNotNull() & filled(a["title_link"]).isNull(), F.concat(F.lit("<"), a["from_url"], F.lit(">"))),
    ))
    return F.when(F.size(parts) > 0, F.array_join(F.array_remove(parts, ""), "\n\n")).otherwise(F.coalesce(a["fallback"], F.lit("")))


# The marks and words of blocks, documents and reports below ("## ", "*(edited )*", "📎 ", "[Huddle Notes]",
# "> Thread: n replies", "<sub>edited </sub>", "~~", "(n days)"), as readers of these documents expect them.
def message_block(zone: str) -> Column:
    """A message (us, user, text, edited_us, attachments, reactions, files, reply_count, ts, thread_ts) as a block."""
    clock = lambda us: local(us, zone, "HH:mm")
    author = F.when(F.col("user").rlike(r"\AU[A-Z0-9]+\z"), F.concat(F.lit("<@"), "user", F.lit(">"))).otherwise(F.concat(F.lit("@"), "user"))
    edited = F.coalesce(F.concat(F.lit(" *(edited "), clock(F.col("edited_us")), F.lit(")*")), F.lit(""))
    line = lambda c: F.array(c, F.lit(""))
    none = F.array().cast("array<string>")
    either = lambda cond, c: F.when(F.coalesce(cond, F.lit(False)), line(c)).otherwise(none)
    files = F.flatten(F.transform(F.coalesce("files", F.array().cast("array<struct<name:string,huddle:boolean>>")), lambda f: line(F.when(f["huddle"], F.concat(F.lit("[Huddle Notes]("), f["name"], F.lit(")"))).otherwise(F.concat(F.lit("📎 ["), f["name"], F.lit("](attachments/"), f["name"], F.lit(")"))))))
    shown = F.filter(F.transform("attachments", attachment), lambda x: x != "")
    reactions = F.array_join(F.transform("reactions", lambda r: F.concat(F.lit(":"), r["name"], F.lit(": "), r["count"].cast("string"))), "  ")
    thread = F.concat(F.lit("> Thread: "), F.col("reply_count").cast("string"), F.lit(" replies"))
    return F.array_join(F.concat(
        line(F.concat(F.lit("## "), clock(F.col("us")), F.lit(" "), author, edited)), either(F.col("text") != "", structural(F.col("text"))), F.coalesce(F.flatten(F.transform(shown, line)), none),
        either(F.size("reactions") > 0, reactions), files, either((F.col("reply_count") > 0) & (F.col("thread_ts") == F.col("ts")), thread),
    ), "\n")


def resolve(blocks: DataFrame, users: DataFrame, channels: DataFrame, key: str, text: str = "block") -> DataFrame:
    """Adds ``resolved`` and ``missed`` (ids without a name) to (key, text): references become names, which are put in as
    they are; ids without a name stand for themselves.

    Texts are cut at references; only these are joined with users (user_id, display_name) and channels (channel_id,
    name), and pieces come together again in order. Texts without a reference meet no join.
    """
    token = r"(?=<[@#][UC][A-Z0-9]+(?:\|[^>]+)?>)|(?<=>)"
    ref = r"\A<([@#])([UC][A-Z0-9]+)(?:\|([^>]+))?>\z"
    has = F.col(text).rlike(r"<[@#][UC][A-Z0-9]+(\|[^>]+)?>")
    pieces = blocks.filter(has).select(key, F.posexplode(F.split(text, token)).alias("at", "piece"))
    mark = F.nullif(F.regexp_extract("piece", ref, 1), F.lit(""))
    pieces = pieces.select(key, "at", "piece", mark.alias("mark"), F.regexp_extract("piece", ref, 2).alias("ref"), F.nullif(F.regexp_extract("piece", ref, 3), F.lit("")).alias("label"))
    asked = pieces.filter("mark is not null and label is null").select("mark", "ref").distinct()
    names = users.select(F.lit("@").alias("mark"), F.col("user_id").alias("ref"), F.col("display_name").alias("name")).unionByName(channels.select(F.lit("#").alias("mark"), F.col("channel_id").alias("ref"), "name"))
    known = asked.join(names.filter("name <> ''"), ["mark", "ref"])
    shown = F.when(F.col("mark").isNull(), F.col("piece")).otherwise(F.concat("mark", F.coalesce("label", "name", "ref")))
    missed = F.when(F.col("mark").isNotNull() & F.col("label").isNull() & F.col("name").isNull(), F.col("ref"))
    back = pieces.join(known, ["mark", "ref"], "left").groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", shown.alias("s")))), lambda x: x["s"]), "").alias("resolved"), F.array_sort(F.collect_set(missed)).alias("missed")
    )
    done = blocks.join(back, key, "left")
    return done.withColumn("resolved", F.coalesce("resolved", text)).withColumn("missed", F.coalesce("missed", F.array().cast("array<string>")))


def mention_edges(blocks: DataFrame, key: str, text: str = "block") -> DataFrame:
    """(key, kind, ref): one row for each id that a text refers to."""
    each = F.concat(F.transform(mentions(F.col(text), USER), lambda r: F.struct(F.lit("user").alias("kind"), r.alias("ref"))), F.transform(mentions(F.col(text), CHANNEL), lambda r: F.struct(F.lit("channel").alias("kind"), r.alias("ref"))))
    return blocks.select(key, F.inline(each))


def invalidated(edges: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Keys of texts that refer to what changed (kind, ref)."""
    return edges.join(changed.select("kind", "ref"), ["kind", "ref"], "left_semi").select(key).distinct()


def day_documents(blocks: DataFrame, zone: str) -> DataFrame:
    """(channel_id, day, document) of (channel_id, name, us, ts, block): frontmatter and a local day's blocks in order."""
    head = F.concat(F.lit("---\nchannel: "), F.coalesce(F.nullif("name", F.lit("")), "channel_id"), F.lit("\nchannel_id: "), "channel_id", F.lit("\ndate: "), "day", F.lit("\n---\n"))
    days = blocks.withColumn("day", local(F.col("us"), zone, "yyyy-MM-dd")).groupBy("channel_id", "name", "day")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "block"))), lambda x: x["block"]), "\n")
    return days.agg(body.alias("body")).select("channel_id", "day", F.concat(head, "body").alias("document"))


def annotated_original(block: Column, edits: Column, deleted: Column, clock) -> Column:
    """An original with a line for each edit and its deletion; a deleted one as a whole struck through."""
    notes = F.concat(F.transform(edits, lambda us: F.concat(F.lit("<sub>edited "), clock(us), F.lit(" UTC</sub>"))), F.when(deleted.isNotNull(), F.array(F.concat(F.lit("<sub>**deleted "), clock(deleted), F.lit(" UTC**</sub>")))).otherwise(F.array().cast("array<string>")))
    body = F.when(F.size(notes) > 0, F.concat(F.regexp_replace(block, r"\s+\z", ""), F.lit("\n"), F.array_join(notes, "\n"), F.lit("\n"))).otherwise(block)
    return F.when(deleted.isNotNull(), F.concat(F.lit("~~\n"), body, F.lit("~~\n"))).otherwise(body)


def gap_line(first: Column, last: Column, n: Column) -> Column:
    return F.when(n == 1, F.concat(F.lit("- "), first, F.lit(" (1 day)"))).otherwise(F.concat(F.lit("- "), first, F.lit(" → "), last, F.lit(" ("), n.cast("string"), F.lit(" days)")))


def gap_report(gaps: DataFrame) -> DataFrame:
    """(channel_id, report): the lines of each channel's missing ranges (dates as text), in order."""
    line = gap_line(F.col("first_missing"), F.col("last_missing"), F.col("n_missing"))
    return gaps.withColumn("line", line).groupBy("channel_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_missing", "line"))), lambda x: x["line"]), "\n").alias("report"))


def workspace_sections(gaps: DataFrame, names: DataFrame) -> DataFrame:
    """(channel_id, n_missing, section) of each channel with missing ranges (dates as text), named by (channel_id, name), the
    largest holes first."""
    line = gap_line(F.col("first_missing"), F.col("last_missing"), F.col("n_missing"))
    per = gaps.withColumn("line", line).groupBy("channel_id").agg(F.sum("n_missing").alias("n_missing"), F.count("*").alias("_n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_missing", "line"))), lambda x: x["line"]), "\n").alias("_lines"))
    head = F.format_string("## %s (`%s`) — %d missing day(s), %d range(s)\n\n", F.coalesce("name", F.lit("?")), "channel_id", "n_missing", "_n")
    return per.join(names, "channel_id", "left").select("channel_id", "n_missing", F.concat(head, "_lines", F.lit("\n")).alias("section")).orderBy(F.desc("n_missing"), "channel_id")


def thread_slug_body(block: Column) -> Column:
    """A block's own text: without header, reactions and files, up to the thread line; 120 characters."""
    head = F.element_at(F.split(F.concat(F.lit("\n"), block), "\n> Thread:"), 1)
    lines = F.filter(F.split(head, "\n"), lambda x: ~(x.startswith("## ") | (x.startswith(":") & x.contains("  ")) | x.startswith("📎 [") | x.startswith("[Huddle Notes]")))
    return F.left(F.regexp_replace(F.array_join(lines, "\n"), r"\A\s+|\s+\z", ""), F.lit(120))


def thread_slug(block: Column, ts: Column) -> Column:
    """A thread's name: the slug of its first message's own text, or its time where that has no letter."""
    return F.coalesce(F.nullif(slugify(thread_slug_body(block)), F.lit("")), F.concat(F.lit("ts-"), ts))


def transcript(sections: Column) -> Column:
    """Sections array<struct<type, elements: array<struct<type, name, text, bold>>>> as paragraphs; empty ones fall away."""

    def part(e: Column) -> Column:
        bold = F.concat(F.lit("**"), F.trim(e["text"]), F.lit("**"))
        return F.when(e["type"] == "user", F.concat(F.lit("**@"), e["name"], F.lit("**"))).when(e["type"] == "text", F.when(e["bold"], bold).otherwise(e["text"])).otherwise("")

    lines = F.transform(F.filter(sections, lambda s: s["type"] == "rich_text_section"), lambda s: F.trim(F.array_join(F.transform(s["elements"], part), "")))
    return F.array_join(F.array_remove(lines, ""), "\n\n")


def day_huddles(messages: DataFrame) -> DataFrame:
    """(id, place, day, slug, unique_slug): the huddles among the files (name, huddle) of messages (id, day, ts, files)."""
    each = messages.select("id", "day", "ts", F.posexplode("files").alias("place", "f")).filter("f.huddle").select("id", "day", "ts", "place", F.col("f.name").alias("slug"))
    return unique_slugs(each, "day", "slug", [F.col("ts"), F.col("id")], "place")


def huddles(files: DataFrame) -> DataFrame:
    """Adds ``unique_slug`` to (day, slug, ts, id): later ones of a day with one slug are numbered."""
    return unique_slugs(files, "day", "slug", [F.col("ts")], "id")
