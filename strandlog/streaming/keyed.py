"""Keyed state that lives as long as its keys: events of one family once, corrections of what is posted again, the
references that each block holds, and keys that fall silent.

Each operator emits changes only; ``apply.keep_changes`` writes them by batch. State is Spark's, in RocksDB
(``ordered.with_rocks``), in shards of keys (``shards``), and is restored with the query's progress. Inside a batch a key's rows
are taken in order of ``id`` or time, whatever their order in the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..operators.ingest import family_key
from .shards import Rule, by_rule


def first_of_family(events: DataFrame) -> DataFrame:
    """(stream, kind, key, id) of streaming ``events`` (id, stream, kind, payload): the least id of each stream and family key.

    All families in one aggregate, whose state never ends. Rows without a whole key equal none: they take no state, all
    pass, and have no key here. A key is given again when a batch brings more of it; ``first_ids`` reads what was kept.
    """
    keyed = events.withColumn("key", family_key(F.col("kind")))
    once = keyed.filter("key is not null").groupBy("stream", "kind", "key").agg(F.min("id").alias("id"))
    return once.unionByName(keyed.filter("key is null").select("stream", "kind", "key", "id"))


def first_ids(changes: DataFrame) -> DataFrame:
    """(id) of the events that a log takes, from kept changes of ``first_of_family``."""
    return changes.filter("key is not null").groupBy("stream", "kind", "key").agg(F.min("id").alias("id")).select("id").unionByName(changes.filter("key is null").select("id"))


class _Corrections(Rule):
    """State: the first content, and what edits have said since."""

    keys = ["stream", "msg_ts"]

    def take(self, key: tuple, rows: list[Row], was: list | None, now: int | None) -> tuple[list, list[Row]]:
        first, said, out = was[0] if was else None, list(was[1]) if was else [], []
        for r in sorted(rows, key=lambda r: r.id):
            if r.kind == "message" and first is None:
                first = r.content
            elif (r.kind != "message" or r.content != first) and r.content not in said:
                said.append(r.content)
                if r.kind == "message":
                    out.append(Row(stream=key[0], msg_ts=key[1], id=r.id, content=r.content))
        return [first, said], out


#: Messages are many more than streams.
MESSAGE_SHARDS = 1 << 14


def corrections(events: DataFrame) -> DataFrame:
    """(stream, msg_ts, id, content): the edits that a log owes to base messages which come again with other content.

    ``events``: id, stream, kind (message or message_changed), msg_ts, content (as text, no null). One edit for each new
    content: none where it is the first content, was said by an edit before, or has been given already.
    """
    one = events.filter("stream is not null and msg_ts is not null").select("stream", "msg_ts", "id", "kind", "content")
    return by_rule(one, _Corrections(), "stream string, msg_ts string, id long, content string", shards=MESSAGE_SHARDS)


class _Mentions(Rule):
    """State: the newest version's offset and references."""

    keys = ["key"]

    def take(self, key: tuple, rows: list[Row], was: list | None, now: int | None) -> tuple[list | None, list[Row]]:
        newest = max(rows, key=lambda r: r.off)
        if was and was[0] >= newest.off:
            return was, []
        old, new = set(was[1] if was else ()), set(newest.refs or ())
        return [newest.off, sorted(new)], [Row(key=key[0], ref=ref, off=newest.off, present=ref in new) for ref in sorted(old ^ new)]


def mention_changes(blocks: DataFrame) -> DataFrame:
    """(key, ref, off, present): what the index of references gains and loses as blocks (key, off, refs) come, change or go.

    A block that is gone has no refs. Versions that come late, behind a newer one, change nothing.
    """
    one = blocks.filter("key is not null").select("key", "off", "refs")
    return by_rule(one, _Mentions(), "key string, ref string, off long, present boolean", shards=MESSAGE_SHARDS)


def mention_index(changes: DataFrame) -> DataFrame:
    """(ref, key) as they stand, from kept changes: the last change of each pair counts."""
    last = changes.groupBy("ref", "key").agg(F.max_by("present", "off").alias("present"))
    return last.filter("present").select("ref", "key")


def dependants(changed: DataFrame, index: DataFrame, blocks: DataFrame) -> DataFrame:
    """(what, id, ref) of all that is to be made anew after changes (ref): the blocks that hold a reference to it, and the
    documents that these blocks stand in. ``index``: ref, key; ``blocks``: key, document."""
    hit = index.join(changed.select("ref").distinct(), "ref")
    documents = hit.join(blocks.select("key", "document"), "key").select(F.lit("document").alias("what"), F.col("document").alias("id"), "ref").distinct()
    return hit.select(F.lit("block").alias("what"), F.col("key").alias("id"), "ref").unionByName(documents)


class _Silence(Rule):
    """State: the last row's moment, and whether the key is silent since."""

    keys = ["key"]

    def __init__(self, after_ms: int) -> None:
        self.after = after_ms

    def take(self, key: tuple, rows: list[Row], was: list | None, now: int | None) -> tuple[list | None, list[Row]]:
        (last, silent), out = was or (None, False), []
        for ms in sorted(r.ms for r in rows) if now is None else [now]:
            if last is not None and ms < last:
                continue  # came late
            if last is not None and ms > last + self.after and not silent:
                out.append(Row(key=key[0], ms=last + self.after, silent=True))
                silent = True
            if silent:
                out.append(Row(key=key[0], ms=ms, silent=False))
            last, silent = ms, False
        return [last, silent], out

    def due(self, state: list) -> int | None:
        return None if state[1] else state[0] + self.after + 1

    def expire(self, key: tuple, state: list) -> tuple[list, list[Row]]:
        return [state[0], True], [Row(key=key[0], ms=state[0] + self.after, silent=True)]


def silences(frames: DataFrame, after_ms: int, event_time: bool = False) -> DataFrame:
    """(key, ms, silent): a key falls silent once nothing came from it for more than ``after_ms``, and speaks again with the next row.

    By the clock of the machines, ``frames`` need only (key): timers fire although nothing arrives at all. By event time,
    ``frames`` have (key, ms, at) with a watermark on ``at``, the same moment as a timestamp: a key is silent once others went on.
    """
    columns = ["key", "ms", "at"] if event_time else ["key"]
    mode = "eventTime" if event_time else "processingTime"
    return by_rule(frames.filter("key is not null").select(*columns), _Silence(after_ms), "key string, ms long, silent boolean", mode)


class _Outage(Rule):
    """State: when the run of failures began, and whether it has been told; none outside of one."""

    keys = ["key"]

    def __init__(self, min_ms: int) -> None:
        self.least = min_ms

    def take(self, key: tuple, rows: list[Row], was: list | None, now: int | None) -> tuple[list | None, list[Row]]:
        (began, told), out = was or (None, False), []
        for r in sorted(rows, key=lambda r: (r.ms, r.id)):
            if began is not None and not told and r.ms > began + self.least:
                told = True
                out.append(Row(key=key[0], began=began, ms=began + self.least))
            if r.ok:
                began, told = None, False
            elif began is None:
                began = r.ms
        return None if began is None else [began, told], out

    def due(self, state: list) -> int | None:
        return None if state[1] else state[0] + self.least + 1

    def expire(self, key: tuple, state: list) -> tuple[list, list[Row]]:
        return [state[0], True], [Row(key=key[0], began=state[0], ms=state[0] + self.least)]


def outages(attempts: DataFrame, min_ms: int) -> DataFrame:
    """(key, began, ms): one notice for each run of failures between successes, ``min_ms`` after its first, whether or not
    anything comes then; none where a success comes before. ``attempts``: key, ms, id, ok, at (the moment as a timestamp, watermarked)."""
    one = attempts.filter("key is not null").select("key", "ms", "id", "ok", "at")
    return by_rule(one, _Outage(min_ms), "key string, began long, ms long", "eventTime")
