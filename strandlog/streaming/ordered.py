"""Ordered apply: each stream's events take effect once and in the order of their offsets, in whatever order they come.

A stream's state is its cursor (all offsets up to it are applied), the events that came before their turn, and what the
applied ones made. An event at the cursor's next offset is applied and moves the cursor; a later one waits, however
long; one at or before the cursor came twice and does nothing. Effects and cursor are rows of one output, written by batch
(``apply.keep_changes``), so that they advance together and a batch that runs again replaces itself.

Waiting events are bounded by how far events overtake each other, the rest of the state by the messages there are. Streams are
independent; one stream's events are applied one after the other, which is what their order means. Streams that hash to one
shard share a group (``shards``), so that a call of state serves many of them; a batch reads and writes the cursors of the
shards that it touches, and of their messages those of the times that it touches.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .shards import SHARDS, by_shard, grouped, packed, unpacked

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "off long, kind string, msg_ts string, previous_ts string, deleted_ts string, parent_ts string, reply_count long"
COLUMNS = [c.split()[0] for c in EVENT.split(", ")]
Event = namedtuple("Event", COLUMNS)
#: Messages whose times begin with the same characters lie in one block: of times in seconds, those of some twelve days.
BLOCK = 4
#: ``what``: message (with ``alive`` and its replies) or cursor (``off`` alone).
RESULT = "stream string, what string, ts string, off long, alive boolean, reply_count long"


def effects(e: Event, get: Any, put: Any) -> None:
    """What an event does to the messages of its stream; get(ts) gives (off, alive, reply_count) or None."""
    if e.kind in ("message", "message_changed"):
        if e.previous_ts is not None and e.previous_ts != e.msg_ts and e.kind == "message_changed":
            put(e.previous_ts, (e.off, False, 0))
        if e.msg_ts is not None:
            was = get(e.msg_ts)
            put(e.msg_ts, (e.off, True, max(e.reply_count or 0, was[2] if was and was[1] else 0)))
    elif e.kind == "message_deleted" and e.deleted_ts is not None:
        put(e.deleted_ts, (e.off, False, 0))
    elif e.kind == "parent_replied" and e.parent_ts is not None:
        was = get(e.parent_ts)
        if was and was[1]:
            put(e.parent_ts, (e.off, True, was[2] + 1))


class InOrder(StatefulProcessor):
    """A shard's streams: their cursors and waiting events as one value, their messages in blocks of time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.streams = handle.getValueState("streams", "states string")
        self.messages = handle.getMapState("messages", "block string", "messages string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        found = self.streams.get()
        states, before = unpacked(found[0]) if found else {}, found[0] if found else None
        blocks: dict[str, dict] = {}
        touched: set[str] = set()
        out: list[Row] = []

        def block(ts: str) -> dict:
            name = ts[:BLOCK]
            if name not in blocks:
                kept = self.messages.getValue((name,))
                blocks[name] = unpacked(kept[0]) if kept else {}
            return blocks[name]

        for (stream,), mine in grouped(rows, ["stream"]).items():
            was = states.get((stream,))
            start = cursor = was[0] if was else 0
            waiting = {e[0]: Event(*e) for e in was[1]} if was else {}
            changed: dict[str, None] = {}
            for r in mine:
                if r.off > cursor and r.off not in waiting:
                    waiting[r.off] = Event(*(r[c] for c in COLUMNS))

            def get(ts: str) -> list | None:
                return block(ts).get((stream, ts))  # noqa: B023

            def put(ts: str, value: tuple) -> None:
                block(ts)[stream, ts] = list(value)  # noqa: B023
                changed[ts] = None  # noqa: B023
                touched.add(ts[:BLOCK])

            while cursor + 1 in waiting:
                cursor += 1
                effects(waiting.pop(cursor), get, put)
            states[stream,] = [cursor, [list(e) for e in waiting.values()]]
            if cursor > start or not was:
                out.append(Row(stream=stream, what="cursor", ts=None, off=cursor, alive=None, reply_count=None))
            for ts in changed:
                off, alive, n = get(ts)
                out.append(Row(stream=stream, what="message", ts=ts, off=off, alive=alive, reply_count=n))
        for name in touched:
            self.messages.updateValue((name,), (packed(blocks[name]),))
        now = packed(states)
        if now != before:
            self.streams.update((now,))
        yield from out

    def close(self) -> None:
        pass


def in_order(events: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Changes of messages and cursors of a streaming ``events`` (stream and the columns of an event)."""
    one = events.filter("stream is not null and off is not null").select("stream", *COLUMNS)
    return by_shard(one, ["stream"], shards).transformWithState(statefulProcessor=InOrder(), outputStructType=RESULT, outputMode="update", timeMode="none")


def with_rocks(spark: SparkSession):
    """State that does not have to fit in memory: a context in which streaming queries are started."""
    from contextlib import contextmanager

    @contextmanager
    def held():
        name = "spark.sql.streaming.stateStore.providerClass"
        before = spark.conf.get(name, None)
        spark.conf.set(name, _ROCKS)
        try:
            yield
        finally:
            spark.conf.set(name, before) if before else spark.conf.unset(name)

    return held()


def messages_of(changes: DataFrame) -> DataFrame:
    """(stream, ts, off, reply_count) of the messages that stand, from kept changes: the last change of each counts.

    Offsets only grow along a stream's changes, so the greatest is the last, whatever batch it came in.
    """
    last = changes.filter("what = 'message'").groupBy("stream", "ts").agg(F.max_by(F.struct("off", "alive", "reply_count"), "off").alias("x"))
    return last.filter("x.alive").select("stream", "ts", "x.off", "x.reply_count")


def cursors_of(changes: DataFrame) -> DataFrame:
    """(stream, applied): the cursor of each stream. It never goes back."""
    return changes.filter("what = 'cursor'").groupBy("stream").agg(F.max("off").alias("applied"))
