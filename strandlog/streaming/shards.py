"""Keyed state kept by shards: keys that hash to one shard are one group of Spark's, and their states one value.

A call of state costs a round trip between Python and Spark, whatever it carries. With a group for each key that is several
for each key and batch; with a group for each shard it is several for each shard that a batch touches. A batch reads and
writes the states of the shards that it touches and of no others. The number of shards belongs to a query's checkpoint: it
stays as long as that does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: So many shards hold the keys of an operator. More make a state's value smaller and a large batch's calls more.
SHARDS = 1 << 12


class Rule:
    """What an operator does with one key; a state is a list of plain values, None before the first."""

    keys: list[str]

    def take(self, key: tuple, rows: list[Row], was: list | None, now: int | None) -> tuple[list | None, list[Row]]:
        """The key's state after rows, and what they give; ``now``: the clock, where the operator goes by it."""
        raise NotImplementedError

    def due(self, state: list) -> int | None:
        """When the key is to be looked at although nothing comes."""
        return None

    def expire(self, key: tuple, state: list) -> tuple[list | None, list[Row]]:
        raise NotImplementedError


def grouped(rows: Iterator[Row], keys: list[str]) -> dict[tuple, list[Row]]:
    out: dict[tuple, list[Row]] = {}
    for r in rows:
        out.setdefault(tuple(r[k] for k in keys), []).append(r)
    return out


def packed(states: dict[tuple, list]) -> str:
    return json.dumps([[*k, s] for k, s in states.items()], separators=(",", ":"))


def unpacked(text: str | None) -> dict[tuple, list]:
    return {tuple(k): s for *k, s in json.loads(text)} if text else {}


class _Shard(StatefulProcessor):
    """One shard's keys, each by its rule; of all moments at which a key is due the least is the shard's timer."""

    def __init__(self, rule: Rule, clock: bool) -> None:
        self.rule, self.clock = rule, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "states string, timer long")

    def _keep(self, states: dict[tuple, list], timer: int | None, fired: bool) -> None:
        due = min((d for s in states.values() if (d := self.rule.due(s)) is not None), default=None)
        if due != timer or fired:
            if timer is not None and not fired:  # one that fires leaves none
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.known.update((packed(states), due)) if states else self.known.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        found = self.known.get()
        states, timer = (unpacked(found[0]), found[1]) if found else ({}, None)
        now, changed = timerValues.getCurrentProcessingTimeInMs() if self.clock else None, False
        for k, mine in grouped(rows, self.rule.keys).items():
            was = states.get(k)
            state, out = self.rule.take(k, mine, was, now)
            if state != was:
                changed = True
                if state is None:
                    del states[k]
                else:
                    states[k] = state
            yield from out
        if changed:
            self._keep(states, timer, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        found = self.known.get()
        if not found or found[1] != expiredTimerInfo.getExpiryTimeInMs():
            return
        states = unpacked(found[0])
        now = timerValues.getCurrentProcessingTimeInMs() if self.clock else timerValues.getCurrentWatermarkInMs()
        for k, state in list(states.items()):
            due = self.rule.due(state)
            if due is not None and due <= now:
                after, out = self.rule.expire(k, state)
                if after is None:
                    del states[k]
                else:
                    states[k] = after
                yield from out
        self._keep(states, found[1], True)

    def close(self) -> None:
        pass


def by_shard(rows: DataFrame, keys: list[str], shards: int = SHARDS) -> Any:
    """``rows`` grouped by the shard of their keys."""
    return rows.withColumn("shard", F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int")).groupBy("shard")


def by_rule(rows: DataFrame, rule: Rule, shape: str, time_mode: str = "none", shards: int = SHARDS) -> DataFrame:
    """What ``rule`` gives of a streaming ``rows``, key by key; the state lies in shards."""
    return by_shard(rows, rule.keys, shards).transformWithState(statefulProcessor=_Shard(rule, time_mode == "processingTime"), outputStructType=shape, outputMode="update", timeMode=time_mode)
