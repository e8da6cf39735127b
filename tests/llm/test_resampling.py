"""Importance resampling against a plain version, on odd rows, ties and repeated rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strandlog.llm import resampling

DOCS = "doc_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text: str | None) -> tuple[int, list[int]]:
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def plain(docs: list[tuple], target: list[str | None]) -> list[tuple]:
    rows = [(i, *plain_features(t)) for i, t in docs]
    s, t = Counter(b for *_, f in rows for b in f), Counter(b for x in target for b in plain_features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(float(t[b] + 1) * float(all_s + 10_000) / (float(s[b] + 1) * float(all_t + 10_000)))) for b in s}
    scored = []
    for i, n, f in rows:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20))
    order = sorted((r for r in scored if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = order[: 25 * len(order) // 100]
    ranks: dict = {}
    for k, r in enumerate(drawn, 1):
        ranks.setdefault(r[:4], []).append(k)
    return sorted(((*r[:4], _next(ranks, r[:4])) for r in scored), key=repr)


def _next(ranks: dict, key: tuple):
    return ranks[key].pop(0) if ranks.get(key) else None


def got(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(n: int, seed: int) -> list[tuple]:
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "x1", "Ünï", "naïve", "日本", "the", "of", "a" * 60]
    return [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 70)))) for i in range(n)]


def test_against_a_plain_version(spark):
    odd = [(1000, None), (1001, ""), (1002, "  \n\t.,;"), (1003, "word " * 30_000), (None, "the of " * 30), (1004, "x" * 3000 + " y"), (5, "another text under an id that is taken " * 4)]
    docs = made(300, 1) + odd
    target = ["alpha beta gamma " * 5, None, "", "the naïve 日本"]
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    assert got(resampling.op11(df, spark.createDataFrame([(x,) for x in target], "text string"))) == plain(docs, target)


@pytest.mark.parametrize("size", [64, 300, 1 << 20])
def test_slices_change_nothing(monkeypatch, size):
    monkeypatch.setattr(resampling, "_SLICE", size)
    texts = [t for _, t in made(60, 2)] + ["", "é" * 500 + " b", "a b c " * 200, "q" * 700, ""]
    raw = [t.encode() for t in texts]
    found = [([], []) for _ in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    for words, of, bucket in resampling.features(np.frombuffer(b"".join(raw), np.uint8), offsets):
        for k in words.tolist():
            found[k][0].append(k)
        for k, b in zip(of.tolist(), bucket.tolist(), strict=True):
            found[k][1].append(b)
    for (w, f), t in zip(found, texts, strict=True):
        n, want = plain_features(t)
        assert len(w) == n and sorted(f) == sorted(want)


def test_repeated_rows_take_successive_ranks(spark, monkeypatch):
    monkeypatch.setattr(resampling, "_SPREAD", 7)
    docs = made(40, 3) + [(77, "alpha beta " * 15)] * 60
    target = ["alpha beta " * 50]
    rows = resampling.op11(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(x,) for x in target], "text string")).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == plain(docs, target)
    ranks = sorted(r["rank"] for r in rows if r["rank"])
    assert ranks == list(range(1, len(ranks) + 1))


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, t, "k", 1, 2.0) for i, t in made(50, 4)], DOCS + ", rank string, score int, `a.b` double")
    none = spark.createDataFrame([], "text string")
    assert resampling.op11(docs, none).count() == 50
    assert resampling.op11(docs.limit(0), none).count() == 0
    drawn = resampling.resample(docs, docs.limit(5))
    assert drawn.filter("rank is not null and text is not null").count() == drawn.count() > 0
    assert set(drawn.columns) == {"doc_id", "text_hash", "text", "rank"}


def test_text_ids(spark):
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in made(50, 4)], "doc_id string, text string")
    assert dict(resampling.op11(docs, docs).dtypes)["doc_id"] == "string"
