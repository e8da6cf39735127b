"""Substring dedup by content-defined chunks.

A gear hash rolls over the last SEEN bytes; a chunk ends where it is no larger than at the LEAST places before and
behind. Such places depend on the bytes around them alone, not on where the last chunk ended, so that a passage is cut
alike in every document but for SEEN + LEAST bytes at its start and LEAST at its end, and an insertion moves the chunks
behind it without changing them. Where bytes repeat themselves, ends are LEAST bytes apart or more.
Chunks are deduplicated by a 128-bit digest: the first, by document and place, stays. LEAST is chosen so that a passage of
some fifty words holds a whole chunk wherever it stands, and a chunk is longer than what texts share by chance.

Nulls and edges: a null or empty text has no chunks; rows that repeat an id are told apart and the first stays; a row
without an id is left as it is and takes nothing from others; a text without an end is cut every MOST bytes; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, stored

#: Bytes of a chunk: at least (twice as many on average), at most; bytes that the hash sees (a power of two).
LEAST, MOST, SEEN = 48, 1024, 16
#: The gear: a random number for each byte, from a seed.
SEED = 7


def gear() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(text: bytes, table: np.ndarray) -> list[int]:
    """Ends of the chunks, the text's end included."""
    h, s = table[np.frombuffer(text, np.uint8)], 1
    while s < SEEN:  # sums over 1, 2, 4, ... bytes
        h[s:] += h[:-s] << np.uint32(s)
        s *= 2
    out, last, n = [], 0, len(text)
    ends = []
    if n > 2 * LEAST:
        low, s = h, 1  # least over 1, 2, 4, ... and at last LEAST places
        while 2 * s <= LEAST:
            low = np.minimum(low[:-s], low[s:])
            s *= 2
        if LEAST > s:
            low = np.minimum(low[: s - LEAST], low[LEAST - s :])
        h = h[LEAST : n - LEAST]
        ends = (np.flatnonzero((h <= low[: len(h)]) & (h <= low[LEAST + 1 :])) + LEAST + 1).tolist()
    for e in ends:
        while e - last > MOST:
            last += MOST
            out.append(last)
        if e - last >= LEAST:
            out.append(e)
            last = e
    while n - last > MOST:
        last += MOST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def _chunks(batches: Iterator) -> Iterator:
    import pyarrow as pa
    from xxhash import xxh3_128_digest

    table = gear()
    names = ["high", "low", "k", "n", "start", "length", "again"]
    for b in batches:
        parts, size = [], 0
        for i, (k, n, x) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True)):
            text = (x.as_py() or "").encode("utf-8", "surrogatepass")
            if text:
                ends = cuts(text, table)
                starts = [0, *ends[:-1]]
                digests = [xxh3_128_digest(text[s:e]) for s, e in zip(starts, ends, strict=True)]
                seen, again = set(), []
                for d in digests:
                    again.append(d in seen)
                    seen.add(d)
                d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                starts, ends = np.array(starts), np.array(ends)
                parts.append((d[:, 0], d[:, 1], np.full(len(ends), k, np.int64), np.full(len(ends), n, np.int64), starts, ends - starts, np.array(again)))
                size += len(ends)
            if parts and (size > 200_000 or i == b.num_rows - 1):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names)
                parts, size = [], 0


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_chunks, n_dup_chunks, n_removed, removed (array<struct<start, length>>, bytes, by start) for every
    row."""
    keyed, repeated = numbered(docs, id_col, text_col)
    texts = keyed.filter("k is not null").select("k", "n", "text")
    chunks = stored(texts.mapInArrow(_chunks, "high long, low long, k long, n long, start long, length long, again boolean"))
    place = F.struct("k", "n") if repeated else F.col("k")
    spans = F.sort_array(F.collect_list(F.struct("start", "length")))
    # of a document's own copies only the first asks; the others are repeats whatever other documents hold
    once = chunks.filter("not again")
    shared = once.groupBy("high", "low").agg(F.min(place).alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times")
    other = once.join(shared.hint("merge"), ["high", "low"]).filter(place != F.col("first")).select("k", "n", "start", "length")
    gone = other.unionByName(chunks.filter("again").select("k", "n", "start", "length")).groupBy("k", "n").agg(spans.alias("removed"))
    sizes = chunks.groupBy("k", "n").agg(F.count("*").alias("n_chunks"))
    none, zero = F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)"), F.lit(0).cast("bigint")
    rows = keyed.select("doc_id", "k", "n", "copies", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes")).join(sizes, ["k", "n"], "left").join(gone, ["k", "n"], "left")
    if repeated:  # of rows that repeat id and text the first is judged, the others are repeats as a whole
        twice = chunks.join(keyed.filter("copies > 1").select("k", "n"), ["k", "n"], "left_semi").groupBy("k", "n").agg(spans.alias("all"))
        rows = rows.join(twice, ["k", "n"], "left").select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))
        rows = rows.withColumn("removed", F.when(F.col("copy") > 1, F.col("all")).otherwise(F.col("removed")))
    removed = F.coalesce("removed", none)
    return rows.select("doc_id", "n_bytes", F.coalesce("n_chunks", zero).alias("n_chunks"), F.size(removed).cast("bigint").alias("n_dup_chunks"), F.aggregate(removed, zero, lambda a, x: a + x["length"]).alias("n_removed"), removed.alias("removed"))


def op5(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_chunks, n_dup_chunks, n_removed, removed (start:length of each removed chunk, comma-joined)."""
    return repeats(docs).withColumn("removed", F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["length"])), ","))
