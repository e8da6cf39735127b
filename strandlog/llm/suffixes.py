"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

Suffixes lie in buckets of their first Q bytes. A bucket is refined by the pair (bucket of a suffix, bucket of the
suffix STEP bytes later), which makes buckets of Q + STEP bytes, and these are refined in the same way to LENGTH bytes:
24, 37, 50. At every depth, buckets that hold suffixes of one document alone are dropped before the next. Identifiers
of buckets are hashes, the same in every task, so that a bucket meets where rows are grouped by its identifier.

Not every suffix is sent. Of the LENGTH - Q + 1 suffixes that begin inside a string of LENGTH bytes, the one with the
least identifier is its anchor, so equal strings have equal anchors, and successive strings with one anchor form a
context. Steps:

1. Anchors meet by identifier, packed by the million; those in buckets of two documents go on with their places.
2. Contexts are refined as a whole, by the buckets of LENGTH bytes of their first and last strings. One that a smaller
   document holds too is removed; of the others, those go on whose anchor's bucket holds other contexts too.
3. These are cut at the anchor into the strings that begin up to STEP bytes before it and those that begin earlier. All
   strings of a part share Q + STEP bytes, its bucket of the second depth, in which it is judged like a context.
4. The strings of the parts that go on are refined to LENGTH bytes one by one.

What decides in steps 2 to 4 is 128 bits: the refined identifier, and beside it XXH3 of the bytes themselves.

Nulls and edges: a null or empty text has no bytes; a text under LENGTH bytes loses nothing; rows that repeat an id
are no smaller documents to each other; a row without an id is left as it is and takes nothing from others; an empty
table gives no rows; texts are read in overlapping blocks of BLOCK_BYTES, however long. Spans count bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, numbered, stored

LENGTH, Q, STEP = 50, 24, 13  # Q + 2 * STEP = LENGTH
WIDTH = LENGTH - Q + 1
#: Anchors that one group of step 1 sorts, about; bytes of text whose anchors are packed together; bytes that are hashed at once; places that are refined at once.
GROUP, TEXT_AT_ONCE, BLOCK_BYTES, AT_ONCE = 1 << 20, 1 << 24, 1 << 21, 1 << 16
#: Bytes of text whose contexts are shuffled at a time, until there are so many slices; each reads the texts again.
SLICE_BYTES, MOST_SLICES = 1 << 30, 8
_C = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _pair(here: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Identifiers of refined buckets from those of suffixes and of later ones."""
    return _mix(here * _C + later)


def _eight(data: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(data, 8)


def first_buckets(data: np.ndarray) -> np.ndarray:
    """Identifier of the first Q bytes of each suffix of so many bytes."""
    n = len(data) - Q + 1
    b8 = _mix(np.ascontiguousarray(_eight(data)).view("<u8").ravel() + _C)
    return _pair(_pair(b8[:n], b8[8 : n + 8]), b8[16 : n + 16])


def _first(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The same for the suffixes at some places alone."""
    b8 = lambda p: _mix(np.ascontiguousarray(_eight(data)[p]).view("<u8")[..., 0] + _C)
    return _pair(_pair(b8(at), b8(at + 8)), b8(at + 16))


def _second(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _pair(_first(data, at), _first(data, at + STEP))


def _third(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _pair(_second(data, at), _second(data, at + STEP))


def _least(a: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` successive values."""
    s = 1
    while 2 * s <= width:
        a = np.minimum(a[:-s], a[s:])
        s *= 2
    return np.minimum(a[: s - width], a[width - s :]) if width > s else a


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, document, start, count) of each context of documents that lie one behind the other, cut at ``bounds``: its
    anchor's identifier, the document's number, and the strings in it, by their place in ``data``."""
    parts = [(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)]
    edges = np.concatenate([bounds, np.maximum(bounds[1:] - LENGTH + 1, bounds[:-1])])
    for at in range(0, len(data) - LENGTH + 1, BLOCK_BYTES):
        least = _least(first_buckets(data[at : at + BLOCK_BYTES + LENGTH - 1]), WIDTH)
        inside = edges[(edges > at) & (edges < at + len(least))] - at
        start = np.unique(np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, inside]))
        count = np.diff(np.append(start, len(least)))
        if (count > WIDTH).any():  # where a text repeats itself; contexts stay short
            pieces = -(-count // WIDTH)
            start = np.repeat(start, pieces) + WIDTH * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            count = np.diff(np.append(start, len(least)))
        document = np.searchsorted(bounds, at + start, "right") - 1
        whole = at + start + LENGTH <= bounds[document + 1]
        parts.append((least[start[whole]], document[whole], at + start[whole], count[whole]))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings or binaries, one behind the other, and their bounds. Nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    bounds = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if places is not None and len(column) else np.zeros(len(column) + 1)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), bounds.astype(np.int64)


def _bytes(x) -> bytes:
    return (x.as_py() or "").encode("utf-8", "surrogatepass")


# Step 1 compares identifiers by their first 48 bits; what agrees by chance goes on to step 2 and falls there.
_PACKED = "part long, kind long, heads binary, twice binary, k binary, n binary, start binary, count binary"
_FOUND = "k long, n long, head long, place long"


def _planes(a: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of whole numbers, byte by byte, so that equal high bytes lie together and pack well."""
    return a.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _numbers(x, size: int) -> np.ndarray:
    out = np.zeros((len(x.as_py()) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(x.as_py(), np.uint8).reshape(size, -1).T
    return out.view("<i8").ravel()


def _packed(n_parts: int):
    """Batches of (k, n, text) to packed anchors by part.

    Of a bucket that two documents of a pack share, one anchor goes to its part, marked; the places of all of them are
    sent beside it (kind 1), so that a bucket's share of a part does not grow with the documents that hold it.
    """

    def flush(data: np.ndarray, bounds: np.ndarray, ks: np.ndarray, ns: np.ndarray) -> list:
        a, document, start, count = anchors(data, bounds)
        k, n, start, serial = ks[document], ns[document], start - bounds[document], int(ks[0] if len(ks) else 0)
        a = (a >> np.uint64(16)).view(np.int64)
        order = np.argsort(a, kind="stable")
        s, d = a[order], k[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([first, [len(s)]]))
        both = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first) if len(s) else np.zeros(0, bool)
        lone, marked = order[np.repeat(~both, size)], order[first[both]]
        out = []

        def add(rows: np.ndarray, kind: int, twice: np.ndarray, part: np.ndarray) -> None:
            by = np.lexsort((rows, part))
            rows, twice, part = rows[by], twice[by], part[by]
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(rows) else []
            for i, j in zip(cuts, [*cuts[1:], len(rows)], strict=False):
                r = rows[i:j]
                out.append((int(part[i]), kind, _planes(a[r], 6), np.packbits(twice[i:j]).tobytes(), _planes(k[r], 8), _planes(n[r], 8) if n[r].any() else b"", _planes(start[r], 4), _planes(count[r], 1)))

        rows = np.concatenate([lone, marked])
        twice = np.concatenate([np.zeros(len(lone), bool), np.ones(len(marked), bool)])
        # least hashes crowd at the low end; mixed once more they spread evenly
        add(rows, 0, twice, ((_mix(a[rows].view(np.uint64)) >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64))
        sure = np.sort(order[np.repeat(both, size)])
        add(sure, 1, np.zeros(len(sure), bool), np.full(len(sure), serial % n_parts, np.int64))
        return out

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64()] * 2 + [pa.binary()] * 6
        names = [x.split()[0] for x in _PACKED.split(", ")]

        def of(rows: list):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            data, bounds = _bytes_of(b.column(2))
            ks, ns = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            low = 0
            while low < len(ks):
                high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + TEXT_AT_ONCE, "right")) - 1)
                if rows := flush(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low], ks[low:high], ns[low:high]):
                    yield of(rows)
                low = high

    return run


def _meet(table):
    """One part: the places whose anchor's bucket holds two documents."""
    import pyarrow as pa

    out = []
    cols = {c: table.column(c) for c in table.schema.names}
    heads = [_numbers(x, 6) for x in cols["heads"]]
    ks = [_numbers(x, 8) for x in cols["k"]]
    ns = [_numbers(x, 8) if len(x.as_py()) else np.zeros(len(h), np.int64) for x, h in zip(cols["n"], heads, strict=True)]
    places = [_numbers(s, 4) * 64 + _numbers(c, 1) for s, c in zip(cols["start"], cols["count"], strict=True)]
    kind = cols["kind"].to_pylist()

    def add(k, n, head, place) -> None:
        out.append(pa.table({"k": pa.array(k), "n": pa.array(n), "head": pa.array(head), "place": pa.array(place)}))

    for i in np.flatnonzero(kind):
        add(ks[i], ns[i], heads[i], places[i])
    asked = np.flatnonzero(np.array(kind) == 0)
    if len(asked):
        h, k, n, place = (np.concatenate([c[i] for i in asked]) for c in (heads, ks, ns, places))
        twice = np.concatenate([np.unpackbits(np.frombuffer(cols["twice"][int(i)].as_py(), np.uint8))[: len(heads[i])] for i in asked])
        order = np.argsort(h, kind="stable")
        s, d, t = h[order], k[order], twice[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        live = (np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)) | np.maximum.reduceat(t, first).astype(bool)
        # what is marked has its places sent as kind 1 already
        rows = order[np.repeat(live, np.diff(np.concatenate([first, [len(s)]]))) & (t == 0)]
        add(k[rows], n[rows], h[rows], place[rows])
    return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in ("k", "n", "head", "place")})


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    view = memoryview(data)
    return np.fromiter((xxh3_64_intdigest(view[i:j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts)).view(np.int64)


def _named(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray]:
    """What successive strings, those that begin from ``start`` to before ``end``, are judged by."""
    return {"name": _pair(_third(data, start), _third(data, end - 1)).view(np.int64), "digest": _digests(data, start, end - 1 + LENGTH)}


def _over_documents(step):
    """Batches of (k, n, text, found: list of (head, place)) through ``step`` (data, head, start, count: places in data),
    which yields columns, among them ``of``, the number of the context, and ``place``, as a place in data."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            data, bounds = _bytes_of(b.column(2))
            found = b.column(3)
            size = np.diff(found.offsets.to_numpy())
            head, place = (found.flatten().field(i).to_numpy() for i in (0, 1))
            row = np.repeat(np.arange(b.num_rows), size)
            k, n = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i in range(0, len(row), AT_ONCE):
                r = row[i : i + AT_ONCE]
                for rows in step(data, head[i : i + AT_ONCE], bounds[r] + (place[i : i + AT_ONCE] >> 6), place[i : i + AT_ONCE] & 63):
                    own = r[rows.pop("of")]
                    rows["place"] -= bounds[own] * 64
                    yield pa.RecordBatch.from_pydict({"k": pa.array(k[own]), "n": pa.array(n[own]), **{c: v if isinstance(v, pa.Array) else pa.array(v) for c, v in rows.items()}})

    return run


def _contexts(data: np.ndarray, head: np.ndarray, start: np.ndarray, count: np.ndarray) -> Iterator[dict]:
    yield {"of": np.arange(len(start)), "bucket": head, **_named(data, start, start + count), "place": start * 64 + count}


def _parts(data: np.ndarray, head: np.ndarray, start: np.ndarray, count: np.ndarray) -> Iterator[dict]:
    """The parts of contexts on either side of the anchor, in their bucket of the second depth, with their bytes."""
    import pyarrow as pa

    end, of = start + count, np.arange(len(start))
    while len(start):
        # a string's anchor is the first suffix inside it with the least identifier; where that comes again, later strings have another
        anchor = start + np.argmax((_first(data, start[:, None] + np.arange(WIDTH)) >> np.uint64(16)).view(np.int64) == head[:, None], axis=1)
        upto = np.minimum(end, anchor + 1)
        split = np.maximum(start, np.minimum(upto, anchor - STEP))  # strings before it begin over STEP bytes ahead of the anchor
        for a, e, at in ((start, split, anchor - STEP), (split, upto, anchor)):
            some = a < e
            if some.any():
                a, e = a[some], e[some]
                size = e - 1 + LENGTH - a
                flat = data[np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                whole = pa.BinaryArray.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(flat)])
                yield {"of": of[some], "bucket": _second(data, at[some]).view(np.int64), **_named(data, a, e), "place": a * 64 + e - a, "bytes": whole}
        rest = upto < end
        start, end, head, of = upto[rest], end[rest], head[rest], of[rest]


def _strings(batches: Iterator) -> Iterator:
    """The strings of parts (k, n, place, bytes), in buckets of the third depth."""
    import pyarrow as pa

    for b in batches:
        data, bounds = _bytes_of(b.column(3))
        place = b.column(2).to_numpy(zero_copy_only=False)
        start, count = place >> 6, place & 63
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(bounds[:-1], count) + inside
        if len(at):
            cols = {c: np.repeat(b.column(i).to_numpy(zero_copy_only=False), count) for i, c in ((0, "k"), (1, "n"))}
            cols |= {"name": _third(data, at).view(np.int64), "digest": _digests(data, at, at + LENGTH), "place": (np.repeat(start, count) + inside) * 64 + 1}
            yield pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in cols.items()})


def removed_runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes (starts, ends) that strings cover; a place is 64 * start + count of successive strings."""
    places = np.sort(places)
    start, end = places >> 6, (places >> 6) + (places & 63) - 1 + LENGTH
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])]


def _results(batches: Iterator) -> Iterator:
    import pyarrow as pa

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for b in batches:
        rows = []
        for x, found in zip(b.column(1), b.column(2), strict=True):
            text = _bytes(x)
            places = np.asarray(found.values) if found.is_valid else np.zeros(0, np.int64)
            starts, ends = removed_runs(places) if len(places) else (places, places)
            kept, at = hashlib.sha256(), 0
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                kept.update(text[at:s])
                at = e
            kept.update(text[at:])
            rows.append((len(text), int((ends - starts).sum()), len(starts), kept.hexdigest(), [{"start": s, "end": e} for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], span)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def slices(n_bytes: int) -> int:
    """In how many slices, one after the other, contexts are named and judged, so that one slice's shuffles are on disk at a time."""
    return int(min(MOST_SLICES, 1 + n_bytes // SLICE_BYTES))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (array<struct<start, end>>, in bytes) for every row."""
    keyed, repeated = numbered(docs, id_col, text_col)
    texts = keyed.filter("k is not null").select("k", "n", "text")
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_parts = 1 + 2 * n_bytes // (WIDTH + 1) // GROUP

    n_slices = slices(n_bytes)

    def sliced(rows: DataFrame, keys: list[str], i: int) -> DataFrame:
        return rows.filter(F.pmod(F.xxhash64(*keys), F.lit(n_slices)) == i) if n_slices > 1 else rows

    def of_texts(rows: DataFrame, step, shape: str) -> DataFrame:
        """Rows (k, n, head, place) gathered per document, beside its text, through ``step``."""
        found = []
        for i in range(n_slices):
            lists = sliced(rows, ["k", "n"], i).groupBy("k", "n").agg(F.collect_list(F.struct("head", "place")).alias("found"))
            found.append(stored(sliced(texts, ["k", "n"], i).join(lists, ["k", "n"]).select("k", "n", "text", "found").mapInArrow(_over_documents(step), f"k long, n long, {shape}")))
        return reduce(DataFrame.unionByName, found)

    def judged_slice(rows: DataFrame) -> DataFrame:
        groups = stored(rows.groupBy("bucket", "name", "digest").agg(F.min("k").alias("first"), F.max("k").alias("last")))
        several = groups.groupBy("bucket").agg(F.min("first").alias("low"), F.max("last").alias("high"), F.count("*").alias("n_groups")).filter("low < high and n_groups > 1").select("bucket", F.lit(True).alias("open"))
        asked = stored(groups.join(several, "bucket", "left").filter("first < last or open").select("name", "digest", "first", F.coalesce("open", F.lit(False)).alias("open")))
        discard(groups)
        found = stored(rows.join(asked, ["name", "digest"]).withColumn("whole", F.col("k") > F.col("first")).filter("whole or open").drop("name", "digest", "first", "open"))
        discard(asked)
        return found

    def judged(rows: DataFrame) -> DataFrame:
        """Of rows in buckets, those that a smaller document holds as a whole (``whole``), and those whose bucket holds
        others of another document; and only these. A bucket lies in one slice."""
        found = reduce(DataFrame.unionByName, [judged_slice(sliced(rows, ["bucket"], i)) for i in range(n_slices)])
        discard(rows)
        return found

    live = stored(texts.mapInArrow(_packed(n_parts), _PACKED).groupBy("part").applyInArrow(_meet, _FOUND))
    named = of_texts(live, _contexts, "bucket long, name long, digest long, place long")
    discard(live)
    contexts = judged(named)
    parts = judged(of_texts(contexts.filter("not whole").withColumnRenamed("bucket", "head"), _parts, "bucket long, name long, digest long, place long, bytes binary"))
    strings = stored(parts.filter("not whole").select("k", "n", "place", "bytes").mapInArrow(_strings, "k long, n long, name long, digest long, place long"))
    first = strings.groupBy("name", "digest").agg(F.min("k").alias("first"), F.max("k").alias("last")).filter("first < last").drop("last")
    single = stored(strings.join(first, ["name", "digest"]).filter("k > first").select("k", "n", "place"))
    discard(strings)

    whole = contexts.filter("whole").select("k", "n", "place").unionByName(parts.filter("whole").select("k", "n", "place"))
    places = whole.unionByName(single).groupBy("k", "n").agg(F.collect_list("place").alias("places"))
    kind = dict(docs.dtypes)[id_col]
    both = keyed.join(places, ["k", "n"], "left")
    if repeated:  # rows that repeat id and text lose the same bytes
        both = both.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))
    both = both.select("doc_id", "text", "places")
    return both.mapInArrow(_results, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:bigint,end:bigint>>")


def op3(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
