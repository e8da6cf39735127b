"""Importance resampling toward a target distribution of hashed words and word pairs.

A document's features are its words and pairs of neighbouring words, each hashed to one of BUCKETS; a bucket's gain is
the log ratio of its share in the target and in the corpus, and a document's weight the mean gain of its features.
Gumbel noise that depends on the id alone turns drawing without replacement into taking the highest scores.

Scores are integers within fixed bounds, so the exact cut needs no sort of the corpus: scores are counted, the counts are
summed from the top, and that gives each score's first rank and the last score that is drawn from; only rows of drawn scores
are then numbered, by id, within their score.

To the driver go the counts of BUCKETS buckets and of at most some 120,000 scores, at any size of the corpus.

Nulls and edges: a null or empty text has no features and weight 0; a null id is hashed as an empty one and comes
last among ties; rows that repeat an id and a text have one score and successive ranks, in no order among themselves,
and are numbered as one row with a count, then spread over tasks again; texts of any length are read in slices of a
megabyte cut between words; an empty target weighs nothing more than the smoothing; an empty table gives an empty one; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, named, on_row_key, stored, with_row_key

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Bytes of text at once; bytes of a word up to which all words are hashed together.
_SLICE, _TOGETHER = 1 << 20, 48
#: Copies of one row from which on its ranks are spread over several rows first.
_SPREAD = 1 << 14

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)
_ONES = np.uint32(0xFFFFFFFF)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def _hashed(state: np.ndarray, block: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRC's state after each word, from a state for each: byte by byte, all words at once, the longest first."""
    order = np.argsort(-size, kind="stable")
    s, at, size = state[order], at[order], size[order]
    longer = len(size) - np.cumsum(np.bincount(np.minimum(size, _TOGETHER), minlength=_TOGETHER))[:_TOGETHER]
    for place, k in enumerate(longer):
        if not k:
            break
        s[:k] = _CRC[(s[:k] ^ block[at[:k] + place]) & 255] ^ (s[:k] >> 8)
    for i in range(int((size > _TOGETHER).sum())):
        s[i] = zlib.crc32(block[at[i] + _TOGETHER : at[i] + size[i]].tobytes(), int(s[i] ^ _ONES)) ^ 0xFFFFFFFF
    out = np.empty_like(s)
    out[order] = s
    return out


def _slices(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, bool]]:
    """(first row, byte, byte, whether the row goes on from the slice before): rows of some megabyte, or part of a longer row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        a = int(offsets[row])
        last = max(row + 1, int(np.searchsorted(offsets, a + _SLICE, "right")) - 1)
        stop, more = int(offsets[last]), False
        if last > row + 1 or stop - a <= _SLICE:
            yield row, a, stop, False
        else:
            while a < stop:
                b = min(a + _SLICE, stop)
                while b < stop and _WORD[_LOWER[data[b]]]:
                    b += 1
                yield row, a, b, more
                a, more = b, True
        row = last


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each word, row of each feature, bucket of each feature) of texts given as bytes and where each begins."""
    before = None
    for row, a, b, more in _slices(data, offsets):
        block = _LOWER[data[a:b]]
        starts = offsets[row:-1][offsets[row:-1] < b] - a if not more else np.zeros(1, offsets.dtype)
        is_word = _WORD[block]
        begins, ends = is_word.copy(), is_word.copy()
        begins[1:] &= ~is_word[:-1]
        ends[:-1] &= ~is_word[1:]
        inner = starts[(starts > 0) & (starts < len(block))]
        begins[inner] = is_word[inner]
        ends[inner - 1] = is_word[inner - 1]
        at = np.flatnonzero(begins)
        size = np.flatnonzero(ends) + 1 - at
        of = row + np.searchsorted(starts, at, "right") - 1 if not more else np.full(len(at), row)
        alone = _hashed(np.full(len(at), _ONES), block, at, size)
        second = np.flatnonzero(of[1:] == of[:-1]) + 1
        head = alone[second - 1]
        if more and before is not None and len(at):
            second, head = np.append(0, second), np.append(before, head)
        pair = _hashed(_CRC[(head ^ np.uint32(32)) & 255] ^ (head >> 8), block, at[second], size[second])
        if len(at):
            before = alone[-1]
        elif not more:
            before = None
        yield of, np.append(of, of[second]), ((np.append(alone, pair) ^ _ONES) % np.uint32(buckets)).astype(np.int64)


def _bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow as pa

    column = column.cast(pa.large_binary()).fill_null(b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8), offsets


def counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket; each task sends one count for each bucket it met."""

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, bucket in features(*_bytes_of(b.column(0)), buckets):
                total += np.bincount(bucket, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    found = docs.select(named(text_col).cast("binary").alias("text")).mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """A bucket's log ratio of smoothed shares in thousandths, rounded down."""
    t, s, k = target.astype(float), corpus.astype(float), float(len(corpus))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def scored(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(doc_id, text_hash, n_words, n_features, weight, score) of every row."""
    keyed = with_row_key(docs, id_col, text_col)
    kind = dict(keyed.dtypes)["doc_id"]

    def weighed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            n = b.num_rows
            n_words, n_features, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            for words, of, bucket in features(*_bytes_of(b.column(2)), len(gain)):
                n_words += np.bincount(words, minlength=n)
                n_features += np.bincount(of, minlength=n)
                total += np.bincount(of, weights=gain[bucket], minlength=n)  # whole numbers below 2^53
            weight = total.astype(np.int64) // np.maximum(n_features, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, (n_words, n_features, weight))], ["doc_id", "text_hash", "n_words", "n_features", "weight"])

    out = keyed.select("doc_id", "text_hash", F.col("text").cast("binary").alias("text")).mapInArrow(weighed, f"doc_id {kind}, text_hash long, n_words long, n_features long, weight long")
    label = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(label, 256), 1, 8), 16, 10).cast("double")
    return out.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))))


def ranked(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``scored()``, stored, with the rank of those drawn: ``percent`` in a hundred of those of enough words."""
    spark = rows.sparkSession
    eligible = rows.filter(F.col("n_words") >= least_words)
    histogram = sorted(((r["score"], r["count"]) for r in eligible.groupBy("score").count().collect()), reverse=True)
    n = np.array([c for _, c in histogram], np.int64)
    drawn = int(n.sum()) * percent // 100
    above = np.cumsum(n) - n
    last = int(np.searchsorted(above, drawn, "left"))  # scores from the top that are drawn from
    none = F.lit(None).cast("long")
    if not last:
        return rows.withColumn("rank", none)
    cutoff = histogram[last - 1][0]
    first = spark.createDataFrame([(s, int(a)) for (s, _), a in zip(histogram[:last], above[:last], strict=True)], "score long, above long")
    keys = ["doc_id", "text_hash", "n_words", "n_features", "weight", "score"]
    groups = eligible.filter(F.col("score") >= cutoff).groupBy(*keys).agg(F.count("*").alias("copies")).join(F.broadcast(first), "score")
    order = W.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "text_hash").rowsBetween(W.unboundedPreceding, W.currentRow)
    groups = groups.withColumn("start", F.col("above") + F.sum("copies").over(order) - F.col("copies"))
    parts = groups.withColumn("part", F.explode(F.expr(f"sequence(0L, (copies - 1) div {_SPREAD})"))).withColumn("lo", F.col("start") + F.col("part") * _SPREAD + 1)
    parts = parts.withColumn("hi", F.least(F.col("lo") + _SPREAD - 1, F.col("start") + F.col("copies"))).select(*keys, "lo", "hi").hint("rebalance")
    numbered = parts.select(*keys, F.explode(F.sequence("lo", "hi")).alias("rank")).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.filter((F.col("n_words") < least_words) | (F.col("score") < cutoff)).select(*keys, none.alias("rank"))
    return numbered.unionByName(rest)


def importance(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_hash, n_words, n_features, weight, score, rank) of every row of ``docs``."""
    gain = gains(counts(target, target_text), counts(docs, text_col))
    return ranked(stored(scored(docs, gain, id_col, text_col)), percent)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_hash, text, rank) of the documents drawn, each as often as it was."""
    drawn = importance(docs, target, id_col, text_col, target_text, percent).filter("rank is not null").select("doc_id", "text_hash", "rank")
    return on_row_key(drawn, with_row_key(docs, id_col, text_col).dropDuplicates(["doc_id", "text_hash"]), "inner")


def op11(docs: DataFrame, target: DataFrame) -> DataFrame:
    return importance(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


#: A feature's CRC runs over its bytes as a column of steps, one for all features at a time; the table follows from the polynomial.
ORACLE = """
WITH RECURSIVE poly(i, c, k) AS (SELECT CAST(range AS BIGINT), CAST(range AS BIGINT), 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM poly WHERE k < 8),
crc(i, c) AS (SELECT i, c FROM poly WHERE k = 8),
w AS (SELECT 'd' AS side, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x{00}-\\x{2F}\\x{3A}-\\x{60}\\x{7B}-\\x{7F}]+'), lambda x: x <> '') AS ws FROM documents
  UNION ALL SELECT 'b', NULL, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x{00}-\\x{2F}\\x{3A}-\\x{60}\\x{7B}-\\x{7F}]+'), lambda x: x <> '') FROM benchmark),
f AS (SELECT side, doc_id, unnest(ws) AS f FROM w UNION ALL SELECT side, doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w),
u AS (SELECT DISTINCT f, hex(encode(f)) AS h FROM f),
run(f, h, c, p) AS (SELECT f, h, 4294967295::BIGINT, 0 FROM u
  UNION ALL SELECT r.f, r.h, xor(r.c >> 8, t.c), p + 1 FROM run r JOIN crc t ON t.i = xor(r.c & 255, CAST('0x' || substr(r.h, 2 * p + 1, 2) AS BIGINT)) WHERE 2 * p < length(r.h)),
hashed AS (SELECT f, xor(c, 4294967295) % 10000 AS bucket FROM run WHERE 2 * p = length(h)),
fb AS (SELECT side, doc_id, bucket FROM f JOIN hashed USING (f)),
n AS (SELECT count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM fb),
g AS (SELECT bucket, CAST(floor(1000 * ln((b + 1)::DOUBLE * (n.s + 10000)::DOUBLE / ((d + 1)::DOUBLE * (n.t + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT bucket, count(*) FILTER (side = 'd') AS d, count(*) FILTER (side = 'b') AS b FROM fb GROUP BY bucket), n),
m AS (SELECT doc_id, count(*) AS n_features, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM fb JOIN g USING (bucket) WHERE side = 'd' GROUP BY doc_id),
sc AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  CAST('0x' || left(sha256('7:' || w.doc_id), 8) AS BIGINT) AS h FROM w LEFT JOIN m USING (doc_id) WHERE side = 'd'),
sd AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM sc),
rk AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_words >= 20) AS of FROM sd)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 25 * of // 100 THEN r END AS rank FROM rk
"""
