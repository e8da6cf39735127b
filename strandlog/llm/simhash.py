"""SimHash near-duplicates with candidates by the pigeonring principle.

Two fingerprints of four 16-bit segments that differ in at most 3 bits have a segment i from which the differences
of 1, 2, 3 and 4 successive segments, around the ring, are at most 0, 1, 2 and 3. Pairs are found by an equi-join on
the first two segments of such a chain (the first equal, the second with at most one bit turned), pruned by the
third, then checked in full. Copies fall together before that: the join is over distinct fingerprints.

Nulls and edges: a null or empty text has fingerprint zero and links like any other; rows that repeat an id each
get a row; a null id never is a component's id unless it has no other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable
from .components import components
from .copies import keep_first  # noqa: F401 (the pipeline's stage, with parameters of its own)

SHINGLE, BITS, SEED = 3, 3, 42
#: Fingerprints that share a head, from which on it is told apart by the third segment: asking for that costs some 400 rows each.
HOT = 4096
_BLOCK = 1 << 16


def _fingerprints(size: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        def one(text: str | None) -> int:
            w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: both know ASCII only
            if not w:
                return 0
            n = max(1, len(w) - size + 1)
            total = np.zeros(64, np.int64)
            for a in range(0, n, _BLOCK):
                parts = w[a : min(n, a + _BLOCK) + size - 1]
                rows = zip(*(parts[k:] for k in range(size)), strict=False) if len(w) >= size else [w]
                h = np.fromiter((xxh64_intdigest(b" ".join(r), SEED) for r in rows), np.uint64)
                total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
            return int(np.packbits(2 * total > n, bitorder="little").view(np.int64)[0])

        for b in batches:
            texts = b.column(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(texts[i].as_py()) for i in range(len(texts))], pa.int64())], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) for every row."""
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints(shingle), f"doc_id {kind}, fp long")


def _turned(fp: Column, i: int) -> Column:
    """The fingerprint with segment i in the highest bits, then the next ones around the ring."""
    return fp if i == 0 else F.shiftleft(fp, 16 * i).bitwiseOR(F.shiftrightunsigned(fp, 64 - 16 * i))


def _flips(bits: int) -> list[int]:
    """Masks of a segment with up to ``bits`` bits set."""
    return [sum(1 << k for k in c) for n in range(bits + 1) for c in combinations(range(16), n)]


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """(u, v): pairs of distinct fingerprints u < v of ``fps`` (fp, without repeats) that differ in 3 bits or fewer.

    Heads that more than ``hot`` fingerprints share are told apart by their third segment as well: a chain leaves it two
    turned bits, or one if the second segment has one, which are all asked for. So no pair is lost, and no head's
    fingerprints are all held against each other.
    """
    rings = F.array(*[F.struct(F.lit(i).alias("i"), _turned(F.col("fp"), i).alias("ring")) for i in range(4)])
    each = fps.select("fp", F.inline(rings))
    head, third = F.shiftrightunsigned("ring", 32), F.shiftrightunsigned("ring", 16).bitwiseAND(F.lit(0xFFFF).cast("bigint"))
    index = each.select(F.col("fp").alias("v"), F.col("ring").alias("ring_v"), "i", head.alias("head"), third.alias("third"))
    turned = F.explode(F.array(*[F.lit(x) for x in _flips(1)]).cast("array<bigint>"))
    probe = each.select(F.col("fp").alias("u"), F.col("ring").alias("ring_u"), "i", head.alias("own"), third.alias("own_third"), turned.alias("flip"))
    probe = probe.select("u", "ring_u", "i", F.col("own").bitwiseXOR(F.col("flip")).alias("head"), "own_third", (F.col("flip") != 0).alias("turned"))
    differ = F.col("ring_u").bitwiseXOR(F.col("ring_v"))
    chain = (F.col("u") < F.col("v")) & (F.bit_count(F.shiftrightunsigned(differ, 16)) <= 2) & (F.bit_count(differ) <= BITS)

    crowded = durable(index.groupBy("i", "head").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("i", "head"))
    if crowded.isEmpty():
        return probe.join(index, ["i", "head"]).filter(chain).select("u", "v").distinct()
    few = probe.join(crowded, ["i", "head"], "left_anti").join(index, ["i", "head"]).filter(chain).select("u", "v")
    masks = lambda n: F.array(*[F.lit(x) for x in _flips(n)]).cast("array<bigint>")
    asked = probe.join(crowded, ["i", "head"], "left_semi").select("u", "ring_u", "i", "head", "own_third", F.explode(F.when(F.col("turned"), masks(1)).otherwise(masks(2))).alias("flip3"))
    asked = asked.select("u", "ring_u", "i", "head", F.col("own_third").bitwiseXOR(F.col("flip3")).alias("third"))
    many = asked.join(index, ["i", "head", "third"]).filter(chain).select("u", "v")
    return few.unionByName(many).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the least id that its links reach."""
    own = durable(fingerprints(docs, id_col, text_col))
    fps = durable(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = components(links(fps.select("fp")))
    named = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_fp = durable(named.join(ids, "component").select("fp", "component_id"))
    return own.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def op7(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
