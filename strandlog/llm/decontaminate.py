"""Benchmark decontamination by winnowing.

From every window of ``WINDOW - K + 1`` successive k-grams of words the least hash is kept, so that two texts that
share ``WINDOW`` words share a fingerprint. Items shorter than ``WINDOW`` are windows of their own length, for which
winnowing promises nothing: of these every place of a document is hashed. A document's fingerprints are first held
against a bitmap of the benchmark's; each that it lets through is extended to all windows of ``WINDOW`` words that hold
it, and these are joined with the items' windows word by word. So documents are read once and their texts never shuffled.

Nulls and edges: a null text has no words; an item without words is no window; rows that repeat are judged each by
itself; items that repeat an id count once; an empty table of documents gives no rows, an empty benchmark no hits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, durable, let, on_row_key, span, with_row_key, words

#: What separates words: all of ASCII but digits and letters, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, K = 10, 5
#: The benchmark's side of a join is broadcast up to so many rows of some 100 bytes; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000
#: Bits of the bitmap: fixed, whatever the benchmark's size; a larger benchmark lets more through to the join, no less.
BITS = 1 << 20


def _folded(text: str) -> Column:
    """Lower-cases letter by letter, and so alike in a document and in a window of it; of all letters only the capital sigma
    depends on those around it. Other letters than A-Z can only add hits, which are compared exactly later."""
    return F.lower(F.replace(F.col(text), F.lit("Σ"), F.lit("σ")))


def _winnow(w: Column) -> Column:
    """array<struct<hash, at>>: the chosen k-grams of an array of words.

    A gram's hash and its place modulo 8 share a long, so that the least of a window also tells where it lies.
    """
    n = WINDOW - K + 1  # at most 8
    grams = F.transform(span(F.lit(0), F.size(w) - K), lambda i: F.xxhash64(F.slice(w, (i + 1).cast("int"), K)).bitwiseAND(F.lit(-8).cast("bigint")).bitwiseOR(F.pmod(i, F.lit(8).cast("bigint"))))

    def chosen(g: Column) -> Column:
        least = F.transform(span(F.lit(0), F.size(g) - n), lambda i: F.array_min(F.slice(g, (i + 1).cast("int"), n)))
        return let(least, lambda m: F.filter(F.transform(m, lambda x, i: F.struct(x.alias("v"), i.alias("i"))), lambda x: (x["i"] == 0) | (x["v"] != F.get(m, x["i"] - 1))))

    at = lambda x: (x["i"] + F.pmod(x["v"].bitwiseAND(F.lit(7).cast("bigint")) - x["i"], F.lit(8).cast("bigint"))).cast("bigint")
    return F.transform(let(grams, chosen), lambda x: F.struct(x["v"].bitwiseAND(F.lit(-8).cast("bigint")).alias("hash"), at(x).alias("at")))


def _windows(w: Column, length: Column) -> Column:
    """array<struct<at, gram>>: all runs of ``length`` words, joined by a space."""
    return F.transform(span(F.lit(0), F.size(w) - length), lambda i: F.struct(i.alias("at"), F.array_join(F.slice(w, (i + 1).cast("int"), length.cast("int")), " ").alias("gram")))


def _hint(df: DataFrame) -> DataFrame:
    """Broadcasts a side that has been counted and found small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _item_grams(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, size, gram): each item's windows."""
    one = benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.inline(F.array(F.struct(words(ascii_lower(F.col(text_col)), BETWEEN).alias("w"))))).filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(WINDOW))
    return one.select("item_id", size.alias("size"), F.inline(_windows(F.col("w"), size))).select("item_id", "size", "gram").distinct()


def _places(hashed: Column) -> Column:
    """Where in the bitmap a fingerprint stands; the low bits of one are its place in the text."""
    return F.pmod(F.shiftrightunsigned(hashed, 3), F.lit(BITS).cast("bigint"))


def _short(size: int) -> Callable[[Column], Column]:
    """Of an array of words array<struct<hash, at>>: all runs of ``size`` words."""
    return lambda w: F.transform(span(F.lit(0), F.size(w) - size), lambda i: F.struct(F.xxhash64(F.slice(w, (i + 1).cast("int"), size)).alias("hash"), i.alias("at")))


def _bitmap(grams: DataFrame, sizes: list[int]) -> Column:
    """The bitmap of the items' fingerprints as an array of BITS / 64 longs, a literal of the plan."""
    full = grams.filter(F.col("size") == WINDOW).select(F.inline(let(words(_folded("gram"), BETWEEN), _winnow))).select("hash")
    for n in sizes:
        full = full.unionByName(grams.filter(F.col("size") == n).select(F.inline(let(words(_folded("gram"), BETWEEN), _short(n)))).select("hash"))
    bit = F.expr("shiftleft(1L, cast(pmod(p, 64) as int))")
    found = full.select(_places(F.col("hash")).alias("p")).groupBy((F.col("p") / 64).cast("bigint").alias("n")).agg(F.bit_or(bit).alias("bits")).collect()  # BITS / 64 rows at most
    longs = [0] * (BITS // 64)
    for r in found:
        longs[r["n"]] = r["bits"]
    return F.split(F.lit(",".join(map(str, longs))), ",").cast("array<bigint>")


def occurrences(docs: DataFrame, grams: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables. The first has every row of the documents: doc_id, text_hash, n_words. The second, one row for
    each window of each item (item_id, size, gram) that occurs: doc_id, text_hash, at (in words), size, gram, without repeats."""
    sizes = sorted(r["size"] for r in grams.filter(F.col("size") < WINDOW).select("size").distinct().collect())  # nine numbers at most
    bits = _bitmap(grams, sizes)
    # two rows (texts) of one id and hash are one text; each row counts
    keyed = with_row_key(docs, id_col, text_col).select("doc_id", "text_hash", "text", F.inline(F.array(F.struct(words(_folded("text"), BETWEEN).alias("folded")))))
    known = lambda x: F.getbit(F.get(bits, (_places(x["hash"]) / 64).cast("int")), F.pmod(_places(x["hash"]), F.lit(64).cast("bigint")).cast("int")) == 1
    lead = WINDOW - K  # a fingerprint lies in the windows that begin so many words before it or later
    near = lambda x: F.filter(span(x["at"] - lead, x["at"]), lambda i: (i >= 0) & (i <= F.size("folded") - WINDOW))
    full = F.array_distinct(F.flatten(F.transform(F.filter(_winnow(F.col("folded")), known), near)))
    short = [F.transform(F.filter(_short(n)(F.col("folded")), known), lambda x: x["at"]) for n in sizes]
    let_through = keyed.select("doc_id", "text_hash", "text", F.inline(F.array(F.struct(F.size("folded").cast("bigint").alias("n_words"), full.alias("at0"), *[x.alias(f"at{n}") for n, x in zip(sizes, short, strict=True)]))))
    # words as they are compared: only of documents that the bitmap lets through
    any_of = F.size("at0") > 0
    for n in sizes:
        any_of = any_of | (F.size(f"at{n}") > 0)
    w = F.when(any_of, words(ascii_lower(F.col("text")), BETWEEN)).otherwise(F.array().cast("array<string>"))
    one = let_through.select("doc_id", "text_hash", "n_words", "at0", *[f"at{n}" for n in sizes], F.inline(F.array(F.struct(w.alias("w")))))

    def grams_at(places: str, n: int) -> Column:
        return F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(n).alias("size"), F.array_join(F.slice("w", (i + 1).cast("int"), n), " ").alias("gram")))

    windows = [grams_at("at0", WINDOW), *[grams_at(f"at{n}", n) for n in sizes]]
    # every document gives a row of its own, the first, whether or not a window follows
    own = F.struct(F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("int").alias("size"), F.lit(None).cast("string").alias("gram"))
    places = one.select("doc_id", "text_hash", "n_words", F.inline(F.concat(F.array(own), *windows)))
    held = grams.select("size", "gram").distinct().withColumn("held", F.lit(True))
    judged = durable(places.join(_hint(held), ["size", "gram"], "left").filter("held or size is null").select("doc_id", "text_hash", "n_words", "at", "size", "gram"))
    return judged.filter("size is null").select("doc_id", "text_hash", "n_words"), judged.filter("size is not null").select("doc_id", "text_hash", "at", "size", "gram").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row."""
    grams = durable(_item_grams(benchmark, item_col, item_text_col))
    rows, found = occurrences(docs, grams, id_col, text_col)
    # words hit: the union of the intervals, in order of their start
    runs = F.sort_array(F.collect_list(F.struct("at", "size")))
    state = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))
    n_hit = F.aggregate(runs, state, lambda s, x: F.struct(F.greatest(s["end"], x["at"] + x["size"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["at"] + x["size"] - F.greatest(s["end"], x["at"]))).alias("n")))["n"]
    hit = found.groupBy("doc_id", "text_hash").agg(n_hit.alias("n_hit"))
    pairs = found.select("doc_id", "text_hash", "gram").distinct().join(_hint(grams.select("gram", "item_id").distinct()), "gram").select("doc_id", "text_hash", "item_id").distinct()
    items = pairs.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    per_doc = on_row_key(hit, items).select("doc_id", "text_hash", "n_hit", "items")
    zero = F.lit(0).cast("bigint")
    return on_row_key(rows, per_doc).select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce(F.size("items").cast("bigint"), zero).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their columns as they were, in which no item's window occurs."""
    _, found = occurrences(docs, durable(_item_grams(benchmark, "item_id", "text")))
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("hash"))
    bad = _hint(found.select("doc_id", "text_hash").distinct())
    return whole.join(bad, whole["id"].eqNullSafe(bad["doc_id"]) & (whole["hash"] == bad["text_hash"]), "left_anti").select("row.*")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bw),
dw AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bg) WHERE len(w) >= n),
dg AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM dw),
o AS (SELECT doc_id, i, n, item_id FROM dg JOIN bg USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM o) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
