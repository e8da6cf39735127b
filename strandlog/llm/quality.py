"""Quality rules as a bitmask ledger: every rule is evaluated once, its failure is one bit beside the
measurements, and policies of any version, as well as ablations, are bit operations on the ledger.

All of it is column expressions in one pass over the texts without a shuffle.

Nulls and edges: a null or empty text has no words, lines or symbols and fails ``few_words``; rows that repeat
are judged each by itself; a null id is carried along; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, span, words

SYMBOLS = "#*$%&|<>"
#: The rules by bit. Thresholds are in whole numbers, so that any engine gives the same answers.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "5 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "short_words": "10 * word_chars < 22 * n_words",
    "long_words": "word_chars > 14 * n_words",
}
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A version of the filter: the rules whose failure rejects a document."""

    version: str
    rules: tuple[str, ...] = field(default=tuple(RULES))

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


POLICIES = {p.version: p for p in (Policy("v1", BASE), Policy("v2", tuple(RULES)))}


def _repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more. Windows are compared by a 64-bit hash within one text."""

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, j: (x["h"] == F.get(s, j + 1)["h"]) | (x["h"] == F.get(s, j - 1)["h"])), lambda x: x["i"])))
        return let(twice, lambda at: F.aggregate(F.transform(at, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - x, F.lit(3)))), F.lit(0).cast("bigint"), lambda s, x: s + x))

    windows = F.transform(span(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i.cast("int")), F.get(w, (i + 1).cast("int")), F.get(w, (i + 2).cast("int"))))
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h)))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` that a caller asks for stay outside; returns (doc_id, measurements...)."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)
    m = F.struct(
        let(words(t), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), _repeat_words(w).alias("n_repeat_words"))).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))).alias("l"),
        F.length(F.regexp_replace(t, SPACE, "")).cast("bigint").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, "[" + SYMBOLS + "]+", ""))).cast("bigint").alias("n_symbols"),
    )
    # inline() makes the measurements a row of their own: rules and policies below read them and never compute them anew
    one = docs.select(F.col(id_col).alias("doc_id"), F.inline(F.array(m)))
    return one.select("doc_id", "w.n_words", "word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements with ``failures`` long: bit k is set if rule k fails."""
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint") for k, rule in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs, id_col, text_col).withColumn("failures", total)


def apply_policy(entries: DataFrame, policy: Policy) -> DataFrame:
    """Adds ``kept``: no rule of the policy failed."""
    return entries.withColumn("kept", F.col("failures").bitwiseAND(F.lit(policy.mask).cast("bigint")) == 0)


def ablations(entries: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents it fails, and documents that only it rejects (kept without it).

    One aggregate over the ledger; the texts are not read again.
    """
    failed = F.col("failures").bitwiseAND(F.lit(policy.mask).cast("bigint"))
    counts = []
    for name in policy.rules:
        bit = 1 << list(RULES).index(name)
        counts += [F.count_if(failed.bitwiseAND(F.lit(bit).cast("bigint")) != 0).alias(f"{name}_failed"), F.count_if(failed == bit).alias(f"{name}_only")]
    one = entries.agg(F.count("*").alias("n_docs"), F.count_if(failed == 0).alias("n_kept"), *counts)
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"{r}_failed").alias("n_failed"), F.col(f"{r}_only").alias("n_only_this")) for r in policy.rules])
    return one.select("n_docs", "n_kept", F.inline(rows))


def op4(docs: DataFrame, policy: Policy = POLICIES["v2"]) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failures."""
    base = Policy("base", BASE).mask
    e = apply_policy(ledger(docs), policy).withColumn("base_failed", F.col("failures").bitwiseAND(F.lit(base).cast("bigint")) != 0)
    return e.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (F.col("kept") & ~F.col("base_failed")).alias("kept"), "failures")


def reject(docs: DataFrame, policy: Policy = POLICIES["v2"]) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their columns as they were. No shuffle: row and ledger stay together."""
    whole = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"))
    kept = op4(whole.select(F.col("_row").alias("doc_id"), F.col("_text").alias("text")), policy).filter("kept")
    return kept.select("doc_id.*")


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM pos),
rep AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM win WHERE n > 1) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
       FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(d.t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(d.t) - length(regexp_replace(d.t, '[{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
        coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d JOIN w USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
f AS (SELECT *, {" + ".join(f"CASE WHEN {r} THEN {1 << k} ELSE 0 END" for k, r in enumerate(RULES.values()))} AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed % 4 > 0 AS base_failed, failed = 0 AS kept, CAST(failed AS BIGINT) AS failures FROM f
"""
