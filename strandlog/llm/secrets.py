"""Secret scans over a trigram inverted index.

Each rule's regular expression gives a Boolean query over trigrams that any match must contain. The index holds,
for every trigram that some rule asks for, the documents that contain it; intersecting its postings gives each
rule's candidates, which alone are verified with the expression, each where its text is. Rules whose expression
forces no trigram scan every document. Postings and candidates carry hashes of texts; no text is shuffled.

Nulls and edges: a null text is empty; a null id is carried along; rows that repeat are each reported; equal ids with other
texts keep apart; offsets count code points and are exact for texts of any length; an empty table gives no rows; other columns
are not read, whatever their names.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, let, prefix_sums, with_row_key

_C, _P = re._constants, re._parser  # the standard library's own parser of expressions
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """kind: name in the results. pattern: what is found, leftmost and without overlaps. A match counts if ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The rules asked for come first, in this order; the others follow.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    Rule("pay_key", r"sk_live_[A-Za-z0-9]{16,}", 0, 0),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}", 0, 0),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
)

Dnf = list[frozenset[str]]  # any of these sets of trigrams, each as a whole; [frozenset()] is always true


def _simplest(d: Dnf) -> Dnf:
    return [a for a in dict.fromkeys(d) if not any(b < a for b in d)]


def _both(a: Dnf, b: Dnf) -> Dnf:
    return _simplest([x | y for x, y in itertools.product(a, b)])


def _of_strings(strings: set[str]) -> Dnf:
    return _simplest([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings)])


def _strings(op, arg) -> set[str] | None:
    """All the strings that one node matches, if they are few."""
    if op is _C.LITERAL:
        return {chr(arg).lower()}
    if op is _C.IN:
        found: set[str] = set()
        for o, a in arg:
            if o is _C.LITERAL:
                found.add(chr(a).lower())
            elif o is _C.RANGE and a[1] - a[0] < 8:
                found |= {chr(x).lower() for x in range(a[0], a[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if op in (_C.MAX_REPEAT, _C.MIN_REPEAT):
        least, most, sub = arg
        if least == most == 1 or (least, most) == (0, 1):
            inner = _exact(sub)
            return None if inner is None else inner | ({""} if not least else set())
        return None
    if op is _C.SUBPATTERN:
        return _exact(arg[-1])
    if op is _C.BRANCH:
        parts = [_exact(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    return None


def _exact(nodes) -> set[str] | None:
    out = {""}
    for op, arg in nodes:
        s = _strings(op, arg)
        if s is None or len(out) * len(s) > MOST_STRINGS:
            return None
        out = {a + b for a, b in itertools.product(out, s)}
    return out


def _needs(nodes) -> Dnf:
    """Runs of nodes with few strings give the trigrams of those strings; other nodes what lies in them."""
    query, run = [frozenset()], {""}
    for op, arg in nodes:
        s = _strings(op, arg)
        if s is not None and len(run) * len(s) <= MOST_STRINGS:
            run = {a + b for a, b in itertools.product(run, s)}
            continue
        query, run = _both(query, _of_strings(run)), {""} if s is None else s
        if op is _C.SUBPATTERN:
            query = _both(query, _needs(arg[-1]))
        elif op is _C.BRANCH:
            query = _both(query, _simplest([y for x in arg[1] for y in _needs(x)]))
        elif op in (_C.MAX_REPEAT, _C.MIN_REPEAT) and arg[0] > 0:
            query = _both(query, _needs(arg[2]))
    return _both(query, _of_strings(run))


def trigram_query(pattern: str) -> Dnf:
    """Sets of lower-case trigrams; every match's text, lower-cased, holds all of at least one set."""
    return _needs(_P.parse(pattern))


WORD_BITS = 62


class Index:
    """Numbers the trigrams that rules ask for; postings carry the numbers as bits of a few longs."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.queries = {r.kind: trigram_query(r.pattern) for r in rules}
        self.asked = {k: q for k, q in self.queries.items() if all(q)}  # the others force no trigram
        self.trigrams = sorted(set().union(*(c for q in self.asked.values() for c in q)))
        self.n_words = -(-len(self.trigrams) // WORD_BITS)

    def postings(self, keyed: DataFrame) -> DataFrame:
        """(doc_id, text_hash, trigram): one row for each asked trigram of each document."""
        found = let(F.lower("text"), lambda t: F.filter(F.transform(F.array(*map(F.lit, self.trigrams)), lambda g, i: F.struct(g.alias("g"), i.alias("i"))), lambda g: F.contains(t, g["g"])))
        return keyed.select("doc_id", "text_hash", F.inline(found).alias("trigram", "number"))

    def candidates(self, postings: DataFrame) -> DataFrame:
        """(doc_id, text_hash, rules): the kinds whose query the document's postings satisfy."""
        bit = F.expr(f"shiftleft(1L, number % {WORD_BITS})")
        sets = postings.groupBy("doc_id", "text_hash").agg(*[F.bit_or(F.when(F.expr(f"number div {WORD_BITS}") == k, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"_w{k}") for k in range(self.n_words)])

        def holds(clause: frozenset[str]) -> Column:
            masks = [0] * self.n_words
            for g in clause:
                n = self.trigrams.index(g)
                masks[n // WORD_BITS] |= 1 << n % WORD_BITS
            return reduce(lambda a, b: a & b, [F.col(f"_w{k}").bitwiseAND(F.lit(m).cast("bigint")) == m for k, m in enumerate(masks) if m])

        kinds = F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, map(holds, q)), F.lit(k)) for k, q in self.asked.items()]))
        return sets.select("doc_id", "text_hash", kinds.alias("rules")).filter(F.size("rules") > 0)


def _found(rule: Rule, order: int, text: Column) -> Column:
    """array<struct<start, order, kind, end>> of the rule's matches; starts are sums of the lengths of what lies before."""
    java = rule.pattern.replace("\\x20", " ")

    def spans(matches: Column) -> Column:
        gaps = F.transform(F.split(text, java, -1), lambda g: F.length(g).cast("bigint"))
        sizes = F.transform(matches, lambda m: F.length(m).cast("bigint"))
        kept_by = F.transform(F.regexp_extract_all(text, F.lit(java), F.lit(rule.group)), lambda g: F.length(g)) if rule.group else sizes

        def place(g: Column, s: Column, k: Column) -> Column:
            before = prefix_sums(F.transform(s, lambda x, i: x + F.get(g, i)))
            at = let(before, lambda b: F.transform(s, lambda x, i: F.struct((F.get(b, i) + F.get(g, i)).alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), (F.get(b, i) + F.get(g, i) + x).alias("end"))))
            return F.filter(at, lambda _, i: F.get(k, i) >= rule.least)

        return let(gaps, lambda g: let(sizes, lambda s: let(kept_by, lambda k: place(g, s, k))))

    none = F.expr("cast(array() as array<struct<start:bigint,order:int,kind:string,end:bigint>>)")
    return let(F.regexp_extract_all(text, F.lit(java), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(spans(m)))


#: Bits for each candidate, and bits at least and at most; beyond, more texts are verified, none less.
BITS_EACH, BITS = 16, (1 << 12, 1 << 24)


def _candidate_test(candidates: DataFrame) -> Callable[[str], Column]:
    """For a kind, whether a row (text_hash) may be its candidate: looked up in a bitmap, so that texts are verified where
    they are and none is shuffled. What the bitmap lets through by chance is verified as well, and matches nothing."""
    place = lambda kind, size: F.pmod(F.xxhash64("text_hash", kind), F.lit(size).cast("bigint"))
    each = durable(candidates.select("text_hash", F.explode("rules").alias("kind")).distinct())
    size = min(max(BITS[0], 1 << (each.count() * BITS_EACH).bit_length()), BITS[1])
    bit = F.expr("shiftleft(1L, cast(pmod(p, 64) as int))")
    found = each.select(place(F.col("kind"), size).alias("p")).groupBy(F.expr("p div 64").alias("n")).agg(F.bit_or(bit).alias("bits")).collect()  # size / 64 rows at most
    longs = [0] * (size // 64)
    for r in found:
        longs[r["n"]] = r["bits"]
    bits = F.split(F.lit(",".join(map(str, longs))), ",").cast("array<bigint>")
    return lambda kind: F.getbit(F.get(bits, (place(F.lit(kind), size) / 64).cast("int")), F.pmod(place(F.lit(kind), size), F.lit(64).cast("bigint")).cast("int")) == 1


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans: array<struct<start, order, kind, end>>) for every row, spans by start, then by the rules' order."""
    index, keyed = Index(rules), with_row_key(docs, id_col, text_col)
    candidate = _candidate_test(index.candidates(index.postings(keyed)))
    none = F.expr("cast(array() as array<struct<start:bigint,order:int,kind:string,end:bigint>>)")
    each = [F.when(candidate(r.kind), _found(r, k, F.col("text"))).otherwise(none) if r.kind in index.asked else _found(r, k, F.col("text")) for k, r in enumerate(rules)]
    return keyed.select("doc_id", F.inline(F.array(F.struct(F.sort_array(F.concat(*each)).alias("spans")))))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    n = len(BASE_RULES)

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["order"] == k)).cast("bigint")

    counts = [count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)]
    return scan(docs).select("doc_id", *counts, F.sha2(_listed(F.filter("spans", lambda s: s["order"] < n)), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _sql(rule: Rule, order: int) -> str:
    p = rule.pattern.replace("'", "''").replace("(?i)", "")
    flags = ", 'i'" if "(?i)" in rule.pattern else ""
    return f"""SELECT doc_id, kind, ord, start, start + len(m) AS stop FROM (
      SELECT doc_id, '{rule.kind}' AS kind, {order} AS ord, ms[i] AS m, gs[i] AS g, list_sum(list_transform(ps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0) AS start
      FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{p}', 0{flags}) AS ms, regexp_extract_all(t, '{p}', {rule.group}{flags}) AS gs, regexp_split_to_array(t, '{p}'{flags}) AS ps FROM d))
      ) WHERE len(g) >= {rule.least}"""


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_sql(r, k) for k, r in enumerate(BASE_RULES + MORE_RULES))}),
x AS (SELECT doc_id, ord, start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS v FROM s),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE ord = {k}) AS n_{r.kind}" for k, r in enumerate(BASE_RULES))},
        coalesce(string_agg(v, ',' ORDER BY start, ord) FILTER (WHERE ord < {len(BASE_RULES)}), '') AS base, string_agg(v, ',' ORDER BY start, ord) AS spans FROM x GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""
