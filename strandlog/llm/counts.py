"""Edit-aware token counts.

A document's pre-tokens lie in the leaves of a segment tree, which sums up their characters and tokens. An edit is
found by descending through the sums; only the leaves it touches, with enough before it that their cut could not
depend on it, are cut and encoded anew, up to the first old boundary behind it; sums above them are updated, and a leaf
that has grown too large is split where it stands.

``plant`` keeps the trees as a table, a row for each leaf, and ``apply_edits`` makes its next version: it finds places by
the sums alone and reads the pre-tokens of leaves at an edit and beside it; all other leaves are carried over as they are.

Nulls and edges: a null text is empty; null or no edits leave the counts as they are; an edit beyond the text's end
applies at the end, a null insertion inserts nothing; rows that repeat are each counted (in the table of trees rows
that repeat id and text are one tree, and an edit applies to all trees of its id); a null id is carried along; an empty
table gives no rows. The text is never re-encoded as a whole after the tree is built.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, stored

#: Pre-tokens of a leaf when the tree is built, and at most before it is split.
LEAF, FULL = 64, 256
#: What stays remembered of pre-tokens' counts, in entries.
MOST = 500_000


class Counter:
    """Counts tokens of pre-tokens by a public byte-level vocabulary, remembering them."""

    def __init__(self, path: str, pattern: str):
        import base64

        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut: Callable[[str], list[str]] = regex.compile(pattern).findall
        self._known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known = self._known
        new = set(pieces).difference(known)
        if new:
            if len(known) + len(new) > MOST:
                known.clear()
                new = set(pieces)
            one = self._encoding.encode_ordinary
            known.update((p, len(one(p))) for p in new)
        return list(map(known.__getitem__, pieces))


class Missing(Exception):
    """An edit needs a leaf whose pre-tokens were not read."""


class Node:
    """A leaf with its number in the table and its pre-tokens (None: not read), or a node above others."""

    __slots__ = ("changed", "chars", "children", "number", "pieces", "tokens")

    def __init__(self, chars: int, tokens: int, pieces: list[str] | None = None, children: list[Node] | None = None, number: int | None = None):
        self.chars, self.tokens, self.pieces, self.children, self.number, self.changed = chars, tokens, pieces, children, number, False

    def text(self) -> list[str]:
        if self.pieces is None:
            if self.chars:
                raise Missing
            return []
        return self.pieces


def _above(children: list[Node]) -> Node:
    return Node(sum(x.chars for x in children), sum(x.tokens for x in children), children=children)


#: Children of a node when the tree is built, and at most before it is split.
FEW, MANY = 8, 16


class Tree:
    """Leaves of pre-tokens below levels of sums."""

    def __init__(self, text: str, counter: Counter, leaves: list[Node] | None = None):
        """Of a text, or of the ``leaves`` of one."""
        self.counter = counter
        self.encoded = 0
        self._build(self._leaves(text) if leaves is None else leaves)

    def _leaves(self, text: str) -> list[Node]:
        self.encoded += len(text)
        return self._of(self.counter.cut(text))

    def _of(self, pieces: list[str]) -> list[Node]:
        counts = self.counter.counts(pieces)
        return [Node(sum(map(len, p)), sum(counts[i : i + LEAF]), p) for i in range(0, len(pieces), LEAF) for p in [pieces[i : i + LEAF]]]

    def _build(self, level: list[Node]) -> None:
        while len(level) > FEW:
            level = [_above(level[i : i + FEW]) for i in range(0, len(level), FEW)]
        self.root = _above(level)

    @property
    def tokens(self) -> int:
        return self.root.tokens

    @property
    def chars(self) -> int:
        return self.root.chars

    def leaves(self) -> Iterator[Node]:
        below = [self.root]
        while below:
            node = below.pop()
            if node.children is None:
                yield node
            else:
                below.extend(reversed(node.children))

    def _path(self, at: int) -> tuple[list[tuple[Node, int]], int]:
        """(node, child's number) from the root down to the leaf that holds the character before ``at`` or at it, and the leaf's start."""
        path, node, start = [], self.root, 0
        while node.children:
            for i, child in enumerate(node.children):
                if start + child.chars >= at or i == len(node.children) - 1:
                    break
                start += child.chars
            path.append((node, i))
            node = child
        return path, start

    def _next(self, path: list[tuple[Node, int]], step: int) -> list[tuple[Node, int]] | None:
        """The path of the leaf before (-1) or after (1), or None."""
        path = list(path)
        while path and not 0 <= path[-1][1] + step < len(path[-1][0].children):
            path.pop()
        if not path:
            return None
        node, i = path.pop()
        path.append((node, i + step))
        node = node.children[i + step]
        while node.children:
            i = 0 if step > 0 else len(node.children) - 1
            path.append((node, i))
            node = node.children[i]
        return path

    @staticmethod
    def _leaf(path: list[tuple[Node, int]]) -> Node:
        node, i = path[-1]
        return node.children[i]

    def edit(self, at: int, removed: int, inserted: str) -> int:
        """Replaces ``removed`` characters at ``at``; returns the characters encoded anew."""
        before = self.encoded
        at = max(0, min(at, self.chars))
        removed = max(0, min(removed, self.chars - at))
        if not self.root.children:
            self._build(self._leaves(inserted))
            for leaf in self.leaves():
                leaf.changed = True
            return self.encoded - before
        path, start = self._path(at)
        touched = [path]
        text = "".join(self._leaf(path).text())
        # back to a boundary that two words, whole and unchanged, part from the edit
        while len(text[: at - start].split()) < 3 and (p := self._next(touched[0], -1)):
            touched.insert(0, p)
            head = "".join(self._leaf(p).text())
            start, text = start - len(head), head + text
        pieces = [x for p in touched for x in self._leaf(p).text()]
        ends = list(accumulate(map(len, pieces)))
        keep = 0  # pre-tokens before the edit by two words or more stay as they are
        safe = text[: at - start].split()
        if len(safe) >= 3:
            limit = len(text[: at - start].rstrip()[: -len(safe[-1])].rstrip()) - len(safe[-2])
            keep = bisect_right(ends, limit)
        lead = ends[keep - 1] if keep else 0
        while len(text) < at - start + removed and (p := self._next(touched[-1], 1)):
            touched.append(p)
            text += "".join(self._leaf(p).text())
        old = [x for p in touched for x in self._leaf(p).text()]
        grown = text[lead : at - start] + inserted
        changed = len(grown)
        grown += text[at - start + removed :]
        while True:
            new = self.counter.cut(grown)
            bounds = set(accumulate(map(len, old), initial=0))  # in the old text, from ``start``
            shift = lead + removed - len(inserted)
            place, meet = 0, -1
            for n, piece in enumerate(new):
                if place >= changed and place + shift in bounds and place < len(grown):
                    meet = n
                    break
                place += len(piece)
            p = None if meet >= 0 else self._next(touched[-1], 1)
            if meet >= 0 or p is None:
                break
            touched.append(p)
            tail = self._leaf(p).text()
            old, grown = old + tail, grown + "".join(tail)
        if meet >= 0:
            old_ends = list(accumulate(map(len, old), initial=0))
            rest = old[old_ends.index(place + shift) :]
            fresh = new[:meet]
        else:
            rest, fresh = [], new
        self.encoded += sum(map(len, fresh))
        self._replace(touched, old[:keep] + fresh + rest)
        return self.encoded - before

    def _replace(self, touched: list, pieces: list[str]) -> None:
        """The first touched leaf takes the pieces, the others become empty; sums change along the paths."""
        for n, path in enumerate(touched):
            leaf = self._leaf(path)
            own = pieces if n == 0 else []
            chars, tokens = sum(map(len, own)), sum(self.counter.counts(own))
            dc, dn = chars - leaf.chars, tokens - leaf.tokens
            leaf.chars, leaf.tokens, leaf.pieces, leaf.changed = chars, tokens, own, True
            for node, _ in path:
                node.chars += dc
                node.tokens += dn
        if len(pieces) > FULL:
            self._split(touched[0], pieces)

    def _split(self, path: list[tuple[Node, int]], pieces: list[str]) -> None:
        """Puts several leaves where one was, and splits the nodes above that then have too many; nothing else is touched."""
        fresh = self._of(pieces)
        fresh[0].number = self._leaf(path).number
        for leaf in fresh:
            leaf.changed = True
        for node, i in reversed(path):
            node.children[i : i + 1] = fresh
            if len(node.children) <= MANY:
                return
            fresh = [_above(node.children[k : k + FEW]) for k in range(0, len(node.children), FEW)]
        self._build(fresh)


def _count(path: str | None, pattern: str | None):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = _counter(path, pattern)
        for b in batches:
            rows = []
            for x, edits in zip(b.column(1), b.column(2), strict=True):
                tree = Tree(x.as_py() or "", counter)
                before, built, n = tree.tokens, tree.encoded, 0
                for e in edits.as_py() or []:
                    tree.edit(e["start"] or 0, e["removed"] or 0, e["inserted"] or "")
                    n += 1
                rows.append((before, tree.tokens, tree.chars, n, tree.encoded - built))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "n_tokens", "n_tokens_edited", "n_chars_edited", "n_edits", "n_chars_encoded"])

    return run


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens before the edits, n_tokens_edited, n_chars_edited, n_edits, n_chars_encoded (anew, for the edits).

    ``edits_col``: array<struct<start, removed, inserted>>, applied in order, places in code points of the text as it
    then is. ``path`` and ``pattern``: the vocabulary's file and its rule for pre-tokens, by default the public ones.
    """
    kind = dict(docs.dtypes)[id_col]
    one = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(edits_col).alias("edits"))
    return one.mapInArrow(_count(path, pattern), f"doc_id {kind}, n_tokens long, n_tokens_edited long, n_chars_edited long, n_edits long, n_chars_encoded long")


def with_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with a column ``edits`` (replaced if there is one) from a table (doc_id, seq, start, removed, inserted): a
    document's edits by seq, null where it has none."""
    lists = edits.groupBy(F.col(id_col).alias("id")).agg(F.sort_array(F.collect_list(F.struct("seq", "start", "removed", "inserted"))).alias("listed"))
    whole = docs.select(F.struct("*").alias("row"))
    plain = F.transform("listed", lambda e: F.struct(e["start"].alias("start"), e["removed"].alias("removed"), e["inserted"].alias("inserted")))
    return whole.join(lists, F.col("row")[id_col] == F.col("id"), "left").select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "edits"], plain.alias("edits"))


#: Numbers of a tree's leaves when it is planted: between them there is room for those of leaves that are split.
SPACING = 1 << 24
_TREES = "doc_id {kind}, planted long, leaf long, pieces array<string>, n_chars long, n_tokens long"
_KEY = ["doc_id", "planted"]


def _counter(path: str | None, pattern: str | None) -> Counter:
    import public_tokenizers

    return Counter(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)


def _record(ids, planted: list[int], leaves: list[Node], extra: dict | None = None):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({
        "doc_id": ids, "planted": pa.array(planted, pa.int64()), "leaf": pa.array([x.number for x in leaves], pa.int64()), "pieces": pa.array([x.pieces for x in leaves], pa.list_(pa.string())),
        "n_chars": pa.array([x.chars for x in leaves], pa.int64()), "n_tokens": pa.array([x.tokens for x in leaves], pa.int64()), **(extra or {}),
    })


def plant(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The trees of all documents, to be kept as a table: (doc_id, planted, leaf, pieces, n_chars, n_tokens), a row for each
    leaf, in the order of ``leaf``. ``planted`` tells apart rows that repeat an id with another text."""
    kind = dict(docs.dtypes)[id_col]
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("planted"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = _counter(path, pattern)
        for b in batches:
            for i, (p, text) in enumerate(zip(b.column(1).to_pylist(), b.column(2), strict=True)):
                leaves = list(Tree(text.as_py(), counter).leaves()) or [Node(0, 0, [])]  # an empty text is a leaf without pieces
                for k, leaf in enumerate(leaves):
                    leaf.number = (k + 1) * SPACING
                yield _record(b.column(0).take(pa.array([i] * len(leaves))), [p] * len(leaves), leaves)

    if not d.groupBy(*_KEY).count().filter("count > 1").isEmpty():
        d = d.dropDuplicates(_KEY)
    return d.mapInArrow(run, _TREES.format(kind=kind))


def tree_counts(trees: DataFrame) -> DataFrame:
    """(doc_id, planted, n_tokens, n_chars): the roots' sums; no text is read."""
    return trees.groupBy(*_KEY).agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_chars").alias("n_chars"))


def _asked(batches: Iterator) -> Iterator:
    """(doc_id, planted, leaf) of the leaves at each edit and one beside it on either side, by the sums alone."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        rows, planted, found = [], [], []
        for i, (p, sums, edits) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
            chars, wanted = np.array([x["n_chars"] for x in sums], np.int64), set()
            for e in edits:
                ends = np.cumsum(chars)
                at = max(0, min(e["start"] or 0, int(ends[-1])))
                gone = max(0, min(e["removed"] or 0, int(ends[-1]) - at))
                first = min(int(np.searchsorted(ends, at)), len(ends) - 1)
                last = min(int(np.searchsorted(ends, at + gone)), len(ends) - 1)
                wanted.update(range(max(0, first - 1), min(len(ends), last + 2)))
                starts = ends - chars
                chars = chars - np.maximum(0, np.minimum(ends, at + gone) - np.maximum(starts, at))
                chars[first] += len(e["inserted"] or "")
            rows += [i] * len(wanted)
            planted += [p] * len(wanted)
            found += [sums[k]["leaf"] for k in sorted(wanted)]
        yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).take(pa.array(rows, pa.int64())), "planted": pa.array(planted, pa.int64()), "leaf": pa.array(found, pa.int64())})


def _edited(path: str | None, pattern: str | None):
    """Batches of (doc_id, planted, sums, edits, read) to changed leaves; number null: the tree needs leaves that were not read."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = _counter(path, pattern)
        for b in batches:
            for i, (p, sums, edits, read) in enumerate(zip(*(b.column(c).to_pylist() for c in (1, 2, 3, 4)), strict=True)):
                texts = {x["leaf"]: x["pieces"] for x in read or []}
                tree = Tree("", counter, [Node(x["n_chars"], x["n_tokens"], texts.get(x["leaf"]), number=x["leaf"]) for x in sums])
                try:
                    for e in edits:
                        tree.edit(e["start"] or 0, e["removed"] or 0, e["inserted"] or "")
                    leaves = list(tree.leaves())
                    _renumber(leaves)
                    changed = [x for x in leaves if x.changed]
                except Missing:
                    changed = [Node(0, 0)]
                yield _record(b.column(0).take(pa.array([i] * len(changed), pa.int64())), [p] * len(changed), changed, {"n_encoded": pa.array([tree.encoded] * len(changed), pa.int64())})

    return run


def _renumber(leaves: list[Node]) -> None:
    """Numbers for new leaves between those of their neighbours; where there is no room left, pieces join the leaf before."""
    last = 0
    for k, leaf in enumerate(leaves):
        if leaf.number is None:
            new = next((i for i in range(k, len(leaves)) if leaves[i].number is not None), len(leaves))
            end = leaves[new].number if new < len(leaves) else last + (new - k + 1) * SPACING
            step = (end - last) // (new - k + 1)
            if step:
                leaf.number = last + step
            else:
                before = leaves[k - 1]
                before.pieces, before.chars, before.tokens, before.changed = before.text() + leaf.pieces, before.chars + leaf.chars, before.tokens + leaf.tokens, True
                leaf.pieces, leaf.chars, leaf.tokens, leaf.changed, leaf.number = [], 0, 0, False, before.number
        last = leaf.number


def apply_edits(trees: DataFrame, edits: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The trees after ``edits`` (doc_id, seq, start, removed, inserted), applied by seq; the columns of ``plant``.

    Places are found by the sums; pre-tokens are read of the leaves at edits and beside them only, and of all leaves of a
    document only if an edit's cut runs on beyond those. All other leaves are carried over without being read by Python.
    """
    kind = dict(trees.dtypes)["doc_id"]
    lists = edits.filter("doc_id is not null").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "start", "removed", "inserted"))).alias("edits"))
    sums = trees.groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("leaf", "n_chars", "n_tokens"))).alias("sums")).join(lists, "doc_id")
    sums = durable(sums.select(*_KEY, "sums", "edits"))
    shape = _TREES.format(kind=kind) + ", n_encoded long"

    def edited(some: DataFrame, leaves: DataFrame) -> DataFrame:
        read = leaves.groupBy(*_KEY).agg(F.collect_list(F.struct("leaf", "pieces")).alias("read"))
        return stored(some.join(read, _KEY, "left").select(*_KEY, "sums", "edits", "read").mapInArrow(_edited(path, pattern), shape))

    wanted = sums.mapInArrow(_asked, f"doc_id {kind}, planted long, leaf long")
    changed = edited(sums, trees.join(wanted, [*_KEY, "leaf"], "left_semi"))
    again = changed.filter("leaf is null").select(*_KEY)
    rest = edited(sums.join(again, _KEY, "left_semi"), trees.join(again, _KEY, "left_semi"))
    new = changed.filter("leaf is not null").unionByName(rest)
    kept = trees.join(new.select(*_KEY, "leaf"), [*_KEY, "leaf"], "left_anti")
    return kept.unionByName(new.drop("n_encoded"))


def op10(docs: DataFrame) -> DataFrame:
    """Counts of every document before and after three edits that follow from its length: words put in a third of the
    way, ten characters taken out at two thirds, and a line added to the end."""
    n = F.coalesce(F.length("text"), F.lit(0)).cast("bigint")
    edit = lambda at, removed, inserted: F.struct(at.cast("bigint").alias("start"), F.lit(removed).cast("bigint").alias("removed"), F.lit(inserted).alias("inserted"))
    edits = F.array(edit(F.floor(n / 3), 0, " put in, it's new "), edit(F.floor(2 * n / 3), 10, ""), edit(n + 8, 0, "\nThe end."))
    return count_tokens(docs.select("doc_id", "text").withColumn("edits", edits))
