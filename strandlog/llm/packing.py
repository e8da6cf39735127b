"""Packing by power-of-two decomposition.

A document of n tokens becomes n div LENGTH pieces of LENGTH tokens and, for each bit of the rest, one piece of that
power of two. Every piece is a sequence of its own, so that no sequence crosses documents and none is padded; equal
lengths fall in one bucket, from which batches of one shape are read.

Nulls and edges: a null or empty text is the end token alone; rows that repeat are each packed; a null id is carried
along; texts of any length are encoded whole; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named

LENGTH, END = 2048, 1
#: So many characters are encoded at once.
TEXT_AT_ONCE = 1 << 22


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_lengths(n: int, length: int = LENGTH) -> list[int]:
    """Lengths whose sum is n: as many whole sequences as fit, then the powers of two of the rest, falling."""
    return [length] * (n // length) + [1 << b for b in range(length.bit_length() - 2, -1, -1) if n % length >> b & 1]


#: Words of Latin letters, perhaps with a full stop or comma: to the tokenizer's rule each is one pre-token, or two with the mark.
WORD = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``starts``, one run after the other."""
    stops = np.cumsum(sizes, dtype=np.int32)
    return np.repeat(starts - stops + sizes, sizes) + np.arange(stops[-1] if len(stops) else 0, dtype=np.int32)


# How the public file cuts and folds texts, as its own JSON has it.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def by_words(t) -> bool:
    """Whether ``t`` cuts texts by the rule that ``word_encoder`` relies on. No text of another rule is encoded word by word."""
    rule = json.loads(t.to_str())
    model = rule["model"]
    plain = model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and not model.get("continuing_subword_prefix")
    # special strings lie in what stands between spaces, and in no word
    apart = all(x.get("special") and not x.get("lstrip") and not x.get("rstrip") and not re.search(r"\s", x["content"]) and not re.match(WORD, x["content"]) for x in rule["added_tokens"])
    return plain and rule["normalizer"] == NORMALIZER and rule["pre_tokenizer"] == PRE_TOKENIZER and apart


def encoder(t, most: int = 100_000):
    """Texts to the bytes of their ids (unsigned, 32 bits, little-endian), as ``t`` gives them for whole texts."""
    if by_words(t):
        return word_encoder(t, most)
    return lambda texts: [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch_fast(texts, add_special_tokens=False)]


def word_encoder(t, most: int = 100_000):
    """As ``encoder``, for tokenizers of which ``by_words`` holds.

    Its rule never joins what a space or line feed separates, so what lies between those is encoded once for all the
    texts of a call. Words that differ in case or in a mark at their end share the encoding: the rule lower-cases, and
    cuts between letters and marks. Lower-case words are the same under its normalisation, so that they go to its
    model ``most`` at once; each ends with the one of its ids that carries the end-of-word mark. Whatever else lies
    between spaces is encoded by ``t`` itself, string by string.
    """
    import pyarrow.compute as pc
    from tokenizers import Tokenizer, pre_tokenizers

    ends = np.zeros(t.get_vocab_size(), bool)
    ends[[i for token, i in t.get_vocab().items() if token.endswith("</w>")]] = True
    bare = Tokenizer(t.model)
    bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    stop, comma = (t.encode(x, add_special_tokens=False).ids[0] for x in ".,")

    def strings(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [np.array(e.ids, "<u4") for e in t.encode_batch_fast(values, add_special_tokens=False)]
        return np.concatenate([*each, np.zeros(0, "<u4")]), np.fromiter(map(len, each), np.int32, len(each))

    def words(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, number of each) of words in lower case."""
        pools, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int32)]
        for i in range(0, len(values), most):
            some = values[i : i + most]
            ids = np.array(bare.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            size = np.diff(np.flatnonzero(ends[ids]), prepend=-1).astype(np.int32)
            if len(size) != len(some):
                ids, size = strings(some)
            pools.append(ids)
            sizes.append(size)
        return np.concatenate(pools), np.concatenate(sizes)

    def encode(texts: list[str]) -> list[bytes]:
        lists = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " "), " ")
        coded = lists.values.dictionary_encode()
        parts, which = coded.dictionary, coded.indices.to_numpy()
        is_word = pc.match_substring_regex(parts, WORD)
        own = parts.filter(is_word)
        mark = np.where(pc.ends_with(own, ".").to_numpy(zero_copy_only=False), stop, np.where(pc.ends_with(own, ",").to_numpy(zero_copy_only=False), comma, -1))
        roots = pc.utf8_lower(pc.utf8_rtrim(own, ".,")).dictionary_encode()
        ids, size = words(roots.dictionary.to_numpy(zero_copy_only=False).tolist())
        other_ids, other_size = strings(parts.filter(pc.invert(is_word)).to_pylist())

        # every part's ids in one pool: the words, each followed by its mark, then the others
        root = roots.indices.to_numpy()
        n = size[root]
        runs = n + (mark >= 0)
        first = np.cumsum(runs, dtype=np.int32) - runs
        pool = np.empty(int(runs.sum()) + len(other_ids), "<u4")
        pool[_places(first, n)] = ids[_places((np.cumsum(size, dtype=np.int32) - size)[root], n)]
        pool[(first + n)[mark >= 0]] = mark[mark >= 0]
        pool[int(runs.sum()) :] = other_ids
        is_word = is_word.to_numpy(zero_copy_only=False)
        starts, sizes = np.empty(len(parts), np.int32), np.empty(len(parts), np.int32)
        starts[is_word], sizes[is_word] = first, runs
        starts[~is_word], sizes[~is_word] = int(runs.sum()) + np.cumsum(other_size, dtype=np.int32) - other_size, other_size

        n = sizes[which]
        raw = pool[_places(starts[which], n)].tobytes()
        at = (4 * np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[lists.offsets.to_numpy()]).tolist()
        return [raw[i:j] for i, j in zip(at, at[1:], strict=False)]

    return encode


def _pieces(path: str | None, length: int, end: int, digest: bool, special_as_text: bool):
    def run(batches: Iterator) -> Iterator:
        import os
        import zlib

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path or tokenizer_path())
        t.encode_special_tokens = special_as_text

        encode, last = encoder(t), end.to_bytes(4, "little")

        def groups(b) -> Iterator[tuple[int, list[str]]]:
            """Few texts at once, so that memory does not grow with the batch."""
            first, texts, size = 0, [], 0
            for i in range(b.num_rows):
                x = b.column(1)[i].as_py() or ""
                texts.append(x)
                size += len(x)
                if size > TEXT_AT_ONCE:
                    yield first, texts
                    first, texts, size = i + 1, [], 0
            if texts:
                yield first, texts

        for b in batches:
            for first, texts in groups(b):
                rows, starts, sizes, totals, content = [], [], [], [], []
                for k, e in enumerate(encode(texts)):
                    ids = np.frombuffer(e + last, "<u4")
                    at = 0
                    for n in piece_lengths(len(ids), length):
                        rows.append(first + k)
                        starts.append(at)
                        sizes.append(n)
                        totals.append(len(ids))
                        content.append(zlib.crc32(ids[at : at + n]) if digest else ids[at : at + n].astype(np.int32))
                        at += n
                kind = pa.int64() if digest else pa.list_(pa.int32())
                pa.default_memory_pool().release_unused()  # workers live on between tasks
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(content, kind), pa.array(totals, pa.int64())], ["doc_id", "start", "length", "content", "doc_tokens"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, length: int = LENGTH, end: int = END, digest: bool = False, special_as_text: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (array<int>; with ``digest`` their CRC-32 instead), doc_tokens,
    sequence_id, offset, bucket. ``path``: the tokenizer's file, by default the public one. ``special_as_text``: whether
    the strings of its special tokens are text like any other; else they become those tokens' ids, as the tokenizer has it."""
    kind = dict(docs.dtypes)[id_col]
    content = "bigint" if digest else "array<int>"
    p = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text")).mapInArrow(_pieces(path, length, end, digest, special_as_text), f"doc_id {kind}, start long, length long, content {content}, doc_tokens long")
    # a piece is a sequence: its id is its place in the task's output, which is the same whenever the task runs again
    return p.select("doc_id", "start", "length", F.col("content").alias("ids_crc32" if digest else "ids"), "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), F.log2("length").cast("int").alias("bucket"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Writes the pieces by bucket. Tasks write what they hold into each bucket, so that no bucket meets in one task."""
    pieces.write.partitionBy("bucket").parquet(path)


def op1(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket."""
    return pack(docs, digest=True)
