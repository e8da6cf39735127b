"""Toxicity: the automaton against edit distances one by one, contexts, and held-out labels."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from strandlog.llm import toxicity as x

TERMS = [("idiot", False), ("worthless", False), ("scum", False), ("lowei", True), ("gargar", True), ("idol", False)]


def distance(a: str, b: str) -> int:
    """Letters put in, left out, replaced, or neighbours that changed places (no letter edited twice)."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def plain(word: str) -> tuple[int, int] | None:
    """(errors, term) of the best term of a word."""
    out = []
    for t, (term, stem) in enumerate(TERMS):
        e = min(distance(word[:k], term) for k in range(len(word) + 1)) if stem else distance(word, term)
        if e <= x.errors_allowed(len(term), stem):
            out.append((e, t))
    return min(out, default=None)


def test_automaton_against_distances():
    a, r = x.automaton(TERMS), random.Random(5)
    words = {w + "ab"[:k] for w, _ in TERMS for k in range(3)}
    for w, _ in TERMS:
        for _ in range(600):
            c = list(w)
            for _ in range(r.randrange(1, 4)):
                k, what = r.randrange(len(c) + 1), r.randrange(4)
                if what == 0:
                    c.insert(k, r.choice("abilotsw0"))
                elif c and what == 1:
                    del c[k % len(c)]
                elif c and what == 2:
                    c[k % len(c)] = r.choice("abilotsw0")
                elif len(c) > 1:
                    k %= len(c) - 1
                    c[k], c[k + 1] = c[k + 1], c[k]
            words.add("".join(c) + r.choice(["", "", "schaft", "x" * 30]))
    words = sorted(w for w in words if w)
    code, starts, ends = x.word_places(" ".join(words))
    assert len(starts) == len(words)
    found = {int(i): divmod(int(w), 3)[::-1] for i, w in zip(*x.matches(a, code, starts, ends), strict=True)}
    for i, w in enumerate(words):
        want = plain(w)
        got = found.get(i)
        assert (got is None) == (want is None) and (got is None or got[0] == want[0]), (w, got, want)


def test_words():
    assert x.words_of("Id!ot, ST*PID!! a$$ né, ÀB–c1 x_") == ["id!ot", "st*pid", "a", "né", "àb", "c1", "x"]
    assert x.words_of("") == [] and x.words_of("&&& ###") == []


@pytest.fixture(scope="module")
def model():
    return x.Model(TERMS, np.full(len(TERMS), 4.0), x.automaton(TERMS), frozenset({"idiom"}), np.array([-3.0, 1.0, 1.0, 0.2]))


def test_quotation_is_told_from_abuse(model):
    texts = ["you are an idiot, go away", 'she said "idiot" is the wrong word for it', "what an idiom", "an idoit and a wortles one", "fine day"]
    score = [x.score_of(model, x.features(model, *h)) for h in x.hits(model, texts)]
    assert score[0] > 0.7 > 0.3 > score[1] and score[2] == score[4] < 0.1 and score[3] > 0.7


def test_blocks_and_slices_change_nothing(model, monkeypatch):
    r = random.Random(2)
    texts = [" ".join(r.choice(["idiot", "word", '"idoit"', "loweischaft", "you", "said", "a", "Ünd", "scum"]) for _ in range(r.randrange(30))) for _ in range(80)] + ["", "idiot " * 400]
    want = [x.hits(model, [t])[0] for t in texts]
    assert x.hits(model, texts) == want
    monkeypatch.setattr(x, "_SLICE", 200)
    places = lambda rows: [(n, [h[:4] for h in found]) for n, found in rows]  # noqa: E731  a cut may part a hit from its context
    assert places(x.hits(model, texts)) == places(want)
    for t, (_, found) in zip(texts, want, strict=True):
        assert all(x.matches(model.table, *x.word_places(t[a:b]))[1][0] == term * 3 + e for a, b, term, e, _ in found)


def test_copies_do_not_make_terms():
    r = random.Random(1)
    syllables = "ba ko mi ze lu ra ti no".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(3))
    clean = [{word() for _ in range(40)} for _ in range(300)]
    copy = {word() + "copied" for _ in range(40)}
    toxic = [{word() for _ in range(40)} | set(r.sample(["idiot", "moron", "scum"], 2)) | (copy if k < 12 else set()) for k in range(60)]
    terms, weights = x.lexicon(toxic, clean)
    assert {w[:4] for w, _ in terms[:3]} == {"idio", "moro", "scum"} and len(terms) < 15 and (weights[:3] > 2).all()


def test_held_out_labels(spark, sf):
    big = sf.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    rows = x.op12(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    caught = [r.predicted for r in held if r.toxic]
    wrong = [r.predicted for r in held if not r.toxic]
    assert len(held) > 1000 and sum(caught) / len(caught) > 0.9 and sum(wrong) / len(wrong) < 0.01


def test_labels_held_out_are_not_learned_from(spark):
    docs = [(i, ("fool " if i % 4 == 0 else "fine ") + f"text {i}") for i in range(400)]
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 3 == 1}
    rows = [(i, int(i % 4 == 0)) for i, _ in docs]
    turned = [(i, 1 - t if i in held else t) for i, t in rows]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    a, b = (sorted(map(tuple, x.op12(d, spark.createDataFrame(r, "doc_id long, toxic int")).collect())) for r in (rows, turned))
    assert a == b and all(p == (i % 4 == 0) for i, _, _, p in a)


def test_odd_rows_and_empty_tables(spark):
    odd = [(1, None, "h"), (1, "", "h"), (None, "idiot", "h"), (2, "word " * 200_000 + "idiot", "h"), (3, "&&&", "h"), (3, "&&&", "h")]
    docs = spark.createDataFrame(odd, "doc_id long, text string, `hits.x` string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    labels = spark.createDataFrame([(1, 0), (1, 1), (3, None), (None, 1), (2, 1)], "doc_id long, toxic int")
    for known in (none, labels):
        rows = x.op12(docs, known).collect()
        assert len(rows) == len(odd) and all(0 <= r.score <= 1 for r in rows)
    assert x.op12(docs.limit(0), none).count() == 0
    model = x.fit(docs, none)
    model.terms, model.weights, model.table = TERMS, np.full(len(TERMS), 4.0), x.automaton(TERMS)
    assert x.score(docs, model).filter("doc_id = 2").first().hits[0].start == 1_000_000
