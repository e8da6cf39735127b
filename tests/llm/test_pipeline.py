"""The pipeline's stages one by one against plain versions, and the run as a whole."""

from __future__ import annotations

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from strandlog.llm import packing, pii  # noqa: E402
from test_operators import brute_leaks, brute_near_copies  # noqa: E402


def kept_by_sql(sf) -> set:
    """The documents that no rule rejects, by the SQL of operator 4."""
    import duckdb

    from strandlog.llm import quality

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    return {i for (i,) in db.execute(f"SELECT doc_id FROM ({quality.ORACLE}) WHERE kept").fetchall()}


def plain_masked(texts: dict, spans: dict) -> dict:
    """Each place of the spans that operator 9 lists as its kind; spans that overlap are one place, of the first one's kind."""
    out = {}
    for i, text in texts.items():
        places = []
        for kind, a, b in sorted((x.split(":") for x in spans[i].split(",") if x), key=lambda x: (int(x[1]), int(x[2]))):
            if places and int(a) < places[-1][1]:
                places[-1][1] = max(places[-1][1], int(b))
            else:
                places.append([int(a), int(b), kind])
        for a, b, kind in reversed(places):
            text = f"{text[:a]}<{kind.upper()}>{text[b:]}"
        out[i] = text
    return out


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality_rules", "near_duplicates", "benchmark_decontamination", "personal_data", "binary_packing"]

    def rows(df):
        return {r.doc_id: r.text for r in df.collect()}

    a = steps["quality_rules"](spark, docs, sf).cache()
    assert a.columns == columns and 0 < a.count() < docs.count() and set(rows(a)) == kept_by_sql(sf)
    b = steps["near_duplicates"](spark, a, sf).cache()
    # the brief's rule for stages: five words, a similarity of 0.8 or more; operator 7's three bits bind its own query only
    want = {i for i, c in brute_near_copies(list(rows(a).items())).items() if i == c}
    assert b.columns == columns and set(rows(b)) == want
    c = steps["benchmark_decontamination"](spark, b, sf).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert c.columns == columns and set(rows(c)) == {i for i, x in brute_leaks(list(rows(b).items()), items).items() if not x[4]}
    d = steps["personal_data"](spark, c, sf).cache()
    assert d.columns == columns and set(rows(d)) == set(rows(c))
    assert rows(d) == plain_masked(rows(c), {r.doc_id: r.spans for r in pii.op9(c).collect()}) != rows(c)
    assert not any(pii.base_spans(t) for t in rows(d).values()) and all(r.n_chars == len(r.text) for r in d.collect())
    e = steps["binary_packing"](spark, d, sf)
    totals = {r.doc_id: r.n for r in e.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert totals == {r.doc_id: r.doc_tokens for r in packing.pack(d).select("doc_id", "doc_tokens").distinct().collect()} and set(totals) == set(rows(d))
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, whole.select("doc_id", "start", "length").collect())) == sorted(map(tuple, e.select("doc_id", "start", "length").collect()))


def test_near_duplicates_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    a = steps["quality_rules"](spark, docs, sf).cache()
    b = steps["near_duplicates"](spark, a, sf)
    want = {i for i, c in brute_near_copies([(r.doc_id, r.text) for r in a.collect()]).items() if i == c}
    assert b.columns == docs.columns and {r.doc_id for r in b.collect()} == want


def made_corpus(spark, folder, docs: list[tuple], schema: str = "doc_id long, text string, lang string, source string, n_chars long") -> str:
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([("b1", "these ten words in a row are the benchmark's own item")], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def prose(seed: int, n: int = 80) -> str:
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(3, 8))) for _ in range(n))


def test_run_over_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, made_corpus(spark, tmp_path, [])).count() == 0


def test_run_over_odd_rows(spark, tmp_path):
    """Nulls in any column, empty texts, ties, rows that repeat, one id on several texts, columns of clashing names."""
    leak = prose(1, 60) + " these ten words in a row are the benchmark's own item " + prose(2, 20)
    docs = [
        (1, prose(3), "en", "s", 5), (1, prose(3), "en", "s", 5), (2, prose(3), None, None, None), (3, None, "en", "s", None), (4, "", "en", "s", 0), (5, prose(4), "en", "s", 9), (5, prose(5), "en", "s", 9),
        (None, prose(6), "en", "s", 1), (None, prose(6), "en", "s", 1), (None, prose(4), "en", "s", 1), (6, leak, "en", "s", 1), (7, prose(7) + " write to a.b@c.org", "en", "s", 1),
    ]
    sf = made_corpus(spark, tmp_path, [(*d, 1, "x") for d in docs], "doc_id long, text string, lang string, source string, n_chars long, length long, _hash string")
    out = corpus_pipeline.run(spark, sf)
    whole = sorted(((r.doc_id, r.doc_tokens) for r in out.select("doc_id", "doc_tokens", "start").filter("start = 0").collect()), key=str)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    size = lambda x: len(t.encode(x, add_special_tokens=False).ids) + 1
    want = [(1, size(prose(3))), (5, size(prose(4))), (5, size(prose(5))), (None, size(prose(6))), (7, size(prose(7) + " write to <EMAIL>"))]
    assert whole == sorted(want, key=str)
