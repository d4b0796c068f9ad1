"""The pipeline as a whole: run() on odd tables, empty tables, texts in letters that were not learned, clashing columns."""

import random

import pytest

import corpus_pipeline

WORDS = {"en": ["the", "of", "and", "house", "that", "with", "water", "from", "tree"], "de": ["der", "und", "haus", "nicht", "wasser", "baum", "mit", "über"]}
SCHEMA = "doc_id bigint, text string, lang string, source string, score double, tkey string, lang_pred string"


def corpus():
    rng, rows = random.Random(3), []
    for i in range(240):
        lang = "en" if i % 2 else "de"
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(60)), lang, "s", 0.5, "k", "p"))
    rows += [(1000, rows[5][1], "en", "s", 0.5, "k", "p"), (None, rows[6][1], "de", "s", 0.5, "k", "p"), (1001, rows[7][1] + " tail", "en", "s", 0.5, "k", "p")]
    rows += [(2000, None, "en", "s", 0.5, "k", "p"), (2001, "", None, "s", 0.5, "k", "p"), (2002, "12 34 %%", None, "s", 0.5, "k", "p"), (2003, "жук и дом " * 20, None, "s", 0.5, "k", "p"), (2004, "東京の水と木 " * 20, None, "s", 0.5, "k", "p")]
    item = " ".join(rng.choice(WORDS["en"]) for _ in range(25))
    rows += [(3000, " ".join(rng.choice(WORDS["en"]) for _ in range(40)) + " " + item, "en", "s", 0.5, "k", "p"), (3001, rows[8][1], "de", "s", 0.5, "k", "p"), (3001, rows[8][1], "de", "s", 0.5, "k", "p")]
    return rows, [(1, item), (2, None), (None, "")]


def tables(spark, tmp_path, docs, items):
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_run(spark, tmp_path):
    rows, items = corpus()
    at = tables(spark, tmp_path, rows, items)
    out = corpus_pipeline.run(spark, at)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    kept = [r.doc_id for r in out.collect()]
    want = set(range(240)) - {5, 7, 8}
    # of exact copies the largest doc_id stays, of near ones the least; a null doc_id loses to all
    assert sorted(kept) == sorted((want | {1000, 7, 3001}))


def test_a_stage_keeps_every_column(spark, tmp_path):
    rows, items = corpus()
    at = tables(spark, tmp_path, rows, items)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, at)
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    got = docs.collect()
    assert got and all((r.score, r.tkey, r.lang_pred) == (0.5, "k", "p") for r in got)


@pytest.mark.parametrize("none", ["documents", "benchmark", "letters"])
def test_empty_tables(spark, tmp_path, none):
    rows, items = corpus()
    docs = [] if none == "documents" else [r for r in rows if r[0] in (2000, 2001, 2002)] if none == "letters" else rows[:30]
    at = tables(spark, tmp_path, docs, [] if none == "benchmark" else items)
    assert corpus_pipeline.run(spark, at).count() == (30 if none == "benchmark" else 0)
