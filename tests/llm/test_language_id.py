"""Language ID: held-out accuracy, and defined results for odd rows."""

from pyspark.sql import functions as F

from quillon.llm import language_id as lid

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = lid.train(docs)
    got = lid.predict(docs, model).where(lid.held_out(F.col("doc_id"))).where("length(text) >= 40")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98
    scores = got.agg(F.min("score"), F.max("score")).first()
    assert 0 <= scores[0] and scores[1] <= 1
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 %% \n", "x"), (None, "the and that with", "x")], "doc_id bigint, text string, score string")
    out = {r.doc_id: (r.lang_pred, r.score) for r in lid.predict(odd.drop("score"), model).collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0) and out[None][0] == "en"


def test_learns_nothing_from_held_out_or_unlabelled_rows(spark):
    import zlib

    out = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, "some text here", "xx") for i in out] + [(None, "a text", "yy"), (1, "text", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = lid.train(docs)
    assert model.langs == []
    assert {r.lang_pred for r in lid.predict(docs, model).collect()} == {"und"}


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert lid.predict(docs, lid.train(docs)).collect() == []
