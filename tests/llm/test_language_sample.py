"""Language ID's sample is bounded before it reaches the driver, also where doc_ids or rows repeat."""

import zlib

import pytest

from quillon.llm import language_id as lid


@pytest.mark.parametrize("same_text", [False, True])
def test_repeated_doc_ids(spark, monkeypatch, same_text):
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 4 != 2][:400]
    rows = [(i, f"some words of text number {i}", "aa") for i in ids]
    sent = []
    cls = type(spark.range(1))
    plain = cls.collect
    monkeypatch.setattr(cls, "collect", lambda self: sent.append(plain(self)) or sent[-1])
    for one in ids[:6]:
        sent.clear()
        more = [(one, "again" if same_text else f"again {k} and again", "aa") for k in range(1000)]
        model = lid.train(spark.createDataFrame(rows + more, "doc_id bigint, text string, lang string"), max_rows=100)
        assert len([r for part in sent for r in part if "slots" in r.asDict()]) <= 100
        assert model.report["sampled"] == 100
