"""The pipeline's stages on a small corpus, against plain versions of what each has to do."""

import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from quillon.llm import byte_bpe

DATA = "/root/testdata/sf0.001"


def grams(text):
    import re

    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def near(a, b):
    both = len(a & b)
    return both > 0 and both >= 0.8 * (len(a) + len(b) - both) - 1e-9


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    planted = docs.limit(1).selectExpr("doc_id + 100000 AS doc_id", "'12 345 %%' AS text", "lang", "source", "n_chars").unionAll(docs.limit(1).selectExpr("doc_id + 100001 AS doc_id", "text", "lang", "source", "n_chars"))
    now = docs.unionAll(planted)
    steps = [{r.doc_id: r.text for r in now.collect()}]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, now, DATA)
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert len({r.doc_id for r in rows}) == len(rows)
        now = spark.createDataFrame(rows, docs.schema)
        steps.append({r.doc_id: r.text for r in rows})
    first, lang, exact, one, clean = steps
    assert set(first) - set(lang) >= {max(first) - 1} and len(lang) >= 0.99 * (len(first) - 1)
    assert set(exact) == {max(d for d, t in lang.items() if t == text) for text in set(lang.values())}
    sets = {d: grams(t) for d, t in exact.items()}
    assert all(not near(sets[a], sets[b]) for a in one for b in one if a < b)
    assert all(any(near(sets[d], sets[o]) for o in sets if o != d) for d in set(exact) - set(one))
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    holds = {d for d, t in one.items() if any(i in " ".join(t.lower().split()) for i in items)}
    assert holds and holds == set(one) - set(clean)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    out = corpus_pipeline.STAGES[-1][1](spark, now, DATA).collect()
    assert {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in out} == {(d, len(enc.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for d, t in clean.items()}
