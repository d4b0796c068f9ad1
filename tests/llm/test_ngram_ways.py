"""N-gram join: both ways of cutting a component, pairs right at the threshold, long texts, clashing columns, hot groups."""

import random

import numpy as np
import pytest

from quillon.llm import ngram_join as nj

from .test_ngram_join import brute, make


def result(groups):
    return sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.class_id is None else r.class_id, r.n_links) for r in groups.collect())


def chain(seed, n=60, size=120, step=12):
    """Texts, each near the one before it and far from those further back: one component of few links."""
    rng, rows = random.Random(seed), []
    words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    for i in range(n):
        at = (i * step) % size
        words[at : at + step // 2] = [f"w{rng.randrange(10**6)}" for _ in range(step // 2)]
        rows.append((i, " ".join(words)))
    return rows


def test_chains_go_by_buckets_and_hubs_whole(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_ROWS", 4)
    seen = []
    plain = nj.common.saved
    monkeypatch.setattr(nj.common, "saved", lambda df, uri: seen.append((uri.rsplit("/", 1)[1], out := plain(df, uri))) or out)
    rows = [*chain(1), *((1000 + i, t) for i, t in make(3, groups=3, most=25) if i is not None)]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    ways = []
    monkeypatch.setattr(nj.common, "remove", lambda *uris: ways.append([r.whole for name, df in seen if name == "whole" for r in df.collect()]) if any("ngram-join" in u and "/near" not in u and "/final" not in u for u in uris) else None)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(nj.jaccard_groups(docs)) == brute(rows)
    assert {True, False} <= set(ways[-1])


@pytest.mark.parametrize(("extra", "linked"), [(0, True), (1, False)])
def test_pairs_at_the_threshold(spark, extra, linked):
    # n-grams: 40 in common of 50 in all is 0.8; one more is less
    base = [f"a{i}" for i in range(49)]
    other = base[:44] + [f"b{i}" for i in range(extra)]
    assert len(nj.ngrams(" ".join(base))) == 45 and nj.similar(40, 45, 45, 0.8) and not nj.similar(39, 44, 45, 0.8)
    left, right = [f"a{i}" for i in range(54)], [f"a{i}" for i in range(44)] + [f"b{i}" for i in range(extra)]
    docs = spark.createDataFrame([(1, " ".join(left)), (2, " ".join(right)), (3, " ".join(other[:20]))], "doc_id bigint, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in nj.jaccard_groups(docs).collect()}
    assert got[2] == ((1, 1) if linked else (2, 0))


def test_long_texts_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_GRAMS", 5000)
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(20_000)]
    rows = []
    for i in range(4):
        own = list(base)
        for _ in range(300):
            own[rng.randrange(len(own))] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    rows += [(10, "w " * 50_000), (11, "x" * 300_000), (12, " ".join(base[:9000]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(nj.jaccard_groups(docs)) == brute(rows)


def test_recall_of_candidates():
    rows, count = nj.bands(0.8)
    rng, found = np.random.default_rng(8), 0
    sign = nj.Signer(rows, count)
    for _ in range(300):
        every = rng.integers(1, 2**63, 100, dtype=np.uint64)
        a, b = sign(every[:90]), sign(every[10:])  # 80 of 100 in common
        found += bool((a == b).any())
    assert found >= 299


def test_clashing_columns_and_repeated_rows(spark):
    names = ["tkey", "near_text", "near_doc", "rid", "did", "whole", "_near_key"]
    text = "one two three four five six seven eight"
    rows = [(3, text, *names), (3, text, *names), (1, text, *names), (7, text + " nine ten", *names), (8, None, *names), (None, text, *names)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names))
    kept = nj.one_of_each(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got) == [-1, 7, 8] and all(list(r)[2:] == names for r in got)


def test_one_hot_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(700):
        own = list(base)
        own[rng.randrange(60)] = f"z{i}"
        rows.append((i, " ".join(own)))
    got = nj.jaccard_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.class_id for r in got} == {0} and {(r.doc_id, r.n_links) for r in got} == {(d, n) for d, _, n in brute(rows)}


def test_large_sets_are_compared_by_ranges(monkeypatch):
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 2**64, 500, dtype=np.uint64, endpoint=False)
    sets = [np.unique(rng.choice(pool, n)) for n in (0, 1, 300, 450, 20)]
    want = [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets]
    for most in (1, 7, 100, 10**6):
        monkeypatch.setattr(nj, "COMPARED", most)
        assert nj.overlaps(sets, sets[2:]).tolist() == want
