"""Line dedup against a plain version, with few and many runs."""

import random
from collections import defaultdict

import pytest

from quillon.llm import line_dedup as ld


def brute(rows, least_docs):
    key = lambda line: line.strip(ld.STRIP).translate(str.maketrans(ld.UPPER, ld.LOWER))
    docs = defaultdict(list)
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                docs[k].append(-1 if d is None else d)
    gone = lambda d, line: len(docs.get(key(line), ())) >= least_docs and (-1 if d is None else d) < max(docs[key(line)])
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not gone(d, x)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("batches", "fan_in"), [(1, 2), (7, 2)])
def test_matches_plain(spark, batches, fan_in):
    rng = random.Random(5)
    lines = [f"{'Ünique line ' * 4}{i}" for i in range(12)] + ["short", "", " \t", "  " + "X" * 39 + " ", "  " + "X" * 40 + "\v", "x" * 40]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(6)))) for i in range(60)] + [(None, lines[0]), (70, None), (71, ""), (72, "\n".join([lines[1]] * 50))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, h string")
    got = ld.dedup_lines(docs, batches=batches, fan_in=fan_in).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got), key=str) == brute(rows, 5)


def test_runs_are_levelled_and_hold_a_hash_once(spark):
    store = ld.LineRuns(spark, fan_in=2)
    for b in range(5):
        store.add(spark.createDataFrame([(bytes([i]), 10 * b + i) for i in range(b, b + 4)], "h binary, did bigint"))
    assert sorted(level for level, _ in store.runs) == [0, 2]
    seen = [r.h for _, n in store.runs for r in spark.table(n).collect()]
    assert len(seen) == len(set(seen)) == 8
    assert {bytes(r.h)[0]: r.docs for r in store.totals().collect()} == {0: 1, 1: 2, 2: 3, 3: 4, 4: 4, 5: 3, 6: 2, 7: 1}
    store.drop()


def test_no_rows(spark):
    assert ld.dedup_lines(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
