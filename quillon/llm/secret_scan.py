"""Secret scans by one combined deterministic automaton.

All rules are compiled into one minimised automaton (automaton.py), and every byte of every text passes through it once.
Bytes that lead from every state back to the start, such as a line's end, cut a text into segments that cannot share a
match, so many segments advance in step as arrays. Segments that accept some rule are then resolved to spans for every
rule, since the scan stops at a segment's first match: leftmost, longest, without overlap within a kind. A second automaton
of each rule reads such a segment from its end and marks where matches begin, so the time is linear in the text's length.

The base kinds are assign, access and hex; pem and jwt are further kinds. Base spans never depend on the further ones.

Defined results: a null text counts as empty; texts without a match have counts 0, the hash of an empty string and empty
spans; each row is one document, also where doc_id repeats or is null; other columns are not read; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .automaton import FEW, Automaton, beginnings, compile_rules, longest, longest_all, scan


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match of head + tail counts if its tail (or all of it, without head) has `least` characters."""

    kind: str
    head: str
    tail: str
    repeat: str
    least: int
    fold: bool = False

    def quick(self) -> str:
        """Accepts where a match that counts ends: the least length is in the pattern."""
        return f"{self.head}{self.tail}{self.repeat}{{{self.least},}}"

    def full(self) -> str:
        return f"{self.head}{self.tail}{self.repeat}+"


#: The kinds and their patterns, in the order that breaks ties. `least` counts repeats of the last class.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "", "[A-Za-z0-9+/_.=-]", 8, fold=True),
    Rule("access", "", "AKIA", "[A-Z0-9]", 12),
    Rule("hex", "", "", "[0-9a-f]", 32),
    Rule("pem", "", "-----BEGIN [A-Z0-9 ]*PRIVATE KEY", "-", 5),
    Rule("jwt", "", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.", "[A-Za-z0-9_-]", 16),
)
BASE = ("assign", "access", "hex")


@dataclass(frozen=True)
class Scanner:
    quick: Automaton
    full: tuple[Automaton, ...]
    heads: tuple[Automaton, ...]
    begin: tuple[Automaton, ...]
    rules: tuple[Rule, ...]


@lru_cache(maxsize=4)
def build(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(
        compile_rules([(r.quick(), r.fold) for r in rules], search=True),
        tuple(compile_rules([(r.full(), r.fold)], search=False) for r in rules),
        tuple(compile_rules([(r.head + r.tail, r.fold)], search=False) for r in rules),
        tuple(compile_rules([(r.full(), r.fold)], search=False, marks=True) for r in rules),
        rules,
    )


def _spans(s: Scanner, k: int, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, stop) of rule k in the segments, in bytes. A pass from the end tells where matches begin, so no start is tried
    in vain and each byte is looked at a bounded number of times."""
    rule, full, head = s.rules[k], s.full[k], s.heads[k]
    begins = beginnings(s.begin[k], data, starts, ends)
    which = np.searchsorted(starts, begins, side="right") - 1
    at = np.searchsorted(begins, starts)  # each segment's next match, all segments by turns
    live = np.flatnonzero(np.bincount(which, minlength=len(starts)))
    while len(live) >= FEW:
        first = begins[at[live]]
        stop = longest_all(full, data, first, ends[live])
        tail = longest_all(head, data, first, stop) if rule.head or rule.tail else first
        counts = stop - tail >= rule.least
        yield from zip(first[counts].tolist(), stop[counts].tolist(), strict=True)
        at[live] = np.searchsorted(begins, stop)
        more = at[live] < len(begins)
        live = live[more][which[at[live[more]]] == live[more]]
    for i in live.tolist():
        low, body, stop = int(starts[i]), data[starts[i] : ends[i]].tobytes(), 0
        for p in begins[at[i] : np.searchsorted(begins, ends[i])].tolist():
            if p - low >= stop:
                stop = longest(full, body, p - low, len(body))
                tail = longest(head, body, p - low, stop) if rule.head or rule.tail else p - low
                if stop - tail >= rule.least:
                    yield p, low + stop


def scan_batch(s: Scanner, texts: pa.Array) -> dict[int, list[tuple[str, int, int]]]:
    """By row, the spans (kind, start, end) in code points; rows without one are left out."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return {}
    data = np.frombuffer(texts.buffers()[2], np.uint8, count=offsets[-1])
    resets = s.quick.resets()
    cut = np.flatnonzero(resets[data[offsets[0] :]]) + offsets[0]
    starts = np.union1d(offsets[:-1], cut + 1)
    starts = starts[starts < offsets[-1]]
    ends = np.append(starts[1:], offsets[-1])
    wide = ends - starts >= min(len(r.tail) * (not r.head) * (r.tail == "AKIA") + r.least for r in s.rules)
    starts, ends = starts[wide], ends[wide]
    hit = scan(s.quick, data, starts, ends) > 0
    starts, ends = starts[hit], ends[hit]
    spans = sorted((a, k, b) for k in range(len(s.rules)) for a, b in _spans(s, k, data, starts, ends))
    out: dict[int, list[tuple[str, int, int]]] = {}
    now, at, points = -1, 0, 0
    for row, (a, k, b) in zip((np.searchsorted(offsets, [a for a, *_ in spans], side="right") - 1).tolist(), spans, strict=True):
        if row != now:
            now, at, points = row, int(offsets[row]), 0
        points += int(np.count_nonzero((data[at:a] & 0xC0) != 0x80))  # code points since the last span
        at = a
        out.setdefault(row, []).append((s.rules[k].kind, points, points + b - a))
    return out


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Returns doc_id and spans, an array of (kind, start, end) in code points, end exclusive: one row for each row of docs."""
    scanner = build(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            found = scan_batch(scanner, b.column("text"))
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in found.get(i, ())] for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(common.table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return out.select("doc_id", *[count(k) for k in BASE], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def _oracle() -> str:
    """The same spans by DuckDB's regexes: matches are set off by two private characters, and lengths give their places."""
    groups = {"assign": 2, "access": 0, "hex": 0, "pem": 1, "jwt": 1}
    kinds = []
    for n, r in enumerate(RULES):
        body = f"{r.head}{r.tail}({r.repeat}+)".replace("'", "''")
        least = r.least + (len(r.tail) if groups[r.kind] == 0 else 0)
        kinds.append(f"SELECT doc_id, {n} AS rank, '{r.kind}' AS kind, {least} AS least, {groups[r.kind]} AS part, '{'(?i)' if r.fold else ''}{body}' AS rule, coalesce(text, '') AS text FROM documents")
    return f"""
WITH k AS ({" UNION ALL ".join(kinds)}),
m AS (SELECT *, string_split(regexp_replace(text, rule, chr(57344) || '\\0' || chr(57345), 'g'), chr(57344)) AS parts FROM k),
x AS (SELECT *, unnest(range(2, len(parts) + 1)) AS i FROM m),
y AS (SELECT doc_id, rank, kind, least, string_split(parts[i], chr(57345))[1] AS body, length(replace(array_to_string(parts[:i - 1], ''), chr(57345), '')) AS start,
  CASE part WHEN 0 THEN 0 ELSE 1 END AS inner_part, CASE part WHEN 2 THEN regexp_extract(string_split(parts[i], chr(57345))[1], rule, 2) WHEN 1 THEN regexp_extract(string_split(parts[i], chr(57345))[1], rule, 1) END AS value FROM x),
s AS (SELECT doc_id, rank, kind, start, kind || ':' || start || ':' || (start + length(body)) AS span FROM y WHERE length(CASE inner_part WHEN 0 THEN body ELSE value END) >= least),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM s GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN a USING (doc_id)
"""


ORACLE = _oracle()
