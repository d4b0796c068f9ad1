"""ARC to WARC: digests, types and revisits against a brute-force version, and the version-specific header lines."""

import base64
import hashlib

import pytest

from quillon.llm import warc_convert as w

ROWS = [(1, "http://a/x y", "<p>é</p>"), (2, None, None), (3, "http://b", ""), (4, "http://c\n", "<p>é</p>"), (5, "", "WARC/1.1\r\n\r\nfiledesc://x\n\n1 0 x\n"), (9, "u", "x" * 200_000), (8, "u", "x" * 200_000), (None, "n", "<p>é</p>"), (None, "n", "alone"), (7, "d", "dup"), (7, "d", "dup")]


def brute(rows):
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    out, used = [], set()
    for i, _, h in rows:
        body = (h or "").encode()
        first = (-1 if i is None else i) == best[h or ""] and (h or "") not in used
        used |= {h or ""} if first else set()
        to = None if first else best[h or ""] if best[h or ""] >= 0 else None
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first else "revisit", to))
    return out


@pytest.mark.parametrize("roll", [w.ROLL, 1])
@pytest.mark.parametrize("rows", [ROWS, []])
def test_round_trip(spark, monkeypatch, rows, roll):
    monkeypatch.setattr(w, "ROLL", roll)
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, file string")
    got = w.archive_pages(pages).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(brute(rows), key=str)
    assert len({r.record_id for r in got}) == len(rows)


@pytest.mark.parametrize("version", [1, 2])
def test_header_lines_by_version(tmp_path, version):
    bodies = [b"one\n\nfiledesc://no 1 2 3 4\n", b"", b"\n\n"]
    data = w.arc_version_block("n.arc", version, "20010203040506")
    for b in bodies:
        data += w.arc_record(version, "http://u", "20010203", b, len(data), "n.arc")
    (tmp_path / "n.arc").write_bytes(data)
    got = list(w.read_arc(str(tmp_path / "n.arc")))
    assert [b for _, _, b in got] == bodies
    assert all(tuple(h) == w.ARC_FIELDS[version] for _, h, _ in got)
    assert w.warc_date(got[0][1]["Archive-date"]) == "2001-02-03T00:00:00Z"
    (tmp_path / "bad.arc").write_bytes(data[:-2])
    with pytest.raises(EOFError):
        list(w.read_arc(str(tmp_path / "bad.arc")))
