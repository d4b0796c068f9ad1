"""Columns of the input whose names the operators also use stay as they are; pages whose urls look like headers."""

from quillon.llm import exact_dedup, warc_convert

NAMES = ["sha", "_sha", "did", "_did", "text_sha", "text_doc", "rid", "keep_id", "recipe", "h"]


def test_exact_dedup_keeps_every_column(spark):
    rows = [(1, "a b", *NAMES), (2, "a b", *NAMES), (2, "a b", *NAMES), (None, "a b", *NAMES), (3, None, *NAMES), (4, "", *NAMES), (None, "z", *NAMES)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in NAMES))
    kept = exact_dedup.dedup_exact(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted((r.doc_id or -1, r.text) for r in got) == [(-1, "z"), (2, "a b"), (4, "")]
    assert all(list(r)[2:] == NAMES for r in got)
    groups = exact_dedup.exact_groups(docs).collect()
    assert len(groups) == len(rows) and sum(r.kept for r in groups) == 3


def test_urls_that_look_like_version_blocks(spark):
    urls = ["filedesc://x.arc", "filedesc://x 0.0.0.0 20200101 text/plain 12", "WARC/1.1", "http://a b\r\nHTTP/1.1 200", None, "", "é "]
    pages = spark.createDataFrame([(i, u, f"<p>{i % 3}</p>\r\n\r\nfiledesc://y 1", "x") for i, u in enumerate(urls)], "page_id bigint, url string, html string, sha1 string")
    got = {r.page_id: r for r in warc_convert.archive_pages(pages).collect()}
    assert sorted(got) == list(range(len(urls)))
    assert [got[i].url for i in (0, 4)] == ["filedesc://x.arc", "urn:page:4"]
    assert [got[i].refers_to for i in range(len(urls))] == [6, 4, 5, 6, None, None, None]
