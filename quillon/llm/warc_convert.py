"""Legacy archives to WARC: ARC files of versions 1 and 2 are parsed and rewritten as WARC records.

An ARC file opens with a version block, whose lines tell the file's version and the fields of its record lines; each
record is such a line, with the length of its body, and the body. The converter reads records by those declared lengths
and synthesises for each the WARC equivalents: an identifier derived from file and offset (the same on every run), a
date, a type and SHA-1 digests of block and payload. Of records with equal payloads, one becomes a response and the
others revisits of it. Archives are rolled at ROLL bytes, so a task holds one record at a time and decisions for one file.

Steps, each a Spark job that reads what the last one wrote in the shared folder: write archives; index them (file,
offset, digest); choose the responses by a grouping on digest; convert file by file; read the WARC files back.

Defined results: a null html is an empty payload, and empty payloads are equal; a null url becomes urn:page:<page_id>;
white space and control characters in a url are percent-encoded, and a url that looks like a version block's is a page's all the same; a null page_id is written as "null", loses to all
others and is read back as null; rows that repeat a page_id are records of their own and the first archived one is the
response among equals; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes after which a new archive is begun; effort of the compression; how a gzip member begins.
ROLL, LEVEL, GZIP = 32 << 20, 3, b"\x1f\x8b"
NO_ID = -(2**63)
#: The record-line fields of the two ARC versions.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def safe_url(url: str | None, page_id: int | None) -> str:
    if url is None or not url:
        return f"urn:page:{page_id}"
    return "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in url)


# ---- ARC

def arc_version_block(name: str, version: int, date: str) -> bytes:
    """The record that opens an ARC file."""
    fields = " ".join(ARC_FIELDS[version])
    body = f"{version} {0 if version == 1 else 1} quillon\n{fields}\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}\n" if version == 1 else f"filedesc://{name} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(body)}\n"
    return line.encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, body: bytes, offset: int, name: str) -> bytes:
    if version == 1:
        line = f"{url} 0.0.0.0 {date} text/html {len(body)}\n"
    else:
        line = f"{url} 0.0.0.0 {date} text/html 200 {hashlib.md5(body).hexdigest()} - {offset} {name} {len(body)}\n"
    return line.encode() + body + b"\n"


class Source:
    """Reads a file forward in blocks, plain or of gzip members. Offsets are those of the plain bytes."""

    def __init__(self, uri: str, block: int = 1 << 20):
        files, path = common.store(uri)
        self.src, self.block = files.open_input_stream(path), block
        self.held, self.at, self.offset = b"", 0, 0
        self.packed = self.src.read(self.block)
        self.gzip = zlib.decompressobj(31) if self.packed[:2] == GZIP else None

    def _plain(self) -> bytes:
        """The next bytes, none at the end."""
        while True:
            got, self.packed = self.packed or self.src.read(self.block), b""
            if not got or self.gzip is None:
                return got
            if self.gzip.eof:
                self.gzip = zlib.decompressobj(31)
            out = self.gzip.decompress(got)
            self.packed = self.gzip.unused_data
            if out:
                return out

    def _more(self) -> bool:
        got = self._plain()
        self.held, self.at = self.held[self.at :] + got, 0
        return bool(got)

    def read(self, size: int) -> bytes:
        parts, have = [self.held[self.at :]], len(self.held) - self.at
        while have < size:
            if not (got := self._plain()):
                raise EOFError(f"{size} bytes were declared, {have} are there")
            parts.append(got)
            have += len(got)
        if len(parts) > 1:
            self.held, self.at = b"".join(parts), 0
        out = self.held[self.at : self.at + size]
        self.at += size
        self.offset += size
        return out

    def line(self) -> bytes:
        """The next line with its line feed; empty at the end of the file."""
        while (end := self.held.find(b"\n", self.at)) < 0 and self._more():
            pass
        return self.read((end + 1 if end >= 0 else len(self.held)) - self.at)


def read_arc(uri: str) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields and body of each record after the version block, whose fields decide how lines are read."""
    src = Source(uri)
    fields: tuple[str, ...] = ARC_FIELDS[1]
    while True:
        offset, line = src.offset, src.line()
        if not line:
            return
        text = line.decode("utf-8", "surrogateescape").rstrip("\r\n")
        if not text:
            continue
        parts = text.split(" ")
        if offset == 0 and text.startswith("filedesc://"):  # later ones are records of pages with such a url
            about = src.read(int(parts[-1])).decode().split("\n")
            version = int(about[0].split(" ")[0])
            fields = tuple(about[1].split(" ")) if len(about) > 1 and about[1] else ARC_FIELDS[version]
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is not known")
            continue
        if len(parts) != len(fields):
            raise ValueError(f"an ARC record line has {len(parts)} fields and not {len(fields)}: {text[:200]}")
        head = dict(zip(fields, parts, strict=True))
        yield offset, head, src.read(int(head["Archive-length"]))


def split_http(body: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, header bytes and payload of an HTTP response."""
    head, mark, payload = body.partition(b"\r\n\r\n")
    if not mark:
        return {}, b"", body
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, head + mark, payload


# ---- WARC

def warc_date(arc_date: str) -> str:
    d = arc_date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(name: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'arc:{name}#{offset}')}>"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogateescape") + b"\r\n" + block + b"\r\n\r\n"


def read_warc(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    src = Source(uri)
    while line := src.line():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins at {src.offset - len(line)}")
        fields = {}
        while text := src.line().decode("utf-8", "surrogateescape").rstrip("\r\n"):
            key, _, value = text.partition(": ")
            fields[key] = value
        yield fields, src.read(int(fields["Content-Length"]))


class Roller:
    """Writes each record as a gzip member, to files of about ROLL bytes under names of their own; `done` has those closed."""

    def __init__(self, root: str, suffix: str, opening: Callable[[str], bytes] = lambda name: b""):
        self.root, self.suffix, self.opening = root, suffix, opening
        self.out, self.done = None, []

    def place(self) -> tuple[str, int]:
        """Name of the current file and the offset of the next record."""
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}{self.suffix}"
            files, path = common.store(f"{self.root}/{self.name}")
            files.create_dir(posixpath.dirname(path), recursive=True)
            self.out = files.open_output_stream(path)
            self.offset = self.size = self.records = 0
            self._put(self.opening(self.name))
        return self.name, self.offset

    def _put(self, data: bytes) -> None:
        packed = gzip.compress(data, LEVEL, mtime=0)
        self.out.write(packed)
        self.offset += len(data)
        self.size += len(packed)

    def write(self, data: bytes) -> None:
        self.place()
        self._put(data)
        self.records += 1
        if self.size >= ROLL:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((f"{self.root}/{self.name}", self.records))
            self.out = None


def write_arcs(pages: DataFrame, root: str, date: str = "20200102030405") -> DataFrame:
    """Writes pages (page_id, url, html) to ARC files, by turns of version 1 and 2. Returns file, records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = 1
        roller = Roller(root, ".arc.gz", lambda name: arc_version_block(name, version, date))
        for b in batches:
            for page_id, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {'null' if page_id is None else page_id}\r\n\r\n"
                if roller.out is None:
                    version = 1 + len(roller.done) % 2
                name, offset = roller.place()
                roller.write(arc_record(version, safe_url(url, page_id), date, head.encode() + payload, offset, name))
        roller.close()
        yield pa.RecordBatch.from_pydict({"file": [f for f, _ in roller.done], "records": [n for _, n in roller.done]}, pa.schema([("file", pa.string()), ("records", pa.int64())]))

    return pages.select("page_id", "url", "html").mapInArrow(run, "file string, records bigint")


def _each_file(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    for b in batches:
        yield from b.column("file").to_pylist()


INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("sha1", pa.string())])


def index_arcs(arcs: DataFrame) -> DataFrame:
    """file, offset, page_id and payload digest of each record of the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file in _each_file(batches):
            rows: list[tuple] = []
            for offset, _, body in read_arc(file):
                fields, _, payload = split_http(body)
                own = fields.get("x-page-id", "null")
                rows.append((file, offset, None if own == "null" else int(own), digest(payload)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, INDEX, strict=True)], schema=INDEX)

    return arcs.select("file").mapInArrow(run, "file string, offset bigint, page_id bigint, sha1 string")


def _place() -> Column:
    return F.concat("file", F.lit("#"), F.lpad(F.col("offset").cast("string"), 15, "0"))


def choose_responses(index: DataFrame) -> DataFrame:
    """sha1, best (pid, place) and records: equal payloads have one response, the record with the largest page_id, and of
    several such the one first by file and offset."""
    own = index.withColumn("pid", F.coalesce(F.col("page_id"), F.lit(NO_ID))).withColumn("place", _place())
    best = own.groupBy("sha1", "pid").agg(F.min("place").alias("place"), F.count("*").alias("records"))
    return best.groupBy("sha1").agg(F.max(F.struct("pid", "place")).alias("best"), F.sum("records").alias("records"))


def decide(index: DataFrame, responses: DataFrame) -> DataFrame:
    """The index with is_response, refers_to (the response's page_id) and response_place. Both inputs are written tables."""
    both = common.join_split(index.withColumn("place", _place()), responses, "sha1", "records")
    return both.select("file", "offset", "sha1", (F.col("place") == F.col("best.place")).alias("is_response"), F.when(F.col("best.pid") != NO_ID, F.col("best.pid")).alias("refers_to"), F.col("best.place").alias("response_place"))


def convert_arcs(decided: DataFrame, root: str) -> DataFrame:
    """Rewrites every archive named in `decided` as WARC. Returns file, records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller(root, ".warc.gz", lambda name: warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, 0)), ("WARC-Date", "2020-01-02T03:04:05Z"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"software: quillon\r\nformat: WARC File Format 1.1\r\n"))
        file, fates = None, {}

        def convert() -> None:
            if file is None:
                return
            name = posixpath.basename(file)
            for offset, head, body in read_arc(file):
                is_response, sha1, refers_to, place = fates[offset]
                _, http_head, payload = split_http(body)
                fields = [("WARC-Type", "response" if is_response else "revisit"), ("WARC-Record-ID", record_id(name, offset)), ("WARC-Date", warc_date(head["Archive-date"])), ("WARC-Target-URI", head["URL"]), ("WARC-IP-Address", head["IP-address"]), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{sha1}")]
                block = http_head + payload if is_response else http_head
                if not is_response:
                    there, _, at = place.rpartition("#")
                    fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(posixpath.basename(there), int(at))), ("X-Refers-To-Page", str(refers_to))]
                roller.write(warc_record([*fields, ("WARC-Block-Digest", f"sha1:{digest(block)}")], block))

        for b in batches:  # the rows of a file follow each other
            for f, offset, sha1, is_response, refers_to, place in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "sha1", "is_response", "refers_to", "response_place")), strict=True):
                if f != file:
                    convert()
                    file, fates = f, {}
                fates[offset] = (is_response, sha1, refers_to, place)
        convert()
        roller.close()
        yield pa.RecordBatch.from_pydict({"file": [f for f, _ in roller.done], "records": [n for _, n in roller.done]}, pa.schema([("file", pa.string()), ("records", pa.int64())]))

    by_file = decided.repartition(common.parallelism(decided.sparkSession), "file").sortWithinPartitions("file", "offset")
    return by_file.mapInArrow(run, "file string, records bigint")


RECORDS = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, record_id string, date string"


def read_warcs(warcs: DataFrame) -> DataFrame:
    """The response and revisit records of WARC files, one row each. A response's payload is measured again and must agree
    with its digest; a revisit has its payload's length from the HTTP header that it repeats."""
    names = [x.split(" ")[0] for x in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file in _each_file(batches):
            rows: list[tuple] = []
            for fields, block in read_warc(file):
                kind = fields["WARC-Type"]
                if kind not in ("response", "revisit"):
                    continue
                http, _, payload = split_http(block)
                own, sha1 = http["x-page-id"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and (digest(payload) != sha1 or len(payload) != int(http["content-length"])):
                    raise ValueError(f"{fields['WARC-Record-ID']} does not have the payload that it declares")
                to = fields.get("X-Refers-To-Page", "None")
                rows.append((None if own == "null" else int(own), fields["WARC-Target-URI"], kind, int(http["content-length"]), sha1, None if to == "None" else int(to), fields["WARC-Record-ID"], fields["WARC-Date"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names)

    return warcs.select("file").mapInArrow(run, RECORDS)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC files read back: one row for each page (RECORDS)."""
    spark = pages.sparkSession
    root = common.work_path(spark, "archives")
    spread = common.parallelism(spark)
    arcs = common.saved(write_arcs(pages, f"{root}/arc"), f"{root}/arc-files").repartition(spread)
    index = common.saved(index_arcs(arcs), f"{root}/index")
    responses = common.saved(choose_responses(index), f"{root}/responses")
    warcs = common.saved(convert_arcs(decide(index, responses), f"{root}/warc"), f"{root}/warc-files").repartition(spread)
    common.remove(f"{root}/arc", f"{root}/arc-files", f"{root}/index", f"{root}/responses")
    return read_warcs(warcs)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archive_pages(common.table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best FROM pages)
SELECT page_id, octet_length(encode(h)) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(s, (i // 4) * 5 + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
FROM p
"""
