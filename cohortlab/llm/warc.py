"""WARC archives: a writer, and a reader that splits files at any byte.

A record is one gzip member, so an archive is a file of members one after the
other. Spark writes and reads the files, so they may lie in any store that it
opens, and lost tasks are repeated like any other.

Writer. Each task writes one archive with a warcinfo record first. The store's
writer ends each row with a zero byte: a member of less than 16 MB ends with
one (the top byte of its size), which is therefore left to the writer; after
larger members it is padding, which gzip readers skip.

Reader. Files are cut into byte ranges whatever they are named (``byte_ranges``). A task scans its byte range for the gzip magic (the delimiter of the
input format); what begins after a magic inside the range is its own, read to
the next magic even if that lies beyond the range. A magic can also occur by
chance inside compressed data, so each candidate is validated: it is a member
only if it inflates to a WARC version line. A candidate that isn't belongs to
the member before it, which is still open then; one is complete when its
checksum and size are right. If a range starts with such a candidate, or ends
with an open member, the pieces are put together by file in a second step,
which has no rows unless a chance magic is the first of a range.

Cases. Null html: empty payload. Empty table: archives without pages. Rows
that repeat a page_id are records of their own; those with the group's largest
page_id are all responses. A null page_id is a revisit if a page with an id
has the same payload and a response otherwise. Control characters in a url are
percent-encoded; a null url writes no target. Bytes that form no member give a
row of type ``damaged``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import scratch_path
from .common import bounded_batches, small_side, table, written

# Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORD = "file string, warc_type string, record_id string, target_uri string, page_id long, refers_to long, payload_bytes long, payload_digest string"
PIECE = "block long, place long, piece binary"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(headers: list[tuple[str, object]], block: bytes, level: int) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = z.compress(VERSION + b"\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + z.flush()
    return out[:-1] if out.endswith(b"\0") else out


def _id(*of: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, of)))}>"


def page_member(page_id, url, payload: bytes, refers_to, kept: bool, level: int = 6) -> bytes:
    digest = digest32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "response" if kept else "revisit"), ("WARC-Record-ID", _id(page_id, digest)), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        headers.append(("X-Page-Id", page_id))
    if not kept:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _id(refers_to, digest)), ("X-Refers-To-Page-Id", refers_to)]
    return _member(headers, http + payload if kept else http, level)


def with_originals(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, refers_to): of equal payloads, rows refer to the largest page_id."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    groups = rows.groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1")
    groups = small_side(written(groups.select(F.col("digest").alias("of"), "kept"), "payload_groups"))
    other = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return rows.join(groups, F.col("digest") == F.col("of"), "left").select(
        "page_id", "url", "payload", F.when(other, F.col("kept")).alias("refers_to")
    )


def write_archives(pages: DataFrame, path: str, level: int = 6) -> None:
    def members(batches):
        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _id("warcinfo")), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")]
        yield pa.RecordBatch.from_arrays([pa.array([_member(info, b"format: WARC File Format 1.1\r\n", level)], pa.binary())], ["member"])
        for b in batches:
            columns = [b.column(c) for c in ("page_id", "url", "payload", "refers_to")]
            for i in range(0, b.num_rows, 64):  # some members at a time
                rows = zip(*[c.slice(i, 64).to_pylist() for c in columns])
                out = [page_member(p, u, x, r, r is None, level) for p, u, x, r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    bounded_batches(pages.sparkSession)
    out = with_originals(pages).mapInArrow(members, "member binary")
    out.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def parse_record(raw: bytes, file: str) -> tuple:
    """One row of ``RECORD`` from an inflated member."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    number = lambda k: int(fields[k]) if fields.get(k, "").lstrip("-").isdigit() else None
    block = rest[: number("content-length") or 0]
    kind, size, digest = fields.get("warc-type"), None, fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        if kind == "response":
            size, digest = len(payload), digest32(payload)
        elif m := re.search(rb"(?i)\ncontent-length:\s*(\d+)", http):
            size = int(m[1])
    return (file, kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), number("x-page-id"), number("x-refers-to-page-id"), size, digest)


def starts_member(candidate: bytes) -> bool:
    try:
        return zlib.decompressobj(31).decompress(candidate[:4096], len(VERSION)).startswith(b"WARC/")
    except zlib.error:
        return False


class Assembler:
    """Members of one byte range, from its candidates in order."""

    def __init__(self) -> None:
        self.open: tuple | None = None  # inflater, what it gave, the bytes it was given, the place of the first
        self.lost: list[tuple[int, bytes]] = []  # pieces of members that begin or end outside the range

    def feed(self, place: int, candidate: bytes) -> bytes | None:
        """The member that ``candidate`` completes, if any."""
        if starts_member(candidate):
            self.close()
            self.open = (zlib.decompressobj(31), [], [], place)
        if self.open is None:
            self.lost.append((place, candidate))
            return None
        inflater, got, given, _ = self.open
        given.append(candidate)
        try:
            got.append(inflater.decompress(candidate))
        except zlib.error:
            self.close()
            return None
        if not inflater.eof:
            return None
        self.open = None
        return b"".join(got)

    def close(self) -> None:
        if self.open is not None:
            self.lost.append((self.open[3], b"".join(self.open[2])))
            self.open = None


def byte_ranges(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, dict[str, str]]:
    """((piece, file, block) cut at the magic; names of files by what ``file`` calls them).

    Spark inflates and doesn't split what is named ``.gz``. Such files are read
    by another name: a mount table of this one read (options of the reader reach Hadoop's
    configuration on the driver and in tasks) links a number to each of them.
    """
    reader = lambda: spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1"))
    files = reader().text(path).inputFiles()  # a listing, no job
    zipped = [f for f in files if re.search(r"\.(gz|deflate|bz2|zst|lz4|snappy)$", f)]
    if not zipped:
        return _pieces(reader().text(path)), {}
    mount = f"warc{uuid.uuid4().hex}"
    linked = reader()
    for i, f in enumerate(zipped):
        linked = linked.option(f"fs.viewfs.mounttable.{mount}.link./{i}", f)
    names = {f"viewfs://{mount}/{i}": f for i, f in enumerate(zipped)}
    ranges, others = _pieces(linked.text(list(names))), [unquote(f) for f in sorted(set(files) - set(zipped))]
    return (ranges.unionByName(_pieces(reader().text(others))) if others else ranges), names


def _pieces(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def read_archives(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row a record (``RECORD``). Payloads are read, checked and digested, not
    returned. Files may have any name; those named ``.warc.gz`` are split like others."""
    ranges, names = byte_ranges(spark, path)
    schema = f"{RECORD}, {PIECE}"
    record, piece = [x.split()[0] for x in RECORD.split(",")], [x.split()[0] for x in PIECE.split(",")]

    def batch(records: list[tuple], lost: list[tuple]) -> pa.RecordBatch:
        rows = [(*r, None, None, None) for r in records] + [(f, *[None] * (len(record) - 1), b, p, x) for f, b, p, x in lost]
        types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        kinds = [types[x.split()[1]] for x in schema.split(",")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [*record, *piece])

    def scan(batches):
        at, members, place = None, Assembler(), 0
        for b in batches:
            records, lost = [], []
            for x, file, block in zip(*[b.column(c) for c in ("piece", "file", "block")]):
                here = (names.get(file.as_py(), file.as_py()), block.as_py())
                if here != at:
                    members.close()
                    lost += [(*at, *m) for m in members.lost] if at else []
                    at, members, place = here, Assembler(), 0
                    if here[1] == 0:  # what stands before a file's first magic
                        if junk := x.as_py():
                            lost.append((*at, -1, junk))
                        continue
                raw = members.feed(place, MAGIC + x.as_py())
                place += 1
                if raw is not None:
                    records.append(parse_record(raw, here[0]))
            lost += [(*at, *m) for m in members.lost]
            members.lost = []
            if records or lost:
                yield batch(records, lost)
        members.close()
        if members.lost:
            yield batch([], [(*at, *m) for m in members.lost])

    def join(pdf):
        import pandas as pd

        members, out = Assembler(), []
        for place, x in enumerate(pdf.sort_values(["block", "place"])["piece"]):
            raw = members.feed(place, bytes(x))
            if raw is not None:
                out.append(parse_record(raw, pdf["file"].iloc[0]))
        members.close()
        out += [(pdf["file"].iloc[0], "damaged", None, None, None, None, len(x), None) for _, x in members.lost]
        return pd.DataFrame(out, columns=record)

    bounded_batches(spark)
    found = written(ranges.mapInArrow(scan, schema), "warc_records")
    whole = found.where(F.col("piece").isNull()).select(*record)
    torn = found.where(F.col("piece").isNotNull()).select("file", *piece)
    return whole.unionByName(torn.groupBy("file").applyInPandas(join, RECORD))


def op10_warc_roundtrip(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    pages = read_archives(spark, path).where(F.col("warc_type").isNull() | (F.col("warc_type") != "warcinfo"))
    return pages.select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to")


def _base32_sql(hex_digits: str) -> str:
    groups = [f"CAST('0x' || substr({hex_digits}, {i}, 5) AS BIGINT)" for i in range(1, 41, 5)]
    return " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((({g} >> {s}) & 31) + 1 AS BIGINT), 1)" for g in groups for s in (15, 10, 5, 0))


OP10_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
last AS (SELECT html, max(page_id) AS page_id FROM p GROUP BY html)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, {_base32_sql("sha1(p.html)")} AS payload_digest,
       CASE WHEN p.page_id IS NOT DISTINCT FROM last.page_id OR last.page_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id IS DISTINCT FROM last.page_id THEN last.page_id END AS refers_to
FROM p JOIN last ON p.html = last.html
"""
