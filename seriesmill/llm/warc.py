"""WARC archives: a writer that records repeated payloads once, and a salvage reader.

Writing: payloads get their SHA-1; of equal payloads of ``MIN_REVISIT`` bytes or
more, the record with the largest page id is the response and the others are
revisits that refer to it, with the profile of equal payload digests. A record's id
is a UUID made of its page id and digest; rows that repeat both share it. Records are
packed, one gzip member each, into archives of about ``ARCHIVE_BYTES``; the archives
are rows (name, content) that Spark's own writer puts into the shared folder, so any
executor can read them. Payloads stay where they are: only digests and page ids are
grouped, and the few digests that repeat are sent to the payloads.

Reading: a member is inflated and its records checked one after another: version
line, headers, length, end mark and payload digest. After a failed check the reader
searches on, within what a member gave (also one that is cut off or broken inside)
for the next version line, and in the archive for the next member or version line,
goes on there, and logs the bytes between as a quarantined gap (start, stop, reason;
a gap inside a member has the member's borders). ``files`` reads archives that lie
in a folder.

Defined cases: a null html is an empty payload; a null page id is never the
response of others; where the largest page id occurs in several rows, all of them
are responses; empty tables give empty archives; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.llm.text import column
from seriesmill.session import checkpointed

MIN_REVISIT, ARCHIVE_BYTES, BROADCAST_DIGESTS = 1000, 8 << 20, 250_000
#: Marks of the format, and the profile of revisits.
VERSION, MEMBER, END = b"WARC/1.1", b"\x1f\x8b\x08", b"\r\n\r\n"
SAME_DIGEST = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.[0-9]\r?\n")
_VERSION_LINE = re.compile(rb"WARC/1\.[0-9]\r?\n")


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes


def pack(headers: dict[str, str], payload: bytes) -> bytes:
    """One record, as a gzip member."""
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers.items()) + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
    return deflate.compress(head + payload + END) + deflate.flush()


def _parse(data: bytes, at: int = 0) -> tuple[Record, int]:
    """The record at ``at`` and where it ends; ValueError names the failed check."""
    if not data.startswith(b"WARC/1.", at):
        raise ValueError("no version line")
    split = data.find(END, at)
    if split < 0:
        raise ValueError("headers do not end")
    headers = {}
    for line in data[at:split].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("broken header")
        headers[name.decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    length = headers.get("Content-Length", "")
    if not length.isascii() or not length.isdigit():
        raise ValueError("no length")
    start, stop = split + 4, split + 4 + int(length)
    if data[stop : stop + 4] != END:
        raise ValueError("no end mark")
    payload = data[start:stop]
    digest = headers.get("WARC-Block-Digest", "").removeprefix("sha1:")
    if digest and digest != hashlib.sha1(payload).hexdigest():
        raise ValueError("payload digest differs")
    return Record(headers, payload), stop + 4


def _inflate(content: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int, str]:
    """What the gzip member at ``at`` gives, where it ends, and what broke it off, or ''.

    It is fed in pieces; after an error, the piece that failed is fed again by halves, to keep what stands before the fault.
    """
    plain, view = [], memoryview(content)
    inflate = zlib.decompressobj(31)
    while not inflate.eof:
        if at >= len(content):
            return b"".join(plain), at, "member is cut off"
        before = inflate.copy() if step > 1 else None
        try:
            plain.append(inflate.decompress(view[at : at + step]))
        except zlib.error as error:
            if step == 1:
                return b"".join(plain), at, str(error)
            inflate, step = before, max(1, step // 16)
            continue
        at += step
    return b"".join(plain), min(at, len(content)) - len(inflate.unused_data), ""


def _records(data: bytes, first: int = 0) -> tuple[list[Record], list[tuple[int, int, str]]]:
    """The records of plain bytes from ``first`` on that pass their checks, and the gaps between them."""
    records: list[Record] = []
    gaps: list[tuple[int, int, str]] = []
    at, bad, reason = first, None, ""
    while at < len(data):
        try:
            record, end = _parse(data, at)
        except ValueError as error:
            if bad is None:
                bad, reason = at, str(error)
            found = _VERSION_LINE.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if bad is not None:
            gaps.append((bad, at, reason))
            bad = None
        records.append(record)
        at = end
    if bad is not None:
        gaps.append((bad, len(data), reason))
    return records, gaps


def salvage(content: bytes) -> tuple[list[Record], list[tuple[int, int, str]]]:
    """All records that pass their checks, and the quarantined gaps between them."""
    records: list[Record] = []
    gaps: list[tuple[int, int, str]] = []
    at, bad, reason = 0, None, ""

    def close(to: int) -> None:
        nonlocal bad
        if bad is not None:
            gaps.append((bad, to, reason))
            bad = None

    while at < len(content):
        broken = ""
        if content.startswith(MEMBER, at):
            plain, end, broken = _inflate(content, at)
            found, inner = _records(plain)
            if found:
                close(at)
                records += found
                if not broken:
                    gaps += [(at, end, why) for _, _, why in inner]
                    at = end
                    continue
                bad, reason = at, broken
            elif not broken and plain:
                broken = inner[0][2]
            elif not broken:
                broken = "empty member"
        else:
            try:
                record, end = _parse(content, at)
            except ValueError as error:
                broken = str(error)
            else:
                close(at)
                records.append(record)
                at = end
                continue
        if bad is None:
            bad, reason = at, broken
        following = _NEXT.search(content, at + 1)
        at = following.start() if following else len(content)
    close(len(content))
    return records, gaps


def planned(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = MIN_REVISIT) -> DataFrame:
    """page_id, payload, its digest and the page it repeats (null for responses).

    Only digests that occur more than once are joined back; few of them are broadcast, so no payload is shuffled.
    """
    rows = pages.select(F.col(key).alias("page_id"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha1("payload"))
    owners = checkpointed(
        rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    owners = F.broadcast(owners) if owners.count() <= BROADCAST_DIGESTS else owners
    return rows.join(owners, "digest", "left").select(
        "page_id", "payload", "digest", F.when(F.col("page_id") == F.col("owner"), None).otherwise(F.col("owner")).alias("refers_to")
    )


def record_id(page, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}>"


def _writer(date: str):
    return lambda batches: _write(batches, date)


def _write(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[pa.RecordBatch]:
    parts: list[bytes] = []
    size = 0

    def archive() -> pa.RecordBatch:
        content = b"".join(parts)
        return pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(content).hexdigest() + ".warc.gz"]), pa.array([content], pa.binary())], names=["name", "content"])

    for batch in batches:
        for page, payload, digest, refers in zip(*(column(batch, c) for c in ("page_id", "payload", "digest", "refers_to")), strict=True):
            body, page, refers = payload.as_py(), page.as_py(), refers.as_py()
            headers = {"WARC-Type": "response" if refers is None else "revisit", "WARC-Record-ID": record_id(page, digest), "WARC-Date": date, "X-Page-ID": "" if page is None else str(page)}
            headers |= {"WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": str(len(body))}
            if refers is not None:
                headers |= {"WARC-Profile": SAME_DIGEST, "WARC-Refers-To": record_id(refers, digest), "X-Refers-To-Page": str(refers)}
                body = b""  # the payload stands in the record it refers to
            headers["WARC-Block-Digest"] = "sha1:" + hashlib.sha1(body).hexdigest()
            parts.append(pack(headers, body))
            size += len(parts[-1])
            if size >= ARCHIVE_BYTES:
                yield archive()
                parts, size = [], 0
    if parts:
        yield archive()


def write(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = MIN_REVISIT, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archives of the pages, as rows (name, content); ``date`` is that of all records, as pages have none."""
    return planned(pages, key, payload, least).mapInArrow(_writer(date), "name string, content binary")


def files(spark: SparkSession, path: str) -> DataFrame:
    """The archives (name, content) of a folder of .warc and .warc.gz files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{warc,warc.gz}").load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


RECORDS = "archive string, page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, gap_start long, gap_stop long, gap_reason string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in RECORDS.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]] for f in RECORDS.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    number = lambda x: int(x) if re.fullmatch(r"-?\d+", x) else None
    for batch in batches:
        for name, content in zip(column(batch, "name"), column(batch, "content"), strict=True):
            records, gaps = salvage(content.as_py())
            rows: list[tuple] = []
            for r in records:
                h = r.headers.get
                rows.append(
                    (name.as_py(), number(h("X-Page-ID", "")), h("WARC-Type"), number(h("X-Refers-To-Page", "")), h("WARC-Payload-Digest", "").removeprefix("sha1:"),
                     int(h("X-Payload-Length", len(r.payload))), r.payload, None, None, None)
                )
            rows += [(name.as_py(), *[None] * 6, *gap) for gap in gaps]
            if rows:
                yield batch_of(rows)


def read(archives: DataFrame) -> DataFrame:
    """Records and gaps of archives (name, content): a row each; gap rows have no record columns."""
    return archives.mapInArrow(_read, RECORDS)
