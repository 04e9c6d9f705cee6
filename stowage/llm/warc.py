"""WARC archives: a deduplicating writer and a reader that salvages what damage leaves."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.session import cut_lineage

#: Payloads below this are stored every time.
REVISIT_BYTES = 100
#: A file ends after the record that reaches this: the reader holds one file in a task.
FILE_BYTES = 16 << 20
DATE = "1970-01-01T00:00:00Z"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
CONTROL = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f]")
TYPES = {"warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation"}
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record(page_id, url, payload: str, digest: str, first) -> str:
    """One record without its closing blank lines; ``first`` is the page whose payload it repeats, None for a response."""
    size = len(payload.encode("utf-8", "surrogatepass"))
    body = "" if first is not None else HTTP.decode() + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}",
    ]
    if url:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if first is not None:
        head += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {PROFILE}"]
    else:
        head.append("Content-Type: application/http; msgtype=response")
    length = len(HTTP) + size if first is None else 0
    return "\r\n".join([*head, f"Content-Length: {length}", "", body])


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Write pages (page_id, url, html) as WARC files below ``folder``, in parts of about ``file_bytes``.

    Of equal payloads of at least ``revisit_bytes`` the smallest page_id is the response and others revisit it; rows that
    repeat that id are responses too, and rows without an id only where no row of the payload has one. A null html is an
    empty payload. Payloads move to another task only if the digests that occur more than once do not fit a broadcast.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"), F.sha2(payload, 256).alias("digest"))
    firsts = cut_lineage(
        rows.filter(F.octet_length("html") >= revisit_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "firsts",
    )  # written first, so that its size decides whether payloads have to move
    marked = rows.join(firsts, "digest", "left").withColumn(
        "first", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    )

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = size = 0
        for batch in batches:
            out = []
            ids, firsts_ = batch["page_id"].astype("Int64"), batch["first"].astype("Int64")
            for page, known, url, html, digest, first, again in zip(
                    ids.fillna(0), ids.notna(), batch["url"], batch["html"], batch["digest"], firsts_.fillna(0), firsts_.notna()):
                value = record(int(page) if known else None, url, html, digest, int(first) if again else None)
                out.append((part, value))
                size += len(value)
                if size >= file_bytes:
                    part, size = part + 1, 0
            yield pd.DataFrame(out, columns=["part", "value"])

    (
        marked.select("page_id", "url", "html", "digest", "first").mapInPandas(build, "part int, value string")
        .write.partitionBy("part").option("lineSep", END.decode()).text(folder)
    )

MAGIC = b"\x1f\x8b\x08"
#: Where a member or a record may start.
START = re.compile(re.escape(MAGIC) + b"|" + VERSION.pattern)
#: Members are unzipped by pieces of so many bytes.
PIECE = 1 << 16


@dataclass
class Gap:
    """Bytes that no valid record accounts for."""

    start: int
    end: int
    reason: str


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(END)[2] if self.headers.get("content-type", "").startswith("application/http") else self.block


def parse_record(data: bytes, at: int) -> Record | str:
    """The record at an offset, or why there is none: version line, headers, length, closing lines and digest must hold."""
    if not VERSION.match(data, at):
        return "no version line"
    head_end = data.find(END, at)
    if head_end < 0 or VERSION.search(data, at + 1, head_end):
        return "headers do not end"
    if CONTROL.search(data, at, head_end):
        return "bad header line"
    headers = {}
    for line in data[at:head_end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "bad header line"
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if headers.get("warc-type") not in TYPES or "warc-record-id" not in headers:
        return "no record type or id"
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return "bad content length"
    start = head_end + len(END)
    end = start + int(length)
    if end > len(data):
        return "cut short"
    if data[end:end + len(END)] != END:
        return "record does not end where its length says"
    found = Record(at, end + len(END), headers, data[start:end])
    kind, _, digest = headers.get("warc-payload-digest", "").partition(":")
    if headers["warc-type"] != "revisit" and kind == "sha256" and hashlib.sha256(found.payload).hexdigest() != digest:
        return "payload digest differs"
    return found


def _unzipped(data: memoryview, at: int) -> tuple[bytes, int | None, str]:
    """Content of the gzip member at an offset, its end, and what is wrong with it. A failed member has no end, but what came out
    of it before the failure is kept."""
    unzip, out, start = zlib.decompressobj(31), [], at
    while not unzip.eof:
        piece = data[at:at + PIECE]
        if not len(piece):
            return b"".join(out), None, "member cut short"
        before = unzip.copy()
        try:
            out.append(unzip.decompress(piece))
        except zlib.error as error:
            for i in range(len(piece)):  # again byte by byte, up to the one that fails
                try:
                    out.append(before.decompress(piece[i:i + 1]))
                except zlib.error:
                    break
            return b"".join(out), None, f"bad member: {error}"
        at += len(piece)
    return b"".join(out), max(start + 1, at - len(unzip.unused_data)), ""


def _found(data: bytes, at: int) -> tuple[list[Record | Gap], int | None, str]:
    """What starts at an offset, where it ends if it is whole, and what is wrong with it."""
    if data[at:at + len(MAGIC)] != MAGIC:
        record = parse_record(data, at)
        return ([], None, record) if isinstance(record, str) else ([record], record.end, "")
    content, end, fault = _unzipped(memoryview(data), at)
    parts = list(salvage(content))
    if end is None:
        # They lie at the start of the member and account for none of its bytes.
        return [Record(at, at, p.headers, p.block) for p in parts if isinstance(p, Record)], None, fault
    if not any(isinstance(p, Record) for p in parts) and content:
        return [], None, "member without a record"
    return [Gap(at, end, p.reason) if isinstance(p, Gap) else Record(at, end, p.headers, p.block) for p in parts], end, ""


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Records in order, of an archive that is plain, made of gzip members, or both.

    After a failed check the search goes on at the nearer of the next member and the next version line, until one of
    them is whole; the bytes up to it are a gap. A member that fails late still gives the records that came out of it, and a member may
    hold several. Offsets of records in members are those of the member.
    """
    at = 0
    while at < len(data):
        parts, end, reason = _found(data, at)
        yield from parts
        if end is not None:
            at = end
            continue
        start = at
        while end is None:
            mark = START.search(data, at + 1)
            if mark is None:
                yield Gap(start, len(data), reason)
                return
            at = mark.start()
            parts, end, fault = _found(data, at)
            if parts and end is None:  # the gap so far, then what this member has given up
                yield Gap(start, at, reason)
                start, reason = at, fault
                yield from parts
        yield Gap(start, at, reason)
        yield from parts
        at = end


ROWS = (
    "path string, start bigint, end bigint, gap string, record_type string, record_id string, refers_to string, url string, "
    "declared_digest string, payload_bytes bigint, payload_digest string, payload binary"
)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record, and one per quarantined gap (``gap`` says why, other fields are null but the place).

    A task holds one file. For revisits length and digest are those declared for the payload they refer to; for others
    they are computed from the bytes read. Files may be plain or made of gzip members; empty files give no row.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                out = []
                for r in salvage(bytes(data)):
                    if isinstance(r, Gap):
                        out.append((path, r.start, r.end, r.reason, *[None] * 8))
                        continue
                    h, kind = r.headers, r.headers.get("warc-type")
                    declared = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    if kind == "revisit":
                        size, digest, body = int(h["x-payload-length"]) if h.get("x-payload-length", "").isdigit() else None, declared, None
                    else:
                        body = r.payload
                        size, digest = len(body), hashlib.sha256(body).hexdigest()
                    out.append((path, r.start, r.end, None, kind, h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"),
                                declared, size, digest, body if payloads else None))
                frame = pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")], dtype=object)
                for at in range(0, len(frame), 1000):
                    yield frame.iloc[at:at + 1000]

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder)
    return files.select("path", "content").mapInPandas(read, ROWS)


def gaps(rows: DataFrame) -> DataFrame:
    """The log of quarantined byte ranges."""
    return rows.filter("gap IS NOT NULL").select("path", "start", "end", F.col("gap").alias("reason"))


def page_of(column: str):
    return F.regexp_extract(column, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")


def archived_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Write the pages, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to. Damage in between is an error;
    :func:`read_archives` is what reads damaged archives."""
    write_archives(pages, folder)
    rows = read_archives(pages.sparkSession, folder, payloads=False)
    lost = F.raise_error(F.concat_ws(" ", F.lit("bytes without a record:"), "path", F.col("start").cast("string"), F.col("end").cast("string"), "gap"))
    rows = rows.filter(F.when(F.col("gap").isNotNull(), lost.cast("boolean")).otherwise(True))
    return rows.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"))
