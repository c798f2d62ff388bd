"""WARC archives: a writer that deduplicates payloads, and a salvage reader.

Writing. Each page is a record, a gzip member of its own. Of pages with equal payloads (by
SHA-1 and size) the least page_id is a response and the others are revisit records without
the payload. Spark's text writer puts the members into files on any file system it knows:
a member's last byte is the high byte of its length, which is 0 (a longer member is
followed by an empty one), and that 0 is written as the "line end".

Reading. A file is read member by member. Where a member doesn't decompress to its end with the
right checksum, or a record's header, length or digest is wrong, the reader searches for the next
place at which a valid member (or, in plain files, a version line with a valid record) starts,
goes on there, and logs the bytes in between as quarantined with the reason. In a member of
several records the reader goes on at the next version line with a valid record, gives those records
with the member's place, and logs the rest as gaps of that place. Of a member that itself fails (cut, or with
a wrong checksum) what was inflated is read so too, if it holds more than one version line; records
without a digest aren't given then, as nothing proves them. A member of one record stands or falls with its checksum.

Files are cut by bytes (``file_bytes`` and one record more at most), as a reader holds one file at a time. Archives of
others are read as Spark's binary files, of 2 GB at most each.

Cases: null html is an empty payload, null url an empty one; a null page_id is written as such and
read back as null, any other (numbers, strings, times) as its text; rows that repeat a page_id with the same payload are all responses if it is the
least of the payload; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, slices, stored

VERSION, EMPTY_MEMBER = b"WARC/1.1\r\n", bytes.fromhex("1f8b08000000000000030300" + "00" * 8)
MAGIC = b"\x1f\x8b\x08"
MOST_PLAIN = 1 << 24
#: Bytes that the decompressor is fed at a time.
STEP = 1 << 14
DATE = b"2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def line(value: str | None) -> bytes:
    """A header's value: control characters and spaces would end it or be trimmed, so they and % are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", value or "").encode("utf-8", "surrogatepass")


def unline(value: bytes) -> str:
    return re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), value).decode("utf-8", "replace")


def record(kind: str, page_id, url: str | None, payload: bytes, size: int, sha1: str, refers_to) -> bytes:
    """One record. A revisit has the HTTP header alone; size and digest are those of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload if kind == "response" else b"")
    name = lambda x: b"<urn:null>" if x is None else b"<urn:page:%s>" % line(str(x))
    head = [
        (b"WARC-Type", kind.encode()),
        (b"WARC-Record-ID", name(page_id)),
        (b"WARC-Date", DATE),
        (b"WARC-Target-URI", line(url)),
        (b"Content-Type", b"application/http; msgtype=response"),
        (b"WARC-Payload-Digest", b"sha1:" + sha1.encode()),
        (b"WARC-Block-Digest", b"sha1:" + digest(block).encode()),
    ]
    if kind == "revisit":
        head += [(b"WARC-Refers-To", name(refers_to)), (b"WARC-Profile", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head.append((b"Content-Length", b"%d" % len(block)))
    return VERSION + b"".join(k + b": " + v + b"\r\n" for k, v in head) + b"\r\n" + block + b"\r\n\r\n"


def member(plain: bytes) -> bytes:
    z = zlib.compressobj(6, wbits=31)
    out = z.compress(plain) + z.flush()
    return out if len(plain) < MOST_PLAIN else out + EMPTY_MEMBER


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, size, sha1, refers_to (null: a response)."""
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.octet_length(raw).cast("long").alias("size"), F.unhex(F.sha1(raw)).alias("sha1"))
    # payloads that stand more than once and are large enough; each row is reduced before the exchange
    shared = rows.where(F.col("size") >= least_bytes).groupBy("sha1", "size").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1").select("sha1", "size", "first")
    shared = stored(shared, "payloads")
    return rows.join(shared, ["sha1", "size"], "left").select("page_id", "url", "html", "size", "sha1", F.when(F.col("first") < F.col("page_id"), F.col("first")).when(F.col("page_id").isNull(), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, file_bytes: int = 64 << 20) -> None:
    """Writes pages (page_id, url, html) as files of gzip members under ``path``. A task begins a new file once one has ``file_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = 0, 0
        for b in slices(batches, 64):
            out, parts = [], []
            for page_id, url, html, size, sha1, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                kind = "response" if refers is None else "revisit"
                if held >= file_bytes:
                    part, held = part + 1, 0
                out.append(member(record(kind, page_id, url, payload, size, base64.b32encode(sha1).decode(), refers))[:-1])
                parts.append(part)
                held += len(out[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(out, pa.binary())], ["part", "value"])

    plan = plan_records(pages, least_bytes).select("page_id", "url", "html", "size", "sha1", "refers_to")
    found = plan.mapInArrow(run, "part int, value binary").select("part", F.col("value").cast("string").alias("value"))
    found.write.option("lineSep", "\x00").partitionBy("part").text(path)


class Bad(Exception):
    #: What a failed member inflated to before it failed.
    plain = b""


def parse_record(plain: bytes, at: int = 0, proven: bool = False) -> tuple[dict[str, bytes], bytes, int]:
    """Headers, block and end of the record at ``at``; Bad says what is wrong. proven: without a digest it's wrong."""
    if not plain.startswith(b"WARC/1.", at):
        raise Bad("no version line")
    end = plain.find(b"\r\n\r\n", at)
    if end < 0:
        raise Bad("header doesn't end")
    head = {}
    for x in plain[at:end].split(b"\r\n")[1:]:
        k, colon, v = x.partition(b":")
        if not colon:
            raise Bad("bad header line")
        head[k.strip().lower().decode("latin-1")] = v.strip()
    if not re.fullmatch(rb"\d{1,18}", size := head.get("content-length", b"")):
        raise Bad("bad length")
    start = end + 4
    stop = start + int(size)
    if plain[stop : stop + 4] != b"\r\n\r\n":
        raise Bad("record doesn't end where its length says")
    block = plain[start:stop]
    if proven and not (head.get("warc-block-digest") or head.get("warc-type") == b"response" and head.get("warc-payload-digest", b"").startswith(b"sha1:")):
        raise Bad("no digest proves the record")
    if (want := head.get("warc-block-digest")) and want != b"sha1:" + digest(block).encode():
        raise Bad("block digest differs")
    if head.get("warc-type") == b"response" and (want := head.get("warc-payload-digest", b"")).startswith(b"sha1:"):
        if want != b"sha1:" + digest(block.partition(b"\r\n\r\n")[2]).encode():
            raise Bad("payload digest differs")
    return head, block, stop + 4


def inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """A gzip member at ``at`` and where it ends. It is fed in steps, so what follows it isn't copied."""
    z, view, out, first = zlib.decompressobj(wbits=31), memoryview(data), [], at
    while not z.eof:
        if at >= len(data):
            bad = Bad("member doesn't end")
            bad.plain = b"".join(out)
            raise bad
        try:
            out.append(z.decompress(view[at : at + STEP]))
        except zlib.error as e:
            bad = Bad(f"member: {str(e)[:80]}")
            bad.plain = _before_failure(view, first, at)
            raise bad from None
        at = min(at + STEP, len(data))
    return b"".join(out), at - len(z.unused_data)


def _before_failure(view: memoryview, first: int, at: int) -> bytes:
    """What a member at ``first`` inflates to before it fails in the step at ``at``: that step is fed byte by byte."""
    z = zlib.decompressobj(wbits=31)
    out = [z.decompress(view[first:at])]
    with contextlib.suppress(zlib.error):
        for i in range(at, min(at + STEP, len(view))):
            out.append(z.decompress(view[i : i + 1]))
    return b"".join(out)


def _inside(plain: bytes, proven: bool) -> tuple[list[tuple[dict[str, bytes], bytes]], list[str]]:
    """The valid records of a member's content, and what is wrong with the bytes between them."""
    records, gaps, at, gap, reason = [], [], 0, None, ""
    while at < len(plain):
        try:
            head, block, end = parse_record(plain, at, proven)
        except Bad as e:
            if gap is None:
                gap, reason = at, str(e)
            place = plain.find(b"WARC/1.", at + 1)
            end = place if place >= 0 else len(plain)
        else:
            if gap is not None:
                gaps.append(f"{reason} (bytes {gap} to {at} of the member's content)")
                gap = None
            records.append((head, block))
        at = end
    if gap is not None:
        gaps.append(f"{reason} (bytes {gap} to {at} of the member's content)")
    return records, gaps


def _records_of(plain: bytes) -> list[tuple[dict[str, bytes], bytes]]:
    out, at = [], 0
    while at < len(plain):
        head, block, at = parse_record(plain, at)
        out.append((head, block))
    return out


def _unit(data: bytes, at: int) -> tuple[list, list[str], int]:
    """Records at ``at``, what is wrong between them, and where they end."""
    if data.startswith(MAGIC, at):
        plain, end = inflate(data, at)
        try:
            return _records_of(plain), [], end
        except Bad:
            records, gaps = _inside(plain, False)
            if not records:
                raise
            return records, gaps, end
    head, block, end = parse_record(data, at)
    return [(head, block)], [], end


def salvage(data: bytes) -> Iterator[tuple]:
    """("record", start, end, headers, block) and ("gap", start, end, reason, None), in order; they cover the file.

    Records and gaps of one damaged member all have its start and end; a failed member ends where the next valid one starts.
    """
    at, gap, reasons, held = 0, None, [], []
    places = dict.fromkeys((MAGIC, b"WARC/1."), -1)  # the next of each; searched for again only once it is passed
    while at < len(data):
        try:
            records, wrong, end = _unit(data, at)
            known = gap is not None and held and not data.startswith(MAGIC, at) and records[0] in held  # a failed member's stored bytes
        except Bad as e:
            several, known = ([], []) if e.plain.count(b"WARC/1.") < 2 else _inside(e.plain, True), True
            if gap is not None and several[0] and any(x not in held for x in several[0]):
                yield from _damaged(gap, at, held, reasons)
                gap = None
            if gap is None:
                gap, held, reasons = at, several[0], [str(e), *several[1]]
        if known:
            for mark, place in places.items():
                if place <= at:
                    place = data.find(mark, at + 1)
                    places[mark] = place if place >= 0 else len(data)
            at = min(places.values())
            continue
        if gap is not None:
            yield from _damaged(gap, at, held, reasons)
            gap = None
        yield from _damaged(at, end, records, wrong)
        at = end
    if gap is not None:
        yield from _damaged(gap, len(data), held, reasons)


def _damaged(start: int, end: int, records: list, reasons: list[str]) -> Iterator[tuple]:
    for head, block in records:
        yield "record", start, end, head, block
    if reasons and not records:  # nothing of it is good
        reasons = reasons[:1]
    for x in reasons:
        yield "gap", start, end, x, None


def _page(x: bytes | None) -> str | None:
    m = re.fullmatch(rb"<urn:page:(.*)>", x or b"", re.DOTALL)
    return unline(m[1]) if m else None


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Rows of kind "record" (page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest) and "gap" (reason), with file, start and end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column("path"), b.column("content"), strict=True):  # a file at a time
                rows, held = [], 0
                for kind, start, end, x, block in salvage(data.as_py()):
                    if kind == "gap":
                        rows.append((kind, file.as_py(), start, end, x, *[None] * 7))
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    what = x.get("warc-type", b"").decode("latin-1")
                    if what == "response":
                        size, sha1 = len(payload), digest(payload)
                    else:  # the full payload is elsewhere; the record tells its size and digest
                        m = re.search(rb"(?i)content-length: *(\d+)", http)
                        size, sha1 = int(m[1]) if m else None, x.get("warc-payload-digest", b"").decode("latin-1").removeprefix("sha1:")
                    url = unline(x.get("warc-target-uri", b""))
                    rows.append((kind, file.as_py(), start, end, None, _page(x.get("warc-record-id")), url, what, _page(x.get("warc-refers-to")), payload if payloads else None, size, sha1))
                    held += len(payload)
                    if held > 1 << 22:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    schema = "kind string, file string, start long, end long, reason string, page_id string, url string, record_type string, refers_to string, payload binary, payload_bytes long, payload_digest string"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


KINDS = {"kind": pa.string(), "file": pa.string(), "start": pa.int64(), "end": pa.int64(), "reason": pa.string(), "page_id": pa.string(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, KINDS.values(), strict=True)], list(KINDS))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType
    path = fresh_path(spark, "warc")
    write_archives(pages, path, least_bytes)
    found = read_archives(spark, path, payloads=False).where("kind = 'record'")
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
