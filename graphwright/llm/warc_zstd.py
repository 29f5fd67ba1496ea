"""WARC archives compressed with Zstandard: writer, and reader with validation.

An archive is a file of frames.  The first is a skippable frame (magic number
0x184D2A5D) that holds the dictionary of the archive; then follows one Zstandard frame
for each WARC record, with content size and checksum; other skippable frames mean
nothing.  The dictionary frame may be missing, and its content may itself be a
Zstandard frame.

**Writer.**  Payloads are known by SHA-256.  Of equal ones of at least ``MIN_REVISIT``
bytes the record of the smallest id is a ``response``, the others are ``revisit``
records (profile identical-payload-digest) that hold the HTTP header alone.  The
dictionary is trained on about ``SAMPLE`` rows with the smallest hashes, twice as many at
most, whose payloads have at most ``SAMPLE_BYTES`` bytes; it only affects the size.  A task packs records into
archives of about ``ARCHIVE_BYTES`` before compression, one record at least.  Each archive is one
row, one file of Spark's text writer with its commit protocol, so a lost executor
leaves no partial file, in any file system; the writer's line end is an empty skippable
frame.

**Reader.**  Spark reads the files as binary; a task walks the frames by their headers
and block sizes, decodes one frame at a time with the archive's dictionary, and checks
it: a whole frame with nothing left over, version line, mandatory headers, unique
header names, ``Content-Length`` against the block, the record's two closing line ends,
HTTP ``Content-Length`` and SHA-256 against the payload, a revisit's profile and target.
A record that fails is a row with an ``error`` and no payload; a frame that is cut off or is no frame ends
its archive with such a row, as nothing after it can be found.

Rows: a null payload is empty.  A null id sorts last and is written as ``null``; if no
row of a payload has an id, all are responses.  Rows that repeat the smallest id of a
payload are all responses.  Line ends and other control characters of a URL are
percent-encoded; a null URL has no header.  An empty table gives no archives and
no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialise, slices

MIN_REVISIT = 100
ARCHIVE_BYTES = 16 << 20
SAMPLE, SAMPLE_BYTES, DICT_BYTES = 1000, 32 << 10, 64 << 10
# a payload held by more than one in so many of the rows that have copies is looked up by broadcast
HOT_SHARE = 4096
# Magic numbers and profile of the formats.
FRAME, SKIPPABLE, DICT_FRAME = 0xFD2FB528, 0x184D2A50, 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
EMPTY_FRAME = SKIPPABLE.to_bytes(4, "little") + bytes(4)
DATE = "1970-01-01T00:00:00Z"
RECORDS = ("archive string, offset long, page_id long, record_type string, url string, refers_to long, payload_bytes long, "
           "payload_digest string, payload binary, error string")


# -- records ------------------------------------------------------------------

def _skippable(magic: int, body: bytes) -> bytes:
    return magic.to_bytes(4, "little") + len(body).to_bytes(4, "little") + body


def _urn(page_id) -> str:
    return f"<urn:page-id:{'null' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, n_bytes: int, digest: str, refers_to, date: str) -> bytes:
    """One WARC record; a revisit if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}",
            f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        key = name.decode("ascii", "replace").lower()
        if not colon or not re.fullmatch(r"[!#-'*+.^-z|~0-9A-Z-]+", key):
            raise ValueError(f"not a header: {line[:40]!r}")
        if key in out:
            raise ValueError(f"header twice: {key}")
        out[key] = value.decode("utf-8").strip()
    return out


def _length(headers: dict[str, str], what: str) -> int:
    value = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", value):
        raise ValueError(f"{what}: bad Content-Length {value!r}")
    return int(value)


def _page_id(urn: str) -> int | None:
    found = re.fullmatch(r"<urn:page-id:(null|-?[0-9]+)>", urn)
    if not found:
        raise ValueError(f"not a record id: {urn[:60]!r}")
    return None if found[1] == "null" else int(found[1])


def parse(data: bytes) -> dict:
    """The fields of one record; ValueError if it breaks a rule."""
    head, end, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not end or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC header")
    h = _headers(lines)
    missing = [k for k in MANDATORY if not h.get(k)]
    if missing:
        raise ValueError("no " + ", ".join(missing))
    if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?Z", h["warc-date"]):
        raise ValueError("bad WARC-Date")
    n = _length(h, "record")
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {n}, but {len(rest) - 4} bytes")
    if h["warc-type"] not in ("response", "revisit"):
        raise ValueError(f"record of type {h['warc-type']!r}")
    http, end, payload = rest[:n].partition(b"\r\n\r\n")
    status, *lines = http.split(b"\r\n")
    if not end or not re.match(rb"HTTP/\d\.\d \d{3}( |$)", status):
        raise ValueError("no HTTP header")
    n_bytes = _length(_headers(lines), "HTTP")
    digest = h.get("warc-payload-digest", "")
    if not re.fullmatch(r"sha256:[0-9a-f]{64}", digest):
        raise ValueError("no SHA-256 of the payload")
    out = {"page_id": _page_id(h["warc-record-id"]), "record_type": h["warc-type"], "url": h.get("warc-target-uri"),
           "refers_to": None, "payload_bytes": n_bytes, "payload_digest": digest[7:], "payload": None}
    if h["warc-type"] == "revisit":
        if payload or h.get("warc-profile") != PROFILE:
            raise ValueError("a revisit with a payload or of another profile")
        out["refers_to"] = _page_id(h.get("warc-refers-to", ""))
    else:
        if len(payload) != n_bytes:
            raise ValueError(f"HTTP Content-Length {n_bytes}, but {len(payload)} bytes")
        if hashlib.sha256(payload).hexdigest() != digest[7:]:
            raise ValueError("payload differs from its digest")
        out["payload"] = payload
    return out


# -- frames -------------------------------------------------------------------

def frame_end(data: memoryview, at: int) -> int:
    """End of the frame that starts at ``at``; ValueError if it is cut off or none."""
    if at + 8 > len(data):
        raise ValueError("frame cut off")
    magic = int.from_bytes(data[at:at + 4], "little")
    if magic & 0xFFFFFFF0 == SKIPPABLE:
        end = at + 8 + int.from_bytes(data[at + 4:at + 8], "little")
    elif magic == FRAME:
        flags = data[at + 4]
        single, checksum = flags >> 5 & 1, flags >> 2 & 1
        size_bytes = (single, 2, 4, 8)[flags >> 6]
        end = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + size_bytes
        last = 0
        while not last:
            block = data[end:end + 3]
            if len(block) < 3:
                raise ValueError("frame cut off")
            block = int.from_bytes(block, "little")
            last, kind = block & 1, block >> 1 & 3
            if kind == 3:
                raise ValueError("reserved block")
            end += 3 + (1 if kind == 1 else block >> 3)
        end += 4 * checksum
    else:
        raise ValueError("not a frame")
    if end > len(data):
        raise ValueError("frame cut off")
    return end


def read_archive(data: bytes) -> Iterator[tuple[int, dict]]:
    """(offset, fields or ``{"error": ...}``) of every record of an archive."""
    view, at = memoryview(data), 0
    reader = zstandard.ZstdDecompressor()
    while at < len(view):
        try:
            end = frame_end(view, at)
        except ValueError as e:
            yield at, {"error": str(e)}
            return
        magic = int.from_bytes(view[at:at + 4], "little")
        if magic == FRAME:
            try:
                size = zstandard.frame_content_size(view[at:end])
                if size < 0:
                    raise ValueError("frame without content size")
                content = reader.decompress(view[at:end], max_output_size=size)
                if len(content) != size:
                    raise ValueError("frame of another size")
                yield at, parse(content)
            except (ValueError, zstandard.ZstdError) as e:
                yield at, {"error": str(e)}
        elif at == 0 and magic == DICT_FRAME:
            raw = bytes(view[8:end])
            if raw[:4] == FRAME.to_bytes(4, "little"):
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        at = end


# -- tables -------------------------------------------------------------------

def mark_revisits(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, n_bytes, digest, refers_to`` of every row."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
                        F.octet_length(payload).cast("bigint").alias("n_bytes"), F.sha2(payload, 256).alias("digest"))
    copied = materialise(rows.where(F.col("n_bytes") >= MIN_REVISIT).groupBy("digest")
                         .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
                         .where("n > 1 AND first_id IS NOT NULL"), "warc-copied")
    # at most HOT_SHARE payloads hold that share of the copied rows, so this side is bounded
    least = (copied.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE
    hot = copied.where(F.col("n") > least).select("digest", F.col("first_id").alias("hot_id")) if least > 1 else copied.limit(0).select("digest", F.col("first_id").alias("hot_id"))
    rest = copied.where(F.col("n") <= least) if least > 1 else copied
    rows = rows.join(F.broadcast(hot), "digest", "left")
    # rows that are looked up already get keys of their own, so they spread
    key = F.when(F.col("hot_id").isNull(), F.col("digest")).otherwise(F.concat("digest", F.lit("/"), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    rows = rows.withColumn("key", key).join(rest.select(F.col("digest").alias("key"), "first_id"), "key", "left")
    first = F.coalesce("hot_id", "first_id")
    return rows.select("page_id", "url", "payload", "n_bytes", "digest",
                       F.when(F.col("page_id").isNull() | (F.col("page_id") != first), first).alias("refers_to"))


def train_dictionary(pages: DataFrame) -> bytes:
    """Dictionary from a bounded sample, trained in one task; empty if the sample is too
    small for one."""
    rows = pages.count()
    payload = F.col("html").cast("binary")
    sample = pages.select(payload.alias("payload"), F.xxhash64("page_id", "html").alias("h"))
    if rows > SAMPLE:  # as many rows by their hash, so no task reads more than its share
        sample = sample.where(F.col("h") < -(1 << 63) + (SAMPLE << 64) // rows)
    sample = sample.where((F.octet_length("payload") > 0) & (F.octet_length("payload") <= SAMPLE_BYTES)).limit(2 * SAMPLE)

    def train(batches):
        samples = [x for b in batches for x in b.column(0).to_pylist()]
        try:
            size = min(DICT_BYTES, sum(map(len, samples)) // 8)
            found = zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 8 and size >= 1024 else b""
        except zstandard.ZstdError:
            found = b""
        yield pa.RecordBatch.from_arrays([pa.array([found], pa.binary())], ["dictionary"])

    rows = sample.select("payload").coalesce(1).mapInArrow(train, "dictionary binary").collect()
    return max((bytes(r[0]) for r in rows), default=b"", key=len)


def write(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> None:
    """Write ``page_id, url, html`` as archives under ``path``."""
    sc = pages.sparkSession.sparkContext
    shared = sc.broadcast(train_dictionary(pages))

    def pack(batches):
        head, options = b"", {}
        if shared.value:
            head = _skippable(DICT_FRAME, shared.value)
            options["dict_data"] = zstandard.ZstdCompressionDict(shared.value)
        packer = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True, **options)
        parts, size = [head], 0
        for batch in slices(batches, 2, archive_bytes):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                data = record(*row, date)
                parts.append(packer.compress(data))
                size += len(data)
                if size >= archive_bytes:
                    yield _row(parts)
                    parts, size = [head], 0
        if size:
            yield _row(parts)

    # one archive is one row, and one row is one file
    archives = mark_revisits(pages).mapInArrow(pack, "archive binary")
    (archives.select(F.col("archive").cast("string").alias("value")).write
     .option("maxRecordsPerFile", 1).option("lineSep", EMPTY_FRAME.decode("ascii")).option("compression", "none").text(path))


def _row(parts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["archive"])


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under ``path`` (columns as in ``RECORDS``); without
    ``payloads`` the payload is checked and left out."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def records(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name, rows, size = batch.column(0)[i].as_py(), [], 0
                for offset, fields in read_archive(batch.column(1)[i].as_py()):
                    body = fields.pop("payload", None)
                    size += len(body or b"")
                    rows.append({"archive": name, "offset": offset, **fields, "payload": body if payloads else None})
                    if len(rows) >= 1000 or payloads and size >= 8 << 20:
                        yield _records(rows)
                        rows, size = [], 0
                if rows:
                    yield _records(rows)

    return files.mapInArrow(records, RECORDS)


_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _records(rows: list[dict]) -> pa.RecordBatch:
    fields = [f.split() for f in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _TYPES[t]) for n, t in fields], [n for n, _ in fields])


def valid(records: DataFrame) -> DataFrame:
    """The records, none with an error: the first one found ends the job."""
    fault = F.concat_ws(" ", F.lit("archive"), "archive", F.lit("at"), F.col("offset").cast("string"), F.lit(":"), "error")
    return records.where(F.when(F.col("error").isNull(), F.lit(True)).otherwise(F.raise_error(fault).cast("boolean"))).drop("error")


# The same from the pages.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""
