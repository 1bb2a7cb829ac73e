"""WARC archives with revisit resolution.

Pages become WARC response records. A task packs its records into archives: one
gzip member a record, a warcinfo record first, and a new archive once the old one
holds ``FILE_BYTES``, so a row of packed bytes is bounded and Spark's text writer
puts each into a file of its own. Archives are read back record by record, whether
this module wrote them or another tool did (any headers, compressed or not).

To resolve revisits only headers are shuffled: among responses with equal payload
digests the one of the smallest page becomes the original, and every record learns
it in a join (one hot digest is one row after the partial aggregation; AQE splits
it in the join). The digest is the one of the payload that was read: what a response
declares is checked, never trusted, and one whose declared digest is another's (it
isn't intact) stays a response and is nobody's original. Records, still compressed,
then meet their verdicts and are packed anew: each payload once, revisit records
without one, and fresh headers and record ids throughout. A revisit that was there
before never turns into a response, as it has no payload: it refers to the original
of its digest (in base 32 of either case or hexadecimal; by another algorithm than
SHA-1 if an intact response declares the same), or, where no response has that
digest, stays as it was. So deduplicating twice changes nothing but ids.

Defined results: null html is an empty payload; null urls are empty; rows that
repeat a page id are records of their own, the first in file order counting as
smaller; null page ids come last; records without a page id (of other tools) come
after those with one, in file order; one without a digest gets that of its payload;
records of other types (request, metadata, ...) are copied, warcinfo records are
replaced; an archive that breaks off or holds other bytes gives its good records and
a row of type "error" for what can't be read (it isn't copied); an empty table gives no archives, and no archives give no rows; a very
long page is an archive of its own (a record of another tool's archive may be as
long as one Spark cell, 2 GB); other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.common import forget, keep, new_path

#: Compressed bytes after which an archive is closed, gzip level (the fastest takes half the time for a twentieth more bytes).
FILE_BYTES, LEVEL = 8_000_000, 4
#: Bytes of one gzip member at most: under 2^24 the last byte of a member, the high byte of its length, is zero (see _write).
MEMBER = (1 << 24) - 1
#: Records, and about how many bytes of payloads, that a task hands on at a time.
BATCH_RECORDS, BATCH_BYTES = 500, 16_000_000
#: Bytes that are unpacked at a time where the end of a member isn't known.
CHUNK = 16_384
#: Date of the records, profile of a revisit, HTTP head of the blocks, digests' algorithms and bytes, base-32 alphabet.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
SIZES = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

READ = pa.schema([
    ("file", pa.string()), ("number", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("intact", pa.bool_()), ("declared", pa.string()), ("error", pa.string()),
])
SLICED = pa.schema([("path", pa.string()), ("number", pa.int64()), ("payload", pa.binary())])
READ_DDL = "file string, number long, page_id long, url string, record_id string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary, intact boolean, declared string, error string"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def normal_digest(declared: str) -> str | None:
    """A declared digest as algorithm:hexadecimal, whichever case and base (16, 32, 64) it is written in; null where it can't be understood."""
    name, _, value = declared.strip().rpartition(":")
    name, value = (name or "sha1").lower().replace("-", ""), value.strip()
    if name not in SIZES:
        return None
    plain = value.rstrip("=")
    for decode, padded in ((bytes.fromhex, value), (base64.b32decode, plain.upper() + "=" * (-len(plain) % 8)), (base64.b64decode, plain + "=" * (-len(plain) % 4))):
        try:
            raw = decode(padded)
        except ValueError:
            continue
        if len(raw) == SIZES[name]:
            return f"{name}:{raw.hex()}"
    return None


def record_id(*parts) -> str:
    """A record id made from what it stands for: the archive folder, and the place in it or in its source."""
    h = hashlib.md5(repr(parts).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _clean(value: str) -> str:
    """A header value: no line ends."""
    return " ".join(value.splitlines()) if "\n" in value or "\r" in value else value


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{name}: {_clean(value)}" for name, value in headers if value is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _label(digest: str) -> str | None:
    """A digest as a header has it: SHA-1 unless it says otherwise."""
    return (digest if ":" in digest else f"sha1:{digest}") if digest else None


def response(own: str, url: str, digest: str, page: int | None, block: bytes, date: str = DATE) -> bytes:
    return record([
        ("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", _label(digest)),
        ("X-Page-Id", None if page is None else str(page)), ("Content-Type", "application/http; msgtype=response"),
    ], block)


def revisit(own: str, url: str, digest: str, size: int, page: int | None, head: bytes, first: dict, date: str = DATE) -> bytes:
    return record([
        ("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", _label(digest)),
        ("WARC-Profile", PROFILE), ("WARC-Refers-To", first["record_id"]), ("WARC-Refers-To-Target-URI", first["url"]), ("WARC-Refers-To-Date", first["date"]),
        ("X-Page-Id", None if page is None else str(page)), ("X-Refers-To-Page-Id", None if first["page_id"] is None else str(first["page_id"])),
        ("X-Payload-Bytes", str(size)), ("Content-Type", "application/http; msgtype=response"),
    ], head)


def members(data: bytes) -> bytes:
    """A record as gzip: one member, or several in a row where it is longer than ``MEMBER``."""
    out = []
    for at in range(0, len(data), MEMBER):
        pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        out.append(pack.compress(data[at : at + MEMBER]) + pack.flush())
    return b"".join(out)


def _archives(records: Iterator[bytes], folder: str, most: int) -> Iterator[pa.RecordBatch]:
    """Packed archives of bounded size, a row each, without their last byte (see _write)."""
    part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

    def close() -> pa.RecordBatch:
        info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(folder, "info", part, number)), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        return pa.RecordBatch.from_arrays([pa.array([b"".join([members(info), *held])[:-1]], pa.binary())], ["archive"])

    for data in records:
        held.append(members(data))
        size += len(held[-1])
        if size >= most:
            yield close()
            number, held, size = number + 1, [], 0
    if held:
        yield close()


def _write(packed: DataFrame, folder: str) -> None:
    """A file per row. Spark's text writer ends each with a line separator, for which the zero byte stands that every member ends with."""
    packed.select(F.col("archive").cast("string").alias("value")).write.options(lineSep="\0", compression="none", maxRecordsPerFile=1).text(folder)


def write_responses(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> None:
    """Every page as a response record with its whole payload."""
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for page, url, payload in zip(*(batch.column(k) for k in range(3)), strict=True):
                payload = payload.as_py()
                block = HTTP + payload
                yield response(record_id(folder, part, number), url.as_py(), digest32(payload), page.as_py(), block)
                number += 1

    _write(rows.mapInArrow(lambda batches: _archives(records(batches), folder, file_bytes), "archive binary"), folder)


class Broken(Exception):
    """What can't be read of an archive."""


def parse(stream) -> Iterator[tuple[dict[str, str], bytes | Broken]]:
    """Headers (names in lower case) and block of each record of an open archive; Broken for bytes that are no record, after which reading goes on where the next one begins."""
    lost = 0
    try:
        while line := stream.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                lost += len(line)
                continue
            if lost:
                yield {}, Broken(f"{lost} bytes that are no record")
                lost = 0
            headers = {}
            while line := stream.readline().rstrip(b"\r\n"):
                name, _, value = line.decode("utf-8", "replace").partition(":")
                headers[name.lower()] = value.strip()
            size = headers.get("content-length", "")
            if not size.isdigit():
                yield headers, Broken("a record without a length")
                continue
            block = stream.read(int(size))
            if len(block) < int(size):
                yield headers, Broken(f"a record breaks off after {len(block)} of {size} bytes")
                return
            yield headers, block
    except (EOFError, OSError, zlib.error) as error:
        yield {}, Broken(f"the archive can't be unpacked further: {error}")
        return
    if lost:
        yield {}, Broken(f"{lost} bytes that are no record")


def opened(content: bytes):
    """An archive's bytes as a stream of records, whether compressed or not."""
    raw = io.BytesIO(content)
    return gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw


def _number(value: str | None) -> int | None:
    return int(value) if value and value.lstrip("-").isdigit() else None


def _facts(headers: dict[str, str], block: bytes) -> dict:
    """What a record says, with what it lacks filled in from its block."""
    kind, head, payload = headers.get("warc-type", ""), b"", block
    if headers.get("content-type", "").startswith("application/http") or block.startswith(b"HTTP/"):
        head, _, payload = block.partition(b"\r\n\r\n")
    declared, full = headers.get("warc-payload-digest", ""), kind == "response"
    normal, own = normal_digest(declared), digest32(payload) if full else ""
    if not full and normal and normal.startswith("sha1:"):
        own = base64.b32encode(bytes.fromhex(normal[5:])).decode()
    return {
        "page_id": _number(headers.get("x-page-id")), "url": headers.get("warc-target-uri", ""), "record_id": headers.get("warc-record-id", ""), "record_type": kind,
        "payload_digest": own or declared, "payload_bytes": len(payload) if full else _number(headers.get("x-payload-bytes")), "refers_to": _number(headers.get("x-refers-to-page-id")),
        "payload": payload if full else b"", "intact": not full or not normal or normal == _as_declared(normal, payload, own), "head": head, "date": headers.get("warc-date", DATE), "declared": normal, "error": None,
    }


def _as_declared(normal: str, payload: bytes, own: str) -> str:
    """A payload's digest by the algorithm of another one; ``own`` is its SHA-1 in base 32."""
    name = normal.partition(":")[0]
    return f"sha1:{base64.b32decode(own).hex()}" if name == "sha1" else f"{name}:{hashlib.new(name, payload).hexdigest()}"


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("payload") or b"")
        if len(held) >= BATCH_RECORDS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!._]*").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").filter(F.octet_length("content") > 0)


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """A row per response or revisit: file, number in it, page_id, url, record_id, record_type, payload_digest, payload_bytes (of the full payload; null where a revisit doesn't say), refers_to, payload, intact, declared (its digest as the record has it, in one form); and a row of type error, with its ``error``, for what can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for path, content in zip(batch.column(0), batch.column(1), strict=True):
                    for n, (headers, block) in enumerate(parse(opened(content.as_py()))):
                        if isinstance(block, Broken):
                            yield {"file": path.as_py(), "number": n, "record_type": "error", "url": headers.get("warc-target-uri"), "record_id": headers.get("warc-record-id"), "error": str(block)}
                        elif headers.get("warc-type") in ("response", "revisit"):
                            row = _facts(headers, block)
                            yield row | {"file": path.as_py(), "number": n, "payload": row["payload"] if with_payload else None}

        yield from _batched(rows(), READ)

    return _files(spark, folder).mapInArrow(run, READ_DDL)


def resolve(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Revisits only: (file, number, first), ``first`` being the original: (page_id, file, number, url, payload_bytes).

    Of responses with equal payloads of at least ``least_bytes`` bytes the smallest
    page is the original; all others revisit it, and so do revisits of its digest.
    """
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "file", "number", "url", "payload_bytes", "payload_digest")
    response, revisit = F.col("record_type") == "response", F.col("record_type") == "revisit"
    responses = headers.filter(response & F.col("intact") & (F.col("payload_bytes") >= least_bytes))
    originals = keep(responses.groupBy("payload_digest").agg(F.min(order).alias("first")), "originals")
    other = F.coalesce(~F.col("declared").startswith("sha1:"), F.lit(False))
    # a revisit by another algorithm means the payload of the intact responses that declare the same
    means = responses.filter(other).groupBy("declared").agg(F.min("payload_digest").alias("means"))
    foreign = headers.filter(revisit & other).join(means, "declared").withColumn("payload_digest", F.col("means")).drop("means")
    plain = headers.filter(response & F.col("intact") & (F.col("payload_bytes") >= least_bytes) | revisit & ~other)
    joined = plain.unionByName(foreign.select(plain.columns)).join(originals, "payload_digest")
    itself = (F.col("first.file") == F.col("file")) & (F.col("first.number") == F.col("number"))
    return joined.filter(~itself).select("file", "number", "first")


def _member(content: memoryview, at: int) -> tuple[bytes, int]:
    """The gzip member that begins at a place, unpacked, and where it ends."""
    unpack, out = zlib.decompressobj(31), []
    while not unpack.eof:
        chunk = content[at : at + CHUNK]
        if not chunk:
            raise EOFError("a member breaks off")
        out.append(unpack.decompress(chunk))
        at += len(chunk)
    return b"".join(out), at - len(unpack.unused_data)


def _missing(data: bytes) -> int | None:
    """Bytes that a record still lacks (below zero: more than one); null if it can't be told."""
    head = data.find(b"\r\n\r\n")
    for line in data[:head].split(b"\r\n") if data.startswith(b"WARC/") and head >= 0 else ():
        name, _, value = line.partition(b":")
        if name.lower() == b"content-length" and value.strip().isdigit():
            return head + 8 + int(value) - len(data)
    return None


def slices(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Each record of an archive, numbered as :func:`parse` does, as gzip members: cut out where a record has its own members, else packed anew."""
    number, begin, at, held, view = 0, 0, 0, [], memoryview(content)
    try:
        while content[:2] == b"\x1f\x8b" and at < len(content):
            data, at = _member(view, at)
            held.append(data)
            missing = _missing(b"".join(held))
            if missing is None or missing < 0:
                break
            if not missing:
                yield number, content[begin:at]
                number, begin, held = number + 1, at, []
    except (EOFError, zlib.error):
        pass  # what follows is left to parse, which tells what is wrong
    if begin < len(content):
        for n, (headers, block) in enumerate(parse(opened(content))):
            if n >= number and not isinstance(block, Broken):
                yield n, members(record([(k, v) for k, v in headers.items() if k != "content-length"], block))


def _records(spark: SparkSession, source: str) -> DataFrame:
    """(path, number, data): every record of the archives, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = ({"path": path.as_py(), "number": n, "payload": data} for n, data in slices(content.as_py()))
                yield from _batched(rows, SLICED)

    return _files(spark, source).mapInArrow(run, "path string, number long, payload binary")


def deduplicate(spark: SparkSession, source: str, target: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Read the archives of ``source`` and write them to ``target`` with one response per payload and revisits for the rest.

    Records join the verdicts on them one by one, as compressed as they are, so
    payloads are shuffled once and an archive of any size is spread over tasks.
    """
    path = new_path(spark, "headers")
    read_archives(spark, source).drop("payload", "record_id", "error").filter("record_type <> 'error'").write.parquet(path)
    verdicts = keep(resolve(spark.read.parquet(path), least_bytes), "verdicts")
    forget(spark, path)
    on = ["path", "number"]
    found = _records(spark, source).join(verdicts.withColumnRenamed("file", "path").hint("merge"), on, "left").select("path", "number", "payload", "first")
    _write(found.mapInArrow(lambda batches: _archives(_rewritten(batches, target), target, file_bytes), "archive binary"), target)


def _rewritten(batches: Iterator[pa.RecordBatch], target: str) -> Iterator[bytes]:
    """The records with the verdicts on them, with fresh headers."""
    for batch in batches:
        for path, n, data, first in zip(*(batch.column(k) for k in range(4)), strict=True):
            path, n, first = path.as_py(), n.as_py(), first.as_py()
            headers, block = next(parse(opened(data.as_py())))
            kind, own = headers.get("warc-type"), record_id(target, path, n)
            if kind == "warcinfo":
                continue
            if kind not in ("response", "revisit"):
                yield record([(k, own if k == "warc-record-id" else v) for k, v in headers.items() if k != "content-length"], block)
                continue
            row = _facts(headers, block)
            if first is not None:
                size = first["payload_bytes"]
                there = {"record_id": record_id(target, first["file"], first["number"]), "url": first["url"], "date": DATE, "page_id": first["page_id"]}
                yield revisit(own, row["url"], first["payload_digest"], size, row["page_id"], row["head"] + b"\r\n\r\n", there, row["date"])
            elif kind == "revisit":  # of a response that isn't here
                there = {"record_id": headers.get("warc-refers-to"), "url": headers.get("warc-refers-to-target-uri"), "date": headers.get("warc-refers-to-date"), "page_id": row["refers_to"]}
                yield revisit(own, row["url"], row["payload_digest"], row["payload_bytes"] or 0, row["page_id"], block, there, row["date"])
            else:  # what isn't intact keeps the digest that it came with, and so is never taken for what it says
                yield response(own, row["url"], row["payload_digest"] if row["intact"] else headers["warc-payload-digest"], row["page_id"], block, row["date"])


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages written as archives and deduplicated, and the records of those read back."""
    spark = pages.sparkSession
    raw, clean = new_path(spark, "warc-raw"), new_path(spark, "warc")
    write_responses(pages, raw)
    deduplicate(spark, raw, clean, least_bytes)
    return read_archives(spark, clean)
