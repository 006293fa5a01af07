"""WARC archives: a writer with revisit records, and a splittable reader.

Each record is a gzip member of its own, so a reader can begin at any of them. A task of the reader has a range of bytes
of one file: it looks for the magic bytes of gzip, takes a place as the start of a member only if what decodes there
begins as a WARC header, and owns the records that start inside its range, reading the last one past the range's end.

The reader takes archives of other writers too: records of any type, digests of any algorithm (SHA-1, SHA-256 and MD5 in
base 32 or hexadecimal are verified, others aren't), record ids of any form. One record is held in memory at a time.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import common

#: Equal payloads of at least so many bytes are written once.
LEAST_REVISIT = 100
#: Repeated payloads up to so many are marked by a broadcast of their digests, more by a shuffle of the pages.
BROADCAST_DIGESTS = 200_000
#: Bytes of an archive that a range of the reader has, and the most tasks that ranges are dealt to.
RANGE_BYTES, MOST_TASKS = 16 << 20, 100_000
GZIP_MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records are made without a clock, so that a task run again writes the same bytes.
DATE = "1970-01-01T00:00:00Z"


def _line(value: str | None) -> str:
    """A header value without line ends."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "")


def _urn(page_id: int | None) -> str:
    return "urn:page:" + ("" if page_id is None else str(page_id))


def _page_of(urn: str | None) -> int | None:
    """The page of a record id that this module has made; None for one of any other form."""
    found = re.fullmatch(r"<?urn:page:(-?\d+)>?", (urn or "").strip())
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP header alone, whose Content-Length is that of the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_urn(page_id)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_urn(refers_to)}>"]
    data = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


_FILES = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> list[tuple[str, int]]:
    """Write a record for each row into archives of a shared folder; returns their paths and sizes.

    Of rows with equal payloads of LEAST_REVISIT bytes or more, those with the smallest id are responses and the others
    revisit it; smaller payloads are all responses. A null html is empty; a null id is larger than any other, and a
    payload with null ids alone is written as responses. Groups of several rows are found on digests alone, with sums
    before the exchange; where they are counted to be few, their digests are broadcast and no page leaves its task.
    """
    spark = pages.sparkSession
    common.make_folder(folder)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    digest = F.sha2(F.col("html").cast("binary"), 256)
    groups = rows.where(F.octet_length("html") >= LEAST_REVISIT).groupBy(digest.alias("known")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    several = common.checkpoint(groups.where("n > 1 and first is not null").drop("n"))
    few = several.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    joined = rows.withColumn("digest", digest).join(F.broadcast(several) if few else several, F.col("digest") == F.col("known"), "left")
    dealt = joined.select("page_id", "url", "html", "digest", "first")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batch = next(filter(len, batches), None)
        if batch is None:
            return
        path, n = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0
        with common.SharedWriter(path) as out:
            while batch is not None:
                _, at = common.utf8(batch.column(2))
                for low, high in common.slices(at):
                    part = batch.slice(low, high - low)
                    for page_id, url, html, known, first in zip(*(c.to_pylist() for c in part.columns), strict=True):
                        out.write(record(page_id, url, html.encode(), known, first, first is not None and page_id != first))
                        n += 1
                batch = next(filter(len, batches), None)
        yield pa.RecordBatch.from_pylist([{"path": path, "n_records": n, "n_bytes": out.size}], schema=_FILES)

    made = dealt.mapInArrow(archive, "path string, n_records long, n_bytes long").collect()
    return sorted((r.path, r.n_bytes) for r in made)


def _starts(data: bytes) -> bool:
    """Whether a gzip member that holds a WARC record begins here."""
    try:
        return zlib.decompressobj(31).decompress(data, 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


class RangeReader:
    """The records of one file that start in [begin, end), as (headers, block)."""

    CHUNK = 1 << 18

    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        with common.open_shared(self.path) as file:
            at = self.begin if self.begin == 0 else self.first(file)
            while at is not None and at < self.end:
                file.seek(at)
                inflate, out, read = zlib.decompressobj(31), [], 0
                while not inflate.eof:
                    data = file.read(self.CHUNK)
                    if not data:
                        if read == 0:
                            return  # the end of the file
                        raise ValueError(f"{self.path} ends within the record at {at}")
                    read += len(data)
                    out.append(inflate.decompress(data))
                at += read - len(inflate.unused_data)
                yield split_record(b"".join(out))

    def first(self, file) -> int | None:
        """The first start of a record in the range."""
        at, tail = self.begin, b""
        while at < self.end:
            file.seek(at)
            data = file.read(self.CHUNK)
            if not data:
                return None
            place = data.find(GZIP_MAGIC)
            while place >= 0 and at + place < self.end:
                if len(data) - place < 1 << 10:  # near the edge: decode from a fresh read
                    file.seek(at + place)
                    tail = file.read(1 << 10)
                else:
                    tail = data[place : place + (1 << 10)]
                if _starts(tail):
                    return at + place
                place = data.find(GZIP_MAGIC, place + 1)
            at += max(1, len(data) - len(GZIP_MAGIC) + 1)
        return None


def split_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block, of a whole record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    size = int(headers.get("content-length", len(rest)))
    if len(rest) < size:
        raise ValueError("a record is shorter than its header says")
    return headers, rest[:size]


def _verified(digest: str | None, payload: bytes) -> bool:
    """Whether a labelled digest is that of the payload; one of an unknown algorithm or form says nothing against it."""
    name, _, value = (digest or "").partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("sha1", "sha256", "md5"):
        return True
    made = hashlib.new(name, payload, usedforsecurity=False).digest()
    value = value.strip()
    try:
        known = bytes.fromhex(value) if len(value) == 2 * len(made) else base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except (ValueError, binascii.Error):
        return True
    return len(known) != len(made) or known == made


def _row(headers: dict[str, str], block: bytes) -> tuple[tuple, bytes | None]:
    """The columns of a record, and its payload, which is the block without its HTTP header where it has one."""
    kind = headers.get("warc-type", "")
    http, empty, rest = block.partition(b"\r\n\r\n")
    has_http = bool(empty) and headers.get("content-type", "").lower().startswith("application/http")
    digest = headers.get("warc-payload-digest")
    if kind == "revisit":
        size = re.search(rb"(?im)^content-length:\s*(\d+)", http) if has_http else None
        own = re.fullmatch("sha-?256:([0-9a-fA-F]{64})", (digest or "").strip())
        length, known, payload = int(size[1]) if size else None, own[1].lower() if own else None, None
    else:
        payload = rest if has_http else block
        if not _verified(digest, payload):
            raise ValueError(f"the payload of {headers.get('warc-record-id')} isn't that of its digest")
        length, known = len(payload), hashlib.sha256(payload).hexdigest()
    name, refers = headers.get("warc-record-id"), headers.get("warc-refers-to")
    return (_page_of(name), headers.get("warc-target-uri"), length, known, kind, _page_of(refers), name, refers), payload


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string"


def read(spark: SparkSession, files: list[tuple[str, int]], range_bytes: int = RANGE_BYTES, with_payload: bool = False) -> DataFrame:
    """A row for each record of the archives (path, size). Ranges of bytes are rows, dealt evenly to tasks.

    The length and the SHA-256 of a payload are those of what was read, which must agree with its header; those of a
    revisit are what its headers say, null where they don't. page_id and refers_to are null for record ids of other
    forms, which record_id and refers_to_id have. with_payload adds the payload, null for a revisit.
    """
    schema = READ + (", payload binary" if with_payload else "")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 2, pa.int64(), *[pa.string()] * 2, pa.binary()][: len(names)]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for path, begin, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                for headers, block in RangeReader(path, begin, end):
                    row, payload = _row(headers, block)
                    rows.append((*row, payload) if with_payload else row)
                    held += len(payload or b"") if with_payload else 0
                    if len(rows) >= 10_000 or held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    if not files:
        return spark.createDataFrame([], schema)
    whole = spark.createDataFrame([(path, size) for path, size in files if size], "path string, size long")
    ranges = whole.select("path", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(range_bytes))).alias("low"), "size")
    ranges = ranges.select("path", "low", F.least("size", F.col("low") + range_bytes).alias("high"))
    n = sum(-(-size // range_bytes) for _, size in files)
    return ranges.repartition(max(1, min(n, MOST_TASKS))).mapInArrow(records, schema)


def archived(pages: DataFrame) -> DataFrame:
    """Write `pages` into archives of a new shared folder and read them back."""
    spark = pages.sparkSession
    return read(spark, write(pages, common.fresh_folder(spark, "warc")))
