"""WARC archives: write captures as request, response (or revisit) and metadata records; read records; assemble transactions.

Writing. Payloads of at least 100 bytes that are equal share one response, that of the smallest page id; the others
become revisit records without a body, which name that page. Every record is a gzip member of its own. Request and
metadata records point at their capture through WARC-Concurrent-To; the metadata record holds the full payload's
length, which a revisit has no body for. Files are closed at about 32 MB; a retried task replaces its files whole.

Payloads are digested and written where they are read; only digests that occur more than once (a row each) join them.

Reading gives one row per record. Assembly groups records by the capture they are concurrent to (a capture by its own
id) and emits one nested row per capture. A request or metadata record without a link, or whose capture is in none of
the archives, comes out as a row without a capture; captures with one id come out as one row with the first in `capture` and all in
`captures`; a record without an id and a link is a row of its own. Nothing is dropped. Where an archive breaks (a cut or changed gzip
member, a block shorter than its Content-Length, a length that is no number) a record of type `damaged` has what was left of
the block, as has a response whose payload is not that of its own sha256 digest. Reading goes on with the next gzip member that begins a record; an archive without compression ends there.

Null html: an empty payload. Null page id: a record without one; it never wins over a numbered page. Repeated rows of
the winning page are responses each. Other columns are not read. An empty table gives no files and no rows. Payloads of any
length are written and read whole.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Payloads under this many bytes are always stored.
LEAST = 100
#: How a gzip member begins.
MEMBER = b"\x1f\x8b\x08"
FILE_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
RECORD = (
    "record_id string, record_type string, concurrent_to array<string>, headers map<string,string>,"
    " payload binary, payload_bytes long, payload_sha256 string"
)


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest, refers_to (null: a response)."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload"))
    shared_by = (
        rows.where(F.col("n_bytes") >= LEAST)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("digest").alias("equal"), "first")
    )
    copied = F.coalesce(F.col("first") != F.col("page_id"), F.col("first").isNotNull())
    joined = rows.join(shared.checked_broadcast(shared.stage(shared_by, "equal-payloads")), F.col("digest") == F.col("equal"), "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(copied, F.col("first")).alias("refers_to"))


def record(kind: str, record_id: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [b"WARC/1.1", f"WARC-Type: {kind}".encode(), f"WARC-Record-ID: <urn:uuid:{record_id}>".encode(), f"WARC-Date: {DATE}".encode()]
    lines += [f"{name}: {value}".replace("\r", "%0D").replace("\n", "%0A").encode() for name, value in fields if value is not None]
    lines += [f"Content-Length: {len(block)}".encode(), b"", block, b"", b""]
    press = zlib.compressobj(1, zlib.DEFLATED, 31)
    return press.compress(b"\r\n".join(lines)) + press.flush()


def capture_records(row_id: str, page_id, url, payload: bytes, digest: str, refers_to) -> Iterator[bytes]:
    ids = [str(uuid.uuid5(uuid.NAMESPACE_URL, f"{row_id}/{kind}")) for kind in ("capture", "request", "metadata")]
    link = ("WARC-Concurrent-To", f"<urn:uuid:{ids[0]}>")
    page, target = ("WARC-Page-ID", page_id), ("WARC-Target-URI", url)
    host = (url or "").split("//")[-1].split("/")[0]
    yield record("request", ids[1], [link, target, ("Content-Type", "application/http;msgtype=request")], f"GET {url or '/'} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode())
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    fields = [page, target, ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is None:
        yield record("response", ids[0], fields, head + payload)
    else:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield record("revisit", ids[0], [*fields, ("WARC-Profile", profile), ("WARC-Refers-To-Page-ID", refers_to)], head)
    yield record("metadata", ids[2], [link, target, ("Content-Type", "application/warc-fields")], f"payload-length: {len(payload)}\r\n".encode())


def write(pages: DataFrame, out_uri: str, **columns: str) -> DataFrame:
    """Write the archives under out_uri; the (materialised) manifest has a row per file: path, n_captures."""
    run = uuid.uuid4().hex

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, closed, captures, held, out, path = TaskContext.get().partitionId(), 0, 0, 0, 0, None, ""

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "n_captures": [captures]})

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(5)), strict=True):
                if out is None:
                    path = f"{out_uri}/part-{part:07d}-{closed:05d}.warc.gz"
                    out, captures, held, closed = shared.Part(path), 0, 0, closed + 1
                page_id, url, payload, digest, refers_to = (x.as_py() for x in row)
                for blob in capture_records(f"{run}/{part}/{n}", page_id, url, payload, digest, refers_to):
                    held += out.write(blob)
                n, captures = n + 1, captures + 1
                if held >= FILE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return shared.stage(with_revisits(pages, **columns).mapInArrow(shared.lean(save), "path string, n_captures long"), "warc-manifest")


def archives(spark: SparkSession, glob: str) -> DataFrame:
    """Paths of archives that some other writer made; contents are not read here."""
    return spark.read.format("binaryFile").load(glob).select("path")


def parse(stream) -> Iterator[tuple[dict[str, str], list[str], bytes]]:
    """(headers, concurrent-to ids, block) of each record of an open archive; the type of a record that breaks off is `damaged`."""
    headers: dict[str, str] = {}
    links: list[str] = []
    block = b""
    try:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            headers, links, block = {}, [], b""
            while (line := stream.readline()).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                headers[name.strip().lower()] = value.strip()
                if name.strip().lower() == "warc-concurrent-to":
                    links.append(value.strip())
            size = int(headers.get("content-length", 0))
            while len(block) < size and (more := stream.read(min(size - len(block), 1 << 20))):
                block += more
            if len(block) < size:
                raise EOFError
            yield headers, links, block
            headers = {}
    except (EOFError, ValueError, OSError, zlib.error):
        yield headers | {"warc-type": "damaged"}, links, block


class Members(io.RawIOBase):
    """What the gzip members of a file hold, one after another; `start` is where the member that is read now begins."""

    def __init__(self, raw, start: int = 0) -> None:
        self.raw, self.start = raw, start
        self.fed = start  # file position after what was given to the inflater
        raw.seek(start)
        self.inflate, self.pending = zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while True:
            if not self.pending:
                self.pending = self.raw.read(1 << 16)
                self.fed += len(self.pending)
                if not self.pending:
                    if self.fed > self.start:
                        raise EOFError
                    return 0
            out = self.inflate.decompress(self.pending, len(into))
            self.pending = self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.pending = self.inflate.unused_data.lstrip(b"\0")  # archives may be padded with zeros
                self.start, self.inflate = self.fed - len(self.pending), zlib.decompressobj(31)
            if out:
                into[: len(out)] = out
                return len(out)


def next_member(raw, at: int) -> int | None:
    """Where the next gzip member begins, from a position on, whose content begins as a record does."""
    raw.seek(at)
    held = b""
    while True:
        more = raw.read(1 << 16)
        held += more
        found = held.find(MEMBER)
        while found >= 0 and (len(held) - found >= 512 or not more):
            try:
                if zlib.decompressobj(31).decompress(held[found:], 5) == b"WARC/":
                    return at + found
            except zlib.error:
                pass
            found = held.find(MEMBER, found + 1)
        if not more:
            return None
        cut = found if found >= 0 else max(0, len(held) - len(MEMBER) + 1)
        at, held = at + cut, held[cut:]


def records_of(raw) -> Iterator[tuple[dict[str, str], list[str], bytes]]:
    """All records of an open archive, also those after a damaged gzip member."""
    if raw.read(2) != MEMBER[:2]:
        raw.seek(0)
        yield from parse(io.BufferedReader(raw))
        return
    at: int | None = 0
    while at is not None:
        members, broken = Members(raw, at), False
        for headers, links, block in parse(io.BufferedReader(members)):
            broken = headers.get("warc-type") == "damaged"
            yield headers, links, block
        at = next_member(raw, members.start + 1) if broken else None


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    if "application/http" in headers.get("content-type", ""):
        return block.partition(b"\r\n\r\n")[2]
    return block


def read(files: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the files in column `path`; payloads=False leaves the bytes out once they are digested."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "record_type", "concurrent_to", "headers", "payload", "payload_bytes", "payload_sha256"]
        kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string()), pa.binary(), pa.int64(), pa.string()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inside = shared.filesystem(path)
                with store.open_input_file(inside) as raw:
                    rows: list[tuple] = []
                    held = 0
                    for headers, links, block in records_of(raw):
                        payload = payload_of(headers, block)
                        kind = headers.get("warc-type")
                        digest, said = hashlib.sha256(payload).hexdigest(), headers.get("warc-payload-digest", "")
                        if kind == "response" and said.startswith("sha256:") and said[7:].lower() != digest:
                            kind = "damaged"
                        keep = payload if payloads or kind == "metadata" else None
                        rows.append((headers.get("warc-record-id"), kind, links, list(headers.items()), keep, len(payload), digest))
                        held += len(payload)
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    spread = files.select("path").repartition(shared.shuffle_partitions(files.sparkSession), "path")
    return spread.mapInArrow(shared.lean(load), RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: transaction_id, capture, captures (more than one only where an id repeats), requests, metadata."""
    is_capture = F.col("record_type").isin("response", "revisit")
    own = F.coalesce("record_id", F.concat(F.lit("without-id-"), F.uuid()))
    linked = F.when(~is_capture & (F.size("concurrent_to") > 0), F.col("concurrent_to")).otherwise(F.array(own))
    body = F.struct(*[c for c in records.columns if c != "concurrent_to"])
    keyed = records.select(F.explode(F.array_distinct(linked)).alias("transaction_id"), "record_type", is_capture.alias("is_capture"), body.alias("body"))
    found = keyed.groupBy("transaction_id").agg(
        F.collect_list(F.when(F.col("is_capture"), F.col("body"))).alias("captures"),
        F.collect_list(F.when(F.col("record_type") == "request", F.col("body"))).alias("requests"),
        F.collect_list(F.when(F.col("record_type") == "metadata", F.col("body"))).alias("metadata"),
    )
    return found.select("transaction_id", F.get("captures", F.lit(0)).alias("capture"), "captures", "requests", "metadata")


def round_trip(pages: DataFrame, out_uri: str) -> DataFrame:
    """Write, read back, assemble: page_id, payload_bytes, payload_digest, record_type, refers_to per capture."""
    whole = transactions(read(write(pages, out_uri), payloads=False)).where("capture is not null")
    header = lambda name: F.col("capture.headers")[name]
    said = F.regexp_extract(F.get("metadata", F.lit(0))["payload"].cast("string"), r"payload-length: (\d+)", 1).cast("long")
    stored = F.col("capture.record_type") == "response"
    return whole.select(
        header("warc-page-id").cast("long").alias("page_id"),
        F.when(stored, F.col("capture.payload_bytes")).otherwise(said).alias("payload_bytes"),
        F.when(stored, F.col("capture.payload_sha256")).otherwise(F.replace(header("warc-payload-digest"), F.lit("sha256:"))).alias("payload_digest"),
        F.col("capture.record_type").alias("record_type"),
        header("warc-refers-to-page-id").cast("long").alias("refers_to"),
        F.size("requests").cast("long").alias("n_requests"),
        F.size("metadata").cast("long").alias("n_metadata"),
    )


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to, 1::BIGINT AS n_requests, 1::BIGINT AS n_metadata
FROM f
"""
