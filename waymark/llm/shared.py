"""What several operators need: shared scratch tables, checked broadcasts, packed columns, files on any store."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship

#: The white space of the word definition `[^\x20\x09-\x0D]+`, as a regular expression class body.
SPACE = r"\x20\x09-\x0D"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Measured bytes up to which a materialised table is broadcast; joins shuffle beyond.
BROADCAST_BYTES = 16 << 20
#: Bytes of one Arrow batch that a Python worker gets: by Spark's default, 10,000 whole texts come at once.
BATCH_BYTES = 4 << 20


def begin(spark: SparkSession) -> None:
    """Ready a session for these operators: executors can import the package, and long texts come in small Arrow batches.

    A bound that the session has set itself is left alone.
    """
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only a local session may do without (a folder of our own)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/waymark-scratch"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Whose scratch is made just now, and what each owner has: ("path" | "table" | "sent", what), in the order of making.
_OWNER: ContextVar[str] = ContextVar("owner", default="session")
_HELD: dict[str, list[tuple[str, object]]] = defaultdict(list)


@contextmanager
def owner(name: str):
    """What is made inside belongs to this owner: `release` of another leaves it alone."""
    before = _OWNER.set(name)
    try:
        yield
    finally:
        _OWNER.reset(before)


def scratch_path(spark: SparkSession, label: str, owned: bool = True) -> str:
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if owned:
        _HELD[_OWNER.get()].append(("path", path))
    return path


def scratch_table(label: str) -> str:
    """A name for a table whose files the caller puts under `scratch_path`."""
    name = f"waymark_{label}_{uuid.uuid4().hex}"
    _HELD[_OWNER.get()].append(("table", name))
    return name


def sent(spark: SparkSession, value):
    """A broadcast that `release` destroys; only for values of bounded size."""
    out = spark.sparkContext.broadcast(value)
    _HELD[_OWNER.get()].append(("sent", out))
    return out


def release(spark: SparkSession, name: str | None = None) -> None:
    """Delete an owner's scratch (the present one's): frames made of it must be written elsewhere by now, or not be read again."""
    held = _HELD.pop(name or _OWNER.get(), [])
    while held:
        kind, what = held.pop()
        if kind == "sent":
            what.destroy()
        elif kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS {what}")
        else:
            delete(spark, what)


@atexit.register
def _at_end() -> None:
    """A driver that ends leaves no scratch behind, if its session still runs."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        for name in list(_HELD):
            release(spark, name)


#: Spark's own switch: the shuffle files of a query go when the query has ended.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df once into the shared folder and read it again: lineage ends, lost executors cost no recomputation, and no
    shuffle file of the query is needed or kept."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(TIDY, before) if before is not None else spark.conf.unset(TIDY)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, label: str) -> None:
    """Delete the last written table of a label, of the present owner: what was made of it is written by now."""
    held = _HELD[_OWNER.get()]
    for kind, path in reversed(held):
        if kind == "path" and path.rsplit("/", 1)[1].rsplit("-", 1)[0] == label:
            held.remove((kind, path))
            delete(spark, path)
            return


def delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fits(small: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a (materialised) table's rows, as measured, take at most `limit` bytes."""
    size = F.lit(24.0)
    for name, kind in small.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith("array"):
            size = size + 16 * F.coalesce(F.size(name), F.lit(0))
        size = size + 8
    return (small.agg(F.sum(size)).first()[0] or 0) <= limit


def checked_broadcast(small: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if the (materialised) table's measured bytes prove it small; otherwise the join shuffles."""
    return F.broadcast(small) if fits(small, limit) else small


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str):
    """(pyarrow filesystem, path inside it) of a URI or a plain path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), os.path.abspath(uri))


class Part:
    """A file that is written beside its final name and renamed by close(): a retried task leaves one whole file."""

    def __init__(self, uri: str) -> None:
        self.store, self.path = filesystem(uri)
        self.store.create_dir(os.path.dirname(self.path), recursive=True)
        self.beside = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.store.open_output_stream(self.beside)

    def write(self, chunk: bytes) -> int:
        self.out.write(chunk)
        return len(chunk)

    def close(self) -> None:
        self.out.close()
        self.store.move(self.beside, self.path)


def pack_lists(parts: list[bytes]) -> bytes:
    """Byte strings as one: their number, their lengths (unsigned 32 bits), their bytes."""
    return np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def unpack_lists(blob: bytes) -> list[bytes]:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(blob, "<u4", n, 4), dtype=np.int64) + 4 * (n + 1)
    at, out = 4 * (n + 1), []
    for end in ends.tolist():
        out.append(blob[at:end])
        at = end
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenation of the ranges [start, start + length)."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    shift = np.asarray(starts, np.int64) - np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return np.arange(total, dtype=np.int64) + np.repeat(shift, lengths)


def blocks(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Group Arrow batches, cut into slices, so that each group holds about `limit` bytes of the text column (one row at least)."""
    group: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        sizes = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0), np.int64)
        at, ends = 0, np.cumsum(sizes)
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1 if not held else at, int(np.searchsorted(ends, before + limit - held, "right")))
            if stop > at:
                group.append(batch.slice(at, stop - at))
                held += int(ends[stop - 1]) - before
            if stop < batch.num_rows or held >= limit:
                yield group
                group, held = [], 0
            at = stop
    if group:
        yield group


#: Caches of a worker, emptied when a task ends.
CACHES: list[dict] = []


def lean(step):
    """A mapInArrow function that gives its task's memory back: a worker that waits for its next task holds little."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        for cache in CACHES:
            cache.clear()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return run


def block_number() -> Iterator[int]:
    """Numbers no other task of the stage gives: the partition's number above, a counter below."""
    from pyspark import TaskContext

    context = TaskContext.get()
    at = (context.partitionId() if context else 0) << 24
    while True:
        yield at
        at += 1
