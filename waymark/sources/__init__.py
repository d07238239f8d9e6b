"""Readers and writers of task sets, trajectory trees and texts."""

from __future__ import annotations

import atexit
import json
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, DataFrameReader, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import hit_file, step_number, strip
from ..schemas import EVENT_ROW, TRAJECTORY


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir, or a local one for a local session without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{(base or f'file://{tempfile.gettempdir()}/waymark-scratch').rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


#: Scratch folders of this driver.
_SCRATCH: list[str] = []


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete this driver's scratch folders, from the n-th on: frames made of them must be written elsewhere by now."""
    while len(_SCRATCH) > since:
        fs, path = _hadoop(spark, _SCRATCH.pop())
        fs.delete(path, True)


@atexit.register
def _at_end() -> None:
    """A driver that ends leaves no scratch behind, if its session still runs."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        release(spark)


def read_split(spark: SparkSession, root: str, dataset: str, split: str) -> DataFrame:
    """A named data set's split, as `write_splits` lays it out."""
    return spark.read.parquet(f"{root}/{dataset.replace('/', '__')}_{split}")


def write_splits(df: DataFrame, root: str, dataset: str, split: str, part_col: str = "split") -> str:
    """train and validation under ``<root>/<dataset>_<split>/``."""
    folder = f"{root}/{dataset.replace('/', '__')}_{split}"
    for part in ("train", "validation"):
        df.where(F.col(part_col) == part).drop(part_col).write.mode("overwrite").parquet(f"{folder}/{part}.parquet")
    return folder


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written once to a new scratch folder and read from there."""
    path = scratch_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_path() -> Column:
    """The path of the file that a row comes from, as it is on the store (Spark percent-encodes it)."""
    return _decoded(F.col("_metadata.file_path"))


def _decoded(path: Column) -> Column:
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _folder_files(spark: SparkSession, folders: list[str], suffix: str) -> tuple[DataFrameReader, Column]:
    """A reader for the files of a suffix right in folders (or patterns of them), and the condition on `path` that leaves deeper ones out.

    The folders are what is listed. A pattern of files would have Spark list each file it matches as a folder of its own.
    """
    depths = {fs.makeQualified(path).depth() + 1 for fs, path in (_hadoop(spark, f) for f in folders)}
    names = F.split(F.regexp_replace("path", "^[^/]*:(//[^/]*)?", ""), "/")
    reader = spark.read.option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True)  # no folder k=v becomes a column
    return reader, (F.size(names) - 1).isin(*depths)


def _empty_files(reader: DataFrameReader, folders: list[str]) -> DataFrame:
    """path of the files of no bytes: Spark lists them with the others, but its file sources leave them out.

    Names alone are taken from the listing that a reader makes anyway, and no file is opened.
    """
    listing = reader.format("binaryFile").load(folders)
    spark = listing.sparkSession
    names = spark._jvm.org.apache.hadoop.util.StringUtils.join("\n", listing._jdf.inputFiles())  # encoded, and so without newlines; one call for all
    path = F.regexp_replace(_decoded(F.col("name")), "^([^/]*:)//(?=/)", "$1")
    listed = spark.createDataFrame([(name,) for name in names.split("\n") if name], "name string").select(path.alias("path"))
    return listed.join(listing.select("path"), "path", "left_anti")


def scan_trajectories(spark: SparkSession, root: str | list[str], observation: Observation | None = None) -> DataFrame:
    """Every document of a tree ``step_N/phase/<id>.json``: step, phase, id, the document, path, and `reason`, null if it could be read.

    Files of other names and folders are not read. A document is rejected if it is empty, no JSON, no object, or if a field has
    another type than the schema gives it; its fields are null then. An observation counts n_read and n_rejected as the scan runs. root may be a
    list of folders ``.../step_N/phase``.
    """
    folders = [f"{root}/step_*/*"] if isinstance(root, str) else root
    reader, of_folders = _folder_files(spark, folders, ".json")
    empty = _empty_files(reader, folders).select(F.lit("").alias("value"), "path")
    filled = reader.text(folders, wholetext=True).select("value", file_path().alias("path"))
    whole = filled.unionByName(empty).where(of_folders)
    document = F.from_json("value", f"{TRAJECTORY}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    kind = F.schema_of_variant(F.try_parse_json("value"))
    reason = (
        F.when(strip(F.col("value")) == "", "empty file")
        .when(F.col("kind").isNull(), "not a JSON document")
        .when(~F.col("kind").startswith("OBJECT"), "not an object")
        .when(F.col("document").isNull() | F.col("document._corrupt").isNotNull(), "a field has an unexpected type")
    )
    parts = F.split("path", "/")
    fields = [c for c in spark.createDataFrame([], TRAJECTORY).columns]
    # worked out once a document, not once a field
    rows = whole.withColumns({"document": document, "kind": kind}).withColumn("reason", reason).select(
        step_number(F.element_at(parts, -3)).alias("step"),
        F.element_at(parts, -2).alias("phase"),
        F.regexp_replace(F.element_at(parts, -1), r"\.json$", "").alias("id"),
        *[F.when(F.col("reason").isNull(), F.col("document")[c]).alias(c) for c in fields],
        "path",
        "reason",
    )
    return rows if observation is None else rows.observe(observation, F.count("*").alias("n_read"), F.count("reason").alias("n_rejected"))


def rejects(scan: DataFrame) -> DataFrame:
    """path, reason of the documents that could not be read."""
    return scan.where("reason is not null").select("path", "reason")


def read_trajectories(spark: SparkSession, root: str | list[str], observation: Observation | None = None) -> DataFrame:
    """The documents of `scan_trajectories` that could be read: step, phase, id and their fields; `rejects` has the others."""
    return scan_trajectories(spark, root, observation).where("reason is null").drop("path", "reason")


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) in Hadoop's terms."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _listed(spark: SparkSession, glob: str) -> list[str]:
    fs, path = _hadoop(spark, glob)
    return sorted(str(s.getPath().toUri().getPath()) for s in fs.globStatus(path) or [] if s.isDirectory())


def convert_trajectories(spark: SparkSession, root: str, store: str) -> list[str]:
    """Take the folders ``step_N/phase`` of a tree that the store does not have yet into Parquet by step, phase and folder; returns them.

    Folders that were taken before are not read again. A run that failed is repeated: what it left is overwritten. Rejected documents
    go to ``<store>/_rejects`` with their paths.
    """
    base = str(_hadoop(spark, root)[1].toUri().getPath()).rstrip("/")
    new = []
    for folder in _listed(spark, f"{root.rstrip('/')}/step_*/*"):
        step, phase = folder[len(base) + 1 :].split("/")[-2:]
        fs, done = _hadoop(spark, f"{store}/_taken/{step}/{phase}")
        if not fs.exists(done):
            new.append((folder, done))
    if new:
        scheme = root[: root.index(base)] if base in root else ""
        scan = written(scan_trajectories(spark, [scheme + folder for folder, _ in new]), "scan")
        folder = F.element_at(F.split("path", "/"), -3)
        good = scan.where("reason is null").withColumn("folder", folder).drop("path", "reason")
        good.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step", "phase", "folder").parquet(store)
        rejects(scan).write.mode("append").parquet(f"{store}/_rejects")
        for _, done in new:
            _hadoop(spark, store)[0].mkdirs(done)
    return [folder for folder, _ in new]


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """The store's documents; filters on step, phase and folder leave the other folders unread."""
    return spark.read.schema(f"id string, {TRAJECTORY}, step int, phase string, folder string").parquet(store)


def _filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), os.path.abspath(uri))


def write_files(df: DataFrame, root: str, laid_out: Callable[[str], str] = str) -> None:
    """A text file ``root/name`` for each row (name, body, which `laid_out` may lay out anew), on any file system that pyarrow knows;
    renamed when whole, so that a retried task leaves no half file. Rows are taken one by one: a task's memory does not depend on their
    number. root is a folder that all executors share."""

    def save(rows: Iterator[Row]) -> None:
        store, base = _filesystem(root)
        for row in rows:
            name = f"{base}/{row['name']}"
            store.create_dir(os.path.dirname(name), recursive=True)
            beside = f"{name}.{uuid.uuid4().hex}.tmp"
            with store.open_output_stream(beside) as out:
                out.write(laid_out(row["body"]).encode())
            store.move(beside, name)

    df.select("name", "body").foreachPartition(save)


def write_trajectories(df: DataFrame, root: str) -> None:
    """One indented JSON file per row at ``step_N/phase/<instance_id>_<repetition_id>.json``, and an ``.error`` text where `error` is set."""
    names = [c for c in df.columns if c not in ("step", "phase", "repetition_id", "error")]

    def laid_out(body: str) -> str:
        known = json.loads(body)  # read again for the fields' order and the indent that readers of these files expect
        return json.dumps({n: known.get(n) for n in names}, indent=2, ensure_ascii=False)

    stem = F.concat(F.lit("step_"), "step", F.lit("/"), "phase", F.lit("/"), "instance_id", F.lit("_"), "repetition_id")
    good = df.where("error is null").select(F.concat(stem, F.lit(".json")).alias("name"), F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("body"))
    write_files(good, root, laid_out)
    write_files(df.where("error is not null").select(F.concat(stem, F.lit(".error")).alias("name"), F.col("error").alias("body")), root)


def write_errors(df: DataFrame, path: str) -> None:
    df.where("error is not null").select("error").write.mode("overwrite").text(path)


def write_report_csv(report: DataFrame, path: str, *order: str) -> None:
    """One CSV file ``path/report.csv`` with a header, sorted, as a report is read from the top.

    Tasks write sorted parts by range; the header and the parts are then joined into one file on their file system, in small buffers.
    """
    spark, parts = report.sparkSession, int(report.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    beside = scratch_folder(spark, "csv-parts")
    report.limit(0).coalesce(1).write.option("header", True).csv(f"{beside}/header")
    report.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.csv(f"{beside}/rows")
    fs, folder = _hadoop(spark, path)
    fs.delete(folder, True)
    copy = spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/report.csv"))
    for kind in ("header", "rows"):
        source, glob = _hadoop(spark, f"{beside}/{kind}/part-*")
        for part in sorted(str(s.getPath()) for s in source.globStatus(glob)):
            copy(source.open(spark._jvm.org.apache.hadoop.fs.Path(part)), out, 1 << 20, False)
    out.close()
    source.delete(spark._jvm.org.apache.hadoop.fs.Path(beside), True)


def write_events_jsonl(events: DataFrame, path: str) -> None:
    events.write.mode("overwrite").json(path)


def search_lines(files: DataFrame, pattern: str, include: str | None = None, limit: int = 100) -> DataFrame:
    """files (path, content) to the first hits path, line, text in order, as a top-k."""
    chosen = files if include is None else files.where(F.regexp_extract("path", "[^/]*$", 0).like(include.replace("_", r"\_").replace("*", "%").replace("?", "_")))
    lines = chosen.select("path", F.posexplode(F.split("content", "\n")).alias("i", "text")).where(F.col("text").rlike(pattern))
    return lines.select("path", (F.col("i") + 1).alias("line"), "text").orderBy("path", "line").limit(limit)


def read_texts(spark: SparkSession, glob: str) -> DataFrame:
    """path, content of whole text files; `search_files` is for files that no row should hold whole."""
    return spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def search_files(spark: SparkSession, root: str, pattern: str, include: str | None = None, limit: int = 100) -> DataFrame:
    """The first hits path, line, text of a regular expression in the files below a folder, in order; files are split as Spark splits them.

    A first pass counts each split's lines (a row per split), so that a hit's line number is its place in its split and what lies
    before it in its file. Lines end in newlines; `include` is a glob on file names.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n")
    reader = reader if include is None else reader.option("pathGlobFilter", include)
    lines = reader.text(root).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    splits = lines.groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("_file", "_start", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    hits = lines.where(F.col("value").rlike(pattern)).join(splits, ["_file", "_start"])
    path = F.url_decode(F.replace("_file", F.lit("+"), F.lit("%2B")))
    found = hits.select(path.alias("path"), (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line"), F.col("value").alias("text"))
    return found.orderBy("path", "line").limit(limit)


def hit_files(hits: DataFrame, line_col: str = "hit", cap: int = 20) -> DataFrame:
    """One row on the distinct files of ``path:line:text`` hits: their number, the first `cap` in order, a display of those."""
    files = hits.select(hit_file(F.col(line_col)).alias("file")).distinct()
    first = files.orderBy("file").limit(cap).agg(F.array_sort(F.collect_list("file")).alias("files"))
    more = F.when(F.col("n_files") > cap, F.lit("\n...")).otherwise(F.lit(""))
    return files.agg(F.count("*").alias("n_files")).crossJoin(first).select("files", "n_files", F.concat(F.concat_ws("\n", "files"), more).alias("display"))  # one row each


def snapshot(spark: SparkSession, events: list[dict]) -> DataFrame:
    """An in-memory event log under the fixed schema; missing fields are null."""
    schema = EVENT_ROW
    names = [c.strip().split(" ", 1)[0] for c in spark.createDataFrame([], schema).columns]
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in events], schema)


def display(items, cap: int):
    """The first items, one a line, and an ellipsis if there are more."""
    return F.concat(F.concat_ws("\n", F.slice(items, 1, cap)), F.when(F.size(items) > cap, F.lit("\n...")).otherwise(F.lit("")))


def list_directory(spark: SparkSession, root: str) -> DataFrame:
    """One row on a folder's files: n_files, n_python (of all depths), the first ten paths."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    first = found.orderBy("path").limit(10).agg(F.array_sort(F.collect_list("path")).alias("first"))
    return found.agg(F.count("*").alias("n_files"), F.count_if(F.col("path").endswith(".py")).alias("n_python")).crossJoin(first)  # one row each
