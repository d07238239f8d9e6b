"""Unified diffs to edit locations, each inside its row: no shuffle, no join, and rows that share an id stay apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import RANGE_ROWS, carried
from .text import let, strip

HUNK = r"@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"
SIDES = ("old_start", "old_count", "new_start", "new_count")


def _side(words: Column, place: int) -> tuple[Column, Column]:
    """start and count (1 if it is left out) of one side of a hunk line's words ``@@ -1,2 +3,4 @@``."""
    word = F.get(words, F.lit(place))
    start = F.substring(F.substring_index(word, ",", 1), 2, 1 << 30)
    return start.cast("int"), F.when(word.contains(","), F.substring_index(word, ",", -1)).otherwise("1").cast("int")


def _sides(words: Column) -> list[Column]:
    return [c.alias(n) for c, n in zip([*_side(words, 1), *_side(words, 2)], SIDES, strict=True)]


def old_side_hunks(patch: Column) -> Column:
    """ARRAY<STRUCT<file, old_start, old_count>> of a patch, in its order; empty without hunks.

    A header line ``+++ b/...`` names the file; a deleted file's header does not, so its hunks count for the file before,
    or for none. An added line that reads ``++ b/...`` is taken for a header.
    """
    sections = F.split(strip(F.coalesce(patch, F.lit(""))), r"(?m)^\+\+\+ b/")
    named = F.filter(sections, lambda s, i: (i > 0) & ~s.rlike(r"^[\r\n]|^$"))

    def of(section: Column) -> Column:
        file = F.regexp_extract(section, r"^[^\r\n]*", 0)
        found = F.regexp_extract_all(section, F.lit("(?m)^" + HUNK), F.lit(0))
        one = lambda file, h: let(F.split(h, " "), lambda w: F.struct(file.alias("file"), *_sides(w)[:2]))
        return let(file, lambda name: F.transform(found, lambda h: one(name, h)))

    return F.flatten(F.transform(named, of))


def by_file(items: Column) -> Column:
    """ARRAY<ARRAY<item>> of items with a `file`: a list for each file, files in the order of their first item; one sort of the row."""
    keyed = F.sort_array(F.transform(items, lambda x, i: F.struct(x["file"].alias("file"), i.alias("i"), x.alias("x"))))

    def lists(s: Column) -> Column:
        begins = F.array_compact(F.transform(s, lambda x, j: F.when((j == 0) | (F.get(s, j - 1)["file"] != x["file"]), j)))
        end = lambda at, k: F.coalesce(F.get(at, k + 1), F.size(s))
        each = lambda at: F.transform(at, lambda j, k: F.struct(F.get(s, j)["i"].alias("i"), F.transform(F.slice(s, j + 1, end(at, k) - j), lambda m: m["x"]).alias("items")))
        return let(begins, each)

    return F.transform(F.sort_array(let(keyed, lists)), lambda g: g["items"])


def in_order_of_files(hunks: Column) -> Column:
    """Hunks file by file, files in the order of their first hunk."""
    return F.flatten(by_file(hunks))


def old_side_targets(instances: DataFrame, id_col: str = "instance_id", patch_col: str = "patch") -> DataFrame:
    """instance_id, file, hunk_pos, old_start, old_count: one row per hunk, numbered in the order of the patch."""
    rows = instances.select(F.col(id_col).alias("instance_id"), F.posexplode(old_side_hunks(F.col(patch_col))).alias("hunk_pos", "h"))
    return rows.select("instance_id", "h.file", "hunk_pos", "h.old_start", "h.old_count")


def targets_column(instances: DataFrame, id_col: str = "instance_id", patch_col: str = "patch") -> DataFrame:
    """instances with target ARRAY<STRUCT<file, old_start, old_count>>, files in the order of their first hunk; empty without hunks."""
    return instances.withColumn("target", old_side_hunks(F.col(patch_col))).withColumn("target", in_order_of_files(F.col("target")))


def parsed_files(patch: Column) -> Column:
    """ARRAY<STRUCT<file, hunks ARRAY<STRUCT<four numbers>>>> from per-file chunks of a patch.

    A chunk starts at a ``diff --git`` line; its path is the b-side of its first ``a/x b/y``; hunks are looked for anywhere in
    it; chunks without a hunk are dropped.
    """
    one = lambda h: let(F.split(h, " "), lambda w: F.struct(*_sides(w)))
    chunk = lambda c: F.struct(
        F.regexp_extract(c, r"(?d)a/(.+?) b/(.+)", 2).alias("file"), F.transform(F.regexp_extract_all(c, F.lit(HUNK), F.lit(0)), one).alias("hunks")
    )
    chunks = F.transform(F.split(F.coalesce(patch, F.lit("")), r"(?md)^diff --git "), chunk)
    return F.filter(chunks, lambda c: (c["file"] != "") & (F.size(c["hunks"]) > 0))


def last_of_each(files: Column) -> Column:
    """Of chunks of one path the last counts, in the place of the first."""
    apart = lambda fs: F.size(F.array_distinct(F.transform(fs, lambda f: f["file"]))) == F.size(fs)
    return let(files, lambda fs: F.when(apart(fs), fs).otherwise(F.transform(by_file(fs), lambda g: F.element_at(g, -1))))


def spans(hunks: Column) -> Column:
    """struct(old_start, old_count, new_start, new_count, hunks): from the first line of any hunk to the last, on both sides."""
    start = lambda side: F.array_min(F.transform(hunks, lambda h: h[f"{side}_start"]))
    end = lambda side: F.array_max(F.transform(hunks, lambda h: h[f"{side}_start"] + h[f"{side}_count"] - 1))
    ends = F.struct(*[c for side in ("old", "new") for c in (start(side).alias(f"{side}_start"), end(side).alias(f"{side}_end"))])
    sides = lambda e: [c for side in ("old", "new") for c in (e[f"{side}_start"].alias(f"{side}_start"), (e[f"{side}_end"] - e[f"{side}_start"] + 1).alias(f"{side}_count"))]
    return let(ends, lambda e: F.struct(*sides(e), hunks.alias("hunks")))


def patch_map(patch: Column) -> Column:
    """MAP<path, STRUCT<spans, hunks>> of a patch."""
    return F.map_from_entries(F.transform(last_of_each(parsed_files(patch)), lambda f: F.struct(f["file"], spans(f["hunks"]))))


def with_patch_info(instances: DataFrame, patch_col: str = "patch") -> DataFrame:
    return instances.withColumn("patch_info", patch_map(F.col(patch_col)))


def patch_lines(instances: DataFrame, id_col: str = "instance_id", patch_col: str = "patch") -> DataFrame:
    """instance_id, pos, line: a patch as a long table."""
    lines = F.split(strip(F.coalesce(patch_col, F.lit(""))), "\r\n|\r|\n")
    return instances.select(F.col(id_col).alias("instance_id"), F.posexplode(lines).alias("pos", "line"))


def targets_of_lines(lines: DataFrame, range_rows: int = RANGE_ROWS, parts: int | None = None) -> DataFrame:
    """instance_id, pos, file, old_start, old_count of each hunk in a long table of lines, as `old_side_hunks` finds them in a text.

    For patches that no row should hold whole: the file is carried forward over the lines (a header without a name carries none).
    """
    line = F.col("line")
    header = F.when(line.startswith("+++ b/"), F.struct(F.nullif(F.expr("substring(line, 7)"), F.lit("")).alias("name")))
    known = carried(lines.where(line.startswith("+++ b/") | line.startswith("@@ -")), "instance_id", "pos", {"in": header}, range_rows, parts)
    hunk = known.where(F.col("line").rlike("^" + HUNK) & F.col("in.name").isNotNull())
    words = F.split(F.regexp_extract(line, "^" + HUNK, 0), " ")
    return hunk.select("instance_id", "pos", F.col("in.name").alias("file"), *_sides(words)[:2])


def with_files(instances: DataFrame, id_col: str, patch_col: str) -> DataFrame:
    rows = instances.select(F.col(id_col).alias("instance_id"), parsed_files(F.col(patch_col)).alias("files"))
    return rows.select("instance_id", F.posexplode(last_of_each(F.col("files"))).alias("file_pos", "f"))


def file_hunks(instances: DataFrame, id_col: str = "instance_id", patch_col: str = "patch") -> DataFrame:
    """instance_id, file, file_pos, hunk_pos, old_start, old_count, new_start, new_count: one row per hunk."""
    rows = with_files(instances, id_col, patch_col).select("instance_id", "f.file", "file_pos", F.posexplode("f.hunks").alias("hunk_pos", "h"))
    return rows.select("instance_id", "file", "file_pos", "hunk_pos", "h.*")


def file_extents(instances: DataFrame, id_col: str = "instance_id", patch_col: str = "patch") -> DataFrame:
    """instance_id, file, the span of its hunks on both sides, n_hunks: one row per file of a patch."""
    rows = with_files(instances, id_col, patch_col).select("instance_id", "f.file", spans(F.col("f.hunks")).alias("s"))
    sides = [f"s.{side}_{what}" for side in ("old", "new") for what in ("start", "count")]
    return rows.select("instance_id", "file", *sides, F.size("s.hunks").cast("long").alias("n_hunks"))
