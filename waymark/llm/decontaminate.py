"""Benchmark decontamination by spaced seeds: fixed masks ignore some token positions; hits are verified around them.

A document leaks a benchmark item if some WINDOW aligned words of both agree in all but SUBSTITUTIONS places. Words
are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased. The masks are chosen so that every window with so few substitutions
holds a hit of one of them (a test enumerates them all). Items of fewer than WINDOW words must appear whole and
unchanged; items of fewer than SHORTEST words are too short to tell a leak from common speech and match nothing.

The hashes of the benchmark and of the documents meet in a join; a bitmap, sized by the number of seeds up to 2**MOST_BITS bits,
first drops most document positions that can't meet. A benchmark of more than PASS_SEEDS seeds is taken in as many passes, each with
the seeds of some hashes and its own bitmap, so that it drops as much as a small one does. Each hit carries the words around it, so that
texts are not shuffled. A seed stands for the contexts that it has in the items (the words around it), each once: what many items share,
such as a common instruction, meets a document once, is verified once, and only verified contexts are spread over the items that
have them. The benchmark's side is broadcast only if its measured bytes allow it; otherwise the joins shuffle and Spark splits hot keys.

Null or empty texts leak nothing. Verdicts are by row (id and text): a leaking row with a null or repeated id says nothing about
another text under that id. Rows repeated with id and text are reported each. Null item ids match too. Texts and items may
be of any length: work and rows are in proportion to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared, words

WINDOW, SUBSTITUTIONS, SHORTEST = 13, 2, 8
#: Word positions that each mask looks at.
MASKS = [[0, 1, 2, 3, 5, 6, 7], [0, 1, 2, 4, 7, 8, 9], [0, 1, 2, 3, 4, 5, 6], [0, 1, 2, 4, 5, 6, 7]]
LEAST_BITS, MOST_BITS = 16, 26
#: Seeds of one pass over the documents, about: they fill at most one bit in 32 of the largest bitmap.
PASS_SEEDS = 1 << 20
BLOCK_BYTES = 4 << 20
#: Starts of an item that are cut into one batch.
STARTS = 4096
HITS = "hash long, doc_id long, mark long, at int, before int, near binary"


def masks() -> list[tuple[int, list[int]]]:
    """(seed, offsets): the spaced masks, then a solid one for each length of a short item."""
    return [*enumerate(MASKS, 1), *((100 + n, list(range(n))) for n in range(SHORTEST, WINDOW))]


def keyed_items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    item = F.col(item_col).cast("long")
    return benchmark.select(F.xxhash64(item, F.col(text_col)).alias("item"), item.alias("item_id"), F.col(text_col))


def around(flat: np.ndarray, first: np.ndarray, stop: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(words before the place, words around it as bytes): WINDOW to both sides, inside the text [first, stop)."""
    left, right = np.maximum(first, at - WINDOW), np.minimum(stop, at + WINDOW)
    return (at - left).astype(np.int32), pa.array([flat[a:b].tobytes() for a, b in zip(left.tolist(), right.tolist(), strict=True)], pa.binary())


PLACES = "item long, item_id long, at int, window int, before int, near binary, hashes array<long>"


def places(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """A row for each start in each item: item (a key), item_id, at, its context (window: WINDOW, or a short item's words; before, near), the hash of each mask from there, context (a key)."""
    names = [c.split()[0] for c in PLACES.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, counts = words.hashed(batch.column(2))
            for row, (count, end) in enumerate(zip(counts.tolist(), np.cumsum(counts).tolist(), strict=True)):
                own = flat[end - count : end]
                by_mask = [words.gapped(own, offsets, seed).view(np.int64) for seed, offsets in masks() if (count >= WINDOW if seed < 100 else count == len(offsets))]
                for start in range(0, count if count >= SHORTEST else 0, STARTS):
                    at = np.arange(start, min(start + STARTS, count))
                    n = len(at)
                    before, near = around(own, np.zeros(n, np.int64), np.full(n, count), at)
                    held = [h[start : start + n] for h in by_mask]
                    sizes = sum((np.arange(n) < len(h)).astype(np.int32) for h in held)
                    edges = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                    order = np.argsort(np.concatenate([np.arange(len(h)) for h in held]), kind="stable")
                    hashes = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(held)[order]))
                    item, item_id = (batch.column(i).take(pa.array(np.full(n, row))) for i in range(2))
                    columns = [item, item_id, pa.array(at.astype(np.int32)), pa.array(np.full(n, min(count, WINDOW), np.int32)), pa.array(before), near, hashes]
                    yield pa.RecordBatch.from_arrays(columns, names)

    rows = keyed_items(benchmark, item_col, text_col)
    found = rows.mapInArrow(shared.lean(cut), PLACES).dropDuplicates(["item", "at"])
    return shared.stage(found.withColumn("context", F.xxhash64("window", "before", "near")), "benchmark-places")


def contexts(place_rows: DataFrame) -> DataFrame:
    """context, window, item_before, item_near, hashes: what one or many items have around a place, once."""
    rows = place_rows.dropDuplicates(["context", "window", "before", "near"])
    return shared.stage(rows.select("context", "window", F.col("before").alias("item_before"), F.col("near").alias("item_near"), "hashes"), "benchmark-contexts")


def seeds(context_rows: DataFrame) -> DataFrame:
    """hash, of (a context): a row for each mask in each context."""
    return shared.stage(context_rows.select(F.explode("hashes").alias("hash"), F.col("context").alias("of")).distinct(), "benchmark-seeds")


def turn(hashes, passes: int):
    """The pass that a hash is looked up in."""
    return hashes % np.uint64(passes)


def bitmap(seed_rows: DataFrame, n_seeds: int) -> tuple[int, np.ndarray]:
    """(bits of an index, bytes): about 64 bits a seed up to 2**MOST_BITS, two set for each hash; a row for every 64 comes to the driver."""
    bits = min(max((64 * n_seeds).bit_length(), LEAST_BITS), MOST_BITS)
    bit = F.explode(F.array(F.col("hash").bitwiseAND(F.lit((1 << bits) - 1)), F.shiftrightunsigned("hash", 64 - bits)))
    found = seed_rows.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("bits"))
    rows, out = found.toArrow(), np.zeros(1 << (bits - 6), np.int64)
    out[np.asarray(rows["word"], np.int64)] = np.asarray(rows["bits"], np.int64)
    return bits, out.view(np.uint8)


def hits(docs: DataFrame, seed_rows: DataFrame, n_seeds: int, at_pass: int = 0, passes: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Document positions whose hash may be a seed's of this pass, with the words around them."""
    packed = shared.sent(docs.sparkSession, bitmap(seed_rows, n_seeds))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = packed.value
        low, high = np.uint64((1 << bits) - 1), np.uint64(64 - bits)
        is_set = lambda i: known[i >> np.uint64(3)] >> (i & np.uint64(7)).astype(np.uint8) & np.uint8(1)
        for group in shared.blocks(batches, 2, BLOCK_BYTES):
            for batch in group:
                flat, counts = words.hashed(batch.column(2))
                ends = np.cumsum(counts)
                for seed, offsets in masks():
                    h = words.gapped(flat, offsets, seed)
                    at = np.flatnonzero(is_set(h & low))
                    at = at[is_set(h[at] >> high).astype(bool)]
                    if passes > 1:
                        at = at[turn(h[at] >> np.uint64(1), passes) == at_pass]
                    doc = np.searchsorted(ends, at, "right")
                    inside = at + max(offsets) < ends[doc] if len(at) else np.zeros(0, bool)
                    at, doc = at[inside], doc[inside]
                    if not len(at):
                        continue
                    first, row = ends[doc] - counts[doc], pa.array(doc)
                    before, near = around(flat, first, ends[doc], at)
                    columns = [pa.array(h[at].view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), pa.array((at - first).astype(np.int32)), pa.array(before), near]
                    yield pa.RecordBatch.from_arrays(columns, ["hash", "doc_id", "mark", "at", "before", "near"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col))
    return rows.mapInArrow(shared.lean(probe), HITS)


def best_window(doc: np.ndarray, before: int, item: np.ndarray, item_before: int, window: int) -> int:
    """Agreeing words of the best window (so many words) around a hit that puts doc[before] on item[item_before]; 0 if none will do."""
    allowed = SUBSTITUTIONS if window >= WINDOW else 0
    left, right = min(before, item_before, window), min(len(doc) - before, len(item) - item_before, window)
    agrees = doc[before - left : before + right] == item[item_before - left : item_before + right]
    same = np.concatenate(([0], np.cumsum(agrees)))
    agreeing = same[window:] - same[:-window] if len(same) > window else np.zeros(0, int)
    if not len(agreeing) or agreeing.max() < window - allowed:
        return 0
    return int(agreeing.max())


def verified(docs: DataFrame, context_rows: DataFrame) -> DataFrame:
    """Verified places, one row per document, context and place in the document: doc_id, mark, context, at, n_agreeing."""
    seed_rows = seeds(context_rows)
    n_seeds = seed_rows.count()
    passes = max(1, -(-n_seeds // PASS_SEEDS))
    known = shared.checked_broadcast(context_rows.drop("hashes"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = ("near", "before", "item_near", "item_before", "window")
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in asked), strict=True)
            best = [best_window(np.frombuffer(near, np.uint64), before, np.frombuffer(item, np.uint64), item_before, n) for near, before, item, item_before, n in rows]
            agreeing = np.array(best, np.int64)
            keep = pa.array(agreeing > 0)
            out = [*(batch.column(c) for c in ("doc_id", "mark", "context", "at")), pa.array(agreeing)]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in out], ["doc_id", "mark", "context", "at", "n_agreeing"])

    found = None
    for k in range(passes):
        own = seed_rows.where(F.pmod(F.shiftrightunsigned("hash", 1), F.lit(passes)) == k) if passes > 1 else seed_rows
        met = hits(docs, own, -(-n_seeds // passes), k, passes).join(shared.checked_broadcast(own), "hash").join(known, F.col("of") == F.col("context"))
        met = met.mapInArrow(shared.lean(verify), "doc_id long, mark long, context long, at int, n_agreeing long")
        found = met if found is None else found.unionByName(met)
    return found.groupBy("doc_id", "mark", "context", "at").agg(F.max("n_agreeing").alias("n_agreeing"))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified overlaps, one row per document, item and alignment: doc_id, mark (hash of the text), item, item_id, doc_start (in words), n_agreeing."""
    rows = places(benchmark)
    found = verified(docs, contexts(rows))
    of = rows.select("item", "item_id", F.col("at").alias("item_at"), F.col("context").alias("of"))
    each = found.join(shared.checked_broadcast(of), F.col("context") == F.col("of"))
    start = (F.col("at") - F.col("item_at")).cast("long").alias("doc_start")  # where the item's first word lies
    return each.groupBy("doc_id", "mark", "item", "item_id", start).agg(F.max("n_agreeing").alias("n_agreeing"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per leaking document: doc_id, mark, n_items, first_item, n_agreeing (the best window's).

    Contexts of the same items are one group of items: a document meets each group once before items are counted.
    """
    rows = places(benchmark)
    found = verified(docs, contexts(rows))
    each = rows.select("context", "item", "item_id").distinct()
    groups = each.groupBy("context").agg(F.xxhash64(F.sum(F.xxhash64("item") % (1 << 40)), F.sum(F.xxhash64("item", F.lit(1)) % (1 << 40)), F.count("*")).alias("group"))
    groups = shared.stage(groups, "context-groups")
    members = shared.stage(each.join(groups, "context").select("group", "item", "item_id").distinct(), "group-members").withColumnRenamed("group", "of")
    met = found.join(shared.checked_broadcast(groups), "context").groupBy("doc_id", "mark", "group").agg(F.max("n_agreeing").alias("n_agreeing"))
    spread = met.join(shared.checked_broadcast(members), F.col("group") == F.col("of"))
    return spread.groupBy("doc_id", "mark").agg(F.count_distinct("item").alias("n_items"), F.min("item_id").alias("first_item"), F.max("n_agreeing").alias("n_agreeing"))


def named(found: DataFrame) -> DataFrame:
    return shared.checked_broadcast(shared.stage(found.withColumnsRenamed({"doc_id": "__leaking", "mark": "__mark"}), "leaks"))


def leaking_row() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("__leaking")) & (F.xxhash64("text") == F.col("__mark"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, without the rows that leak."""
    return docs.join(named(leaks(docs, benchmark).select("doc_id", "mark")), leaking_row(), "left_anti")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every document: doc_id, contaminated, n_items, first_item, n_agreeing."""
    rows = docs.select("doc_id", "text")
    joined = rows.join(named(leaks(rows, benchmark)), leaking_row(), "left")
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return joined.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), zero("n_items"), "first_item", zero("n_agreeing"))
