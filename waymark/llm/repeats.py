"""Suffix-array deduplication: removes every byte covered by a WINDOW-byte string that also starts earlier in the corpus.

Earlier means a smaller document id, or the same document and an earlier start; documents are UTF-8 bytes, matches do not
cross them, and strings are judged on the input. A window goes if its longest previous factor (LPF) has WINDOW bytes or
more: suffixes are sorted, and of each one's previous and next suffix in that order that starts earlier in the corpus
(PSV and NSV) the longer common prefix is its LPF. The corpus-wide order is needed only where suffixes can share WINDOW bytes,
so it is built in parts that Spark shuffles together:

1. Each window has an anchor: the GRAM-byte string of least hash inside it, which equal windows share. Anchors are rows
   (hash, document); those that occur once in the corpus leave their windows out of all further work.
2. A run of windows with one anchor is a context (WINDOW to WINDOW + 68 bytes). Contexts of the other anchors are cut out of the texts
   and dealt by anchor; there their suffix order and LPF array decide which windows go. Equal contexts have equal
   suffixes, so each distinct one is sorted once and stands in the order as often as it occurs.
3. An anchor of more than GROUP contexts is dealt to several groups. A window that is first in its group goes on to the
   next round, dealt by its own bytes, with one such window per group at most; rounds end when no key needs two groups.
   A passage in any share of the documents is so reduced GROUP-fold a round, its edges (each in another text) included.
4. Removed windows go back to their documents.

Hashes only leave work out; every removal is decided by an LPF value over the bytes.

Null or empty text: no bytes. A null id counts as the last. Rows repeated with one id and text are judged alike (neither
starts earlier than the other); different texts under one id compare by start. Very long texts are cut into contexts piece by
piece. Other columns pass through `deduplicate`. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .words import mixed, odd_constants, words_of_eight

WINDOW, GRAM = 100, 32
#: Bytes of a piece of a text, and of texts that are searched for anchors at once.
PIECE = 1 << 20
LAST = np.iinfo(np.int64).max
#: Windows whose suffixes a task sorts at once (more only where one group has more).
SORTED = 200_000
#: Contexts of an anchor in one group at most, on average.
GROUP = 1024
PLACE_BITS = 23


def window_hashes(data: np.ndarray, first: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Hashes of the `length` bytes at each place."""
    eight, places = words_of_eight(data), [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    total = np.zeros(len(first), np.uint64)
    for at, factor in zip(places, odd_constants(seed, len(places)), strict=True):
        total += eight[first + at] * factor
    return mixed(total)


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pieces laid end to end: for each run of windows with one anchor the first window, how many more, the anchor's hash."""
    n, reach = len(data), WINDOW - GRAM
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    eight = words_of_eight(data)
    gram = np.zeros(n - GRAM + 1, np.uint64)
    for k, factor in enumerate(odd_constants(11, GRAM // 8)):
        gram += eight[8 * k : 8 * k + len(gram)] * factor
    gram = mixed(gram)
    place = np.uint64((1 << PLACE_BITS) - 1)
    least = (gram & ~place) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while width <= reach:
        step = min(width, reach + 1 - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    at = (least & place).astype(np.int64)
    inside = np.ones(len(at), bool)
    for end in ends[:-1].tolist():
        inside[max(0, end - WINDOW + 1) : end] = False
    edge = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (inside[1:] != inside[:-1]))))
    last = np.append(edge[1:], len(at)) - 1
    keep = inside[edge]
    return edge[keep], (last - edge)[keep], gram[at[edge[keep]]]


def pieces_of(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[list[tuple]]:
    """Groups of (batch, row, base, bytes) of about PIECE bytes; windows start in one piece each."""
    group, held = [], 0
    for batch in batches:
        for row, text in enumerate(batch.column(text_at).cast(pa.binary()).to_pylist()):
            for base in range(0, max(0, len(text or b"") - WINDOW + 1), PIECE):
                group.append((batch, row, base, text[base : base + PIECE + WINDOW - 1]))
                held += len(group[-1][3])
                if held >= PIECE:
                    yield group
                    group, held = [], 0
    if group:
        yield group


def laid(group: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """data, and of each context: piece, first window in data, place of it in its text, further windows, anchor."""
    ends = np.cumsum([len(p[3]) for p in group])
    data = np.frombuffer(b"".join(p[3] for p in group), np.uint8)
    first, more, gram = anchors(data, ends)
    piece = np.searchsorted(ends, first, "right")
    shift = np.array([p[2] for p in group], np.int64) - np.concatenate(([0], ends[:-1]))
    return data, piece, first, first + shift[piece], more, gram


def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to a row (gram, key) for each context."""
    for group in pieces_of(batches, 1):
        _, piece, _, _, _, gram = laid(group)
        keys = np.array([batch.column(0)[row].as_py() for batch, row, _, _ in group], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(keys[piece])], ["gram", "key"])


DEALT = "part long, salt int, groups long, doc long, key long, at long, bytes binary"
DEALT_ARROW = pa.schema([("part", pa.int64()), ("salt", pa.int32()), ("groups", pa.int64()), ("doc", pa.int64()), ("key", pa.int64()), ("at", pa.int64()), ("bytes", pa.binary())])


def salted(groups: np.ndarray, key: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (mixed(key.view(np.uint64) + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % groups.astype(np.uint64)).astype(np.int32)


def binary(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """data[start : start + size] of each, as a binary column."""
    edges = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(edges), pa.py_buffer(data[shared.ragged(starts, sizes)])])


def cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, key, text, asked: gram and copies of the anchors that occur more than once) to the contexts of those anchors."""
    for group in pieces_of(batches, 2):
        data, piece, first, at, more, gram = laid(group)
        names, copies = [], []
        for i, (batch, row, _, _) in enumerate(group):
            asked = batch.column(3)[row].values
            names.append(mixed(np.asarray(asked.field(0), np.int64).view(np.uint64) ^ np.uint64(i + 1)))
            copies.append(np.asarray(asked.field(1), np.int64))
        names, copies = np.concatenate(names), np.concatenate(copies)
        order = np.argsort(names)
        names, copies = names[order], copies[order]
        own = mixed(gram ^ (piece + 1).astype(np.uint64))
        found = np.minimum(np.searchsorted(names, own), len(names) - 1)
        keep = np.flatnonzero(names[found] == own)
        if not len(keep):
            continue
        groups = -(-copies[found[keep]] // GROUP)
        key = np.array([batch.column(1)[row].as_py() for batch, row, _, _ in group], np.int64)[piece[keep]]
        doc = pa.array([batch.column(0)[row].as_py() for batch, row, _, _ in group], pa.int64()).take(pa.array(piece[keep]))
        columns = [pa.array(gram[keep].view(np.int64)), pa.array(salted(groups, key, at[keep])), pa.array(groups), doc, pa.array(key), pa.array(at[keep])]
        yield pa.RecordBatch.from_arrays([*columns, binary(data, first[keep], more[keep] + WINDOW)], schema=DEALT_ARROW)


def longest_previous(position: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """The LPF array of suffixes in order: `position` of each in the corpus, `shares` its common prefix with the one before.

    Values under WINDOW are not told apart (0). Previous smaller values are found by halving steps over minima of 1, 2, 4, ...
    suffixes, so that no input makes it slow; next smaller values are the same from the other end.
    """
    shares = np.where(shares >= WINDOW, shares, 0).astype(np.int32)
    if not len(position):
        return shares
    cuts = np.append(np.flatnonzero(shares == 0), len(shares))
    levels = int(np.diff(cuts).max()).bit_length()

    def one_side(position: np.ndarray, shares: np.ndarray) -> np.ndarray:
        least, shared_by = [position], [shares]
        for k in range(levels):
            for table in (least, shared_by):
                wide = table[-1].copy()
                wide[1 << k :] = np.minimum(table[-1][1 << k :], table[-1][: -(1 << k)])
                table.append(wide)
        at, low = np.arange(len(position)) - 1, shares.copy()
        for k in range(levels, -1, -1):
            skip = np.flatnonzero((at >= 0) & (low > 0))
            skip = skip[least[k][at[skip]] >= position[skip]]
            low[skip] = np.minimum(low[skip], shared_by[k][at[skip]])
            at[skip] -= 1 << k
        return np.where((at >= 0) & (position[np.maximum(at, 0)] < position), low, 0)

    after = np.concatenate((shares[:1] * 0, shares[:0:-1]))
    return np.maximum(one_side(position, shares), one_side(position[::-1], after)[::-1])


def suffix_order(texts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, step, shares) of the windows of distinct contexts in suffix order; texts holds a context a row, zeros after it.

    A window whose hash no other has shares WINDOW bytes with nothing: it stands at the end, unsorted, sharing 0.
    """
    width, most = texts.shape[1], int(sizes.max())
    context = np.repeat(np.arange(len(sizes)), sizes - WINDOW + 1)
    step = shared.ragged(np.zeros(len(sizes), np.int64), sizes - WINDOW + 1)
    first, flat = context * width + step, texts.ravel()
    _, inverse, count = np.unique(window_hashes(flat, first, WINDOW, 12), return_inverse=True, return_counts=True)
    some = np.flatnonzero(count[inverse] > 1)
    shares = np.zeros(len(first), np.int32)
    if not len(some):
        return context, step, shares
    suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, most)[first[some]])
    order = np.argsort(suffixes.view(f"S{most}").ravel(), kind="stable")
    left = (sizes[context] - step)[some[order]]
    for a in range(1, len(order), 1 << 16):
        z = min(a + (1 << 16), len(order))
        differ = suffixes[order[a:z]] != suffixes[order[a - 1 : z - 1]]
        common = np.where(differ.any(1), differ.argmax(1), most)
        shares[a:z] = np.minimum(common, np.minimum(left[a:z], left[a - 1 : z - 1]))
    sequence = np.concatenate((some[order], np.flatnonzero(count[inverse] == 1)))
    return context[sequence], step[sequence], shares


def judged(column: pa.Array, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, step, goes) of every window of the contexts in the column, context by context."""
    encoded = column.dictionary_encode()
    code, distinct = np.asarray(encoded.indices, np.int64), encoded.dictionary
    sizes = np.asarray(pa.compute.binary_length(distinct), np.int64)
    width = 2 * int(sizes.max())
    texts = np.zeros((len(sizes), width), np.uint8)
    held = np.frombuffer(b"".join(distinct.to_pylist()), np.uint8)
    texts.ravel()[shared.ragged(np.arange(len(sizes)) * width, sizes)] = held
    d_context, d_step, d_shares = suffix_order(texts, sizes)
    # every occurrence of a context has its own suffixes: equal ones follow each other and share all they have
    n_of = np.bincount(code, minlength=len(sizes))
    occurrence, starts = np.argsort(code, kind="stable"), np.cumsum(n_of) - n_of
    repeat = n_of[d_context]
    context = occurrence[shared.ragged(starts[d_context], repeat)]
    step = np.repeat(d_step, repeat)
    shares = np.repeat(sizes[d_context] - d_step, repeat)
    shares[np.cumsum(repeat) - repeat] = d_shares
    _, rank = np.unique(doc, return_inverse=True)
    lpf = longest_previous((rank.astype(np.int64) << 40)[context] + at[context] + step, shares)
    windows = sizes[code] - WINDOW + 1
    base = np.cumsum(windows) - windows
    goes = np.zeros(int(windows.sum()), bool)
    goes[base[context] + step] = lpf >= WINDOW
    return np.repeat(np.arange(len(code)), windows), shared.ragged(np.zeros(len(code), np.int64), windows), goes


ROUND = "doc long, key long, start long, stop long, part long, salt int, groups long, bytes binary"
ROUND_NAMES = ["doc", "key", "start", "stop", "part", "salt", "groups", "bytes"]


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dealt contexts, sorted by part and salt, to ranges of windows that go, and windows that go on to the next round (with bytes)."""
    for table in whole_groups(batches):
        doc_column = table.column(3)
        doc, groups, key, at = np.asarray(doc_column.fill_null(LAST), np.int64), *(np.asarray(table.column(i), np.int64) for i in (2, 4, 5))
        context, step, goes = judged(table.column(6), doc, at)
        joined = goes[1:] & goes[:-1] & (context[1:] == context[:-1])
        first, last = np.flatnonzero(goes & ~np.concatenate(([False], joined))), np.flatnonzero(goes & ~np.concatenate((joined, [False])))
        own = context[first]
        none = pa.nulls(len(own))
        columns = [doc_column.take(pa.array(own)), pa.array(key[own]), pa.array(at[own] + step[first]), pa.array(at[own] + step[last])]
        yield pa.RecordBatch.from_arrays([*columns, *(none.cast(t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ROUND_NAMES)
        stay = np.flatnonzero(~goes & (groups[context] > 1))
        if len(stay):
            own, where = context[stay], at[context[stay]] + step[stay]
            data = np.frombuffer(b"".join(table.column(6).to_pylist()), np.uint8)
            sizes = np.asarray(pa.compute.binary_length(table.column(6)), np.int64)
            starts = (np.cumsum(sizes) - sizes)[own] + step[stay]
            part, fewer = window_hashes(data, starts, WINDOW, 13).view(np.int64), -(-groups[own] // GROUP)
            columns = [doc_column.take(pa.array(own)), pa.array(key[own]), pa.array(where), pa.array(where), pa.array(part), pa.array(salted(fewer, key[own], where)), pa.array(fewer)]
            yield pa.RecordBatch.from_arrays([*columns, binary(data, starts, np.full(len(stay), WINDOW))], ROUND_NAMES)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted batches laid together and cut between groups (part, salt), about SORTED windows each."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += pa.compute.sum(pa.compute.binary_length(batch.column(6))).as_py() - (WINDOW - 1) * batch.num_rows if batch.num_rows else 0
        if n >= SORTED:
            table = pa.concat_batches(held)
            part, salt = np.asarray(table.column(0)), np.asarray(table.column(1))
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (salt[1:] != salt[:-1])) + 1
            if len(cuts):
                yield table.slice(0, int(cuts[-1]))
                table = table.slice(int(cuts[-1]))
            held = [table]
            n = pa.compute.sum(pa.compute.binary_length(table.column(6))).as_py() - (WINDOW - 1) * table.num_rows
    if held and any(b.num_rows for b in held):
        yield pa.concat_batches(held)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    doc = F.col(id_col).cast("long")
    return docs.withColumn("__rp_doc", doc).withColumn("__rp_key", F.xxhash64(doc, F.col(text_col)))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, key (hash of id and text), ranges array<struct<start, stop>>): the windows to remove, of documents that have any."""
    rows = keyed(docs, id_col, text_col).select("__rp_doc", "__rp_key", F.col(text_col).alias("__rp_text"))
    grams = shared.stage(rows.select("__rp_key", "__rp_text").mapInArrow(shared.lean(find_anchors), "gram long, key long"), "anchors")
    many = shared.stage(grams.groupBy("gram").agg(F.count("*").alias("copies")).where("copies > 1"), "shared-anchors")
    asked = shared.stage(grams.join(many, "gram").groupBy("key").agg(F.collect_set(F.struct("gram", "copies")).alias("asked")), "asked-anchors")
    shared.forget(docs.sparkSession, "anchors")
    contexts = rows.join(asked, F.col("__rp_key") == F.col("key")).select("__rp_doc", "__rp_key", "__rp_text", "asked")
    dealt = contexts.mapInArrow(shared.lean(cut_contexts), DEALT)
    found = None
    while True:
        dealt = dealt.repartition("part", "salt").sortWithinPartitions("part", "salt")
        done = shared.stage(dealt.mapInArrow(shared.lean(settle), ROUND), "repeat-round")
        ranges = done.where("bytes is null").select("doc", "key", "start", "stop")
        found = ranges if found is None else found.unionByName(ranges)
        onward = done.where("bytes is not null")
        if not onward.limit(1).count():
            break
        dealt = onward.select("part", "salt", "groups", "doc", "key", F.col("start").alias("at"), "bytes")
    return shared.stage(found.groupBy("doc", "key").agg(F.collect_list(F.struct("start", "stop")).alias("ranges")), "repeat-removals")


def removed_ranges(starts: np.ndarray, stops: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of removed bytes [start, stop) of ranges of removed windows."""
    order = np.argsort(starts, kind="stable")
    start, stop = starts[order], np.maximum.accumulate(stops[order]) + WINDOW
    cuts = np.flatnonzero(np.concatenate(([True], start[1:] > stop[:-1]))) if len(start) else start
    return start[cuts], np.minimum(stop[np.append(cuts[1:], len(start)) - 1] if len(cuts) else stop, size)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_characters: bool = False, prefix: str = "") -> DataFrame:
    """All columns of docs (but of these names, which `prefix` can change), n_bytes, n_removed, n_spans, kept_bytes (if asked, where bytes are removed, without halves of characters)."""
    added = [prefix + c for c in ("n_bytes", "n_removed", "n_spans", "kept_bytes")]
    names = [c for c in docs.columns if c not in added]
    found = removals(docs, id_col, text_col).toDF("__rp_of", "__rp_with", "__rp_ranges")
    rows = keyed(docs.select(*names), id_col, text_col)
    same = F.col("__rp_doc").eqNullSafe(F.col("__rp_of")) & (F.col("__rp_key") == F.col("__rp_with"))
    keys = found.select("__rp_of", "__rp_with")
    schema = type(docs.schema)([*docs.select(*names).schema.fields])
    for name, kind in zip(added, ("long", "long", "long", "binary"), strict=True):
        schema = schema.add(name, kind)
    at = names.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column("__rp_ranges"), strict=True):
                text = text or b""
                starts, stops = (np.asarray(ranges.values.field(i), np.int64) if ranges.is_valid else np.zeros(0, np.int64) for i in range(2))
                start, stop = removed_ranges(starts, stops, len(text))
                edges = [0, *np.stack([start, stop], 1).ravel().tolist(), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                shown = kept.decode(errors="ignore").encode() if whole_characters and len(kept) < len(text) else kept
                out.append((len(text), len(text) - len(kept), len(start), shown))
            columns = [pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 4, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *columns], [*names, *added])

    if not shared.fits(keys):
        return rows.join(found, same, "left").select(*names, "__rp_ranges").mapInArrow(shared.lean(cut), schema)
    touched = rows.join(F.broadcast(keys), same, "left_semi").join(found, same).select(*names, "__rp_ranges").mapInArrow(shared.lean(cut), schema)
    bytes_ = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    plain = [F.octet_length(bytes_).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), bytes_]
    whole = rows.join(F.broadcast(keys), same, "left_anti").select(*names, *[c.alias(name) for c, name in zip(plain, added, strict=True)])
    return touched.unionByName(whole)


def digests(docs: DataFrame) -> DataFrame:
    return deduplicate(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))
