"""Ranked lexical search by the Best Position Algorithm over impact lists.

Terms are the maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. N documents hold a term, L terms in
all; a document of n terms has m = 75 + (25 n N) div L. A term of document frequency df weighs
w = floor(1000 ln((2N + 2) / (2df + 1))), and its impact on a document that holds it tf times is
w * ((10**9 tf) div (1000 tf + 12 m)). A document's score is the sum of the impacts of the item's terms, repeats included.

1. One pass over the texts leaves a row per document: its length and the terms that any item asks for, with their counts. Frequencies
   and lengths of the whole table are aggregations of these rows.
2. Rows are dealt to tasks as Spark splits the table. A task builds shards of about SHARD postings: impact lists (a term's
   documents, the highest impact first) and, for direct access, each document's own postings with their places in the lists.
3. For an item the lists are read from their best positions: the end of the run from the top in which every place has been seen,
   by reading or by direct access. Each new document is scored by direct access, which marks its places in all lists. No unseen
   document can have more than the sum of the impacts at the best positions (nothing of a list that is seen whole), and the
   search ends once that is strictly below the K-th score. The K best of a task's shards go on to its next shard, so that later
   shards start with a threshold.
4. A window over K rows per task and item gives the ranks: score descending, doc_id ascending.

Items are taken in blocks of about QUERY_BYTES of their text, so what is sent to the tasks is bounded; each block is a pass over the
documents. Memory of a task is a shard and K rows per item of the block.

Null and empty texts hold no terms. Documents with a null id count in N, L and df and are no results. Rows repeated in the documents
are documents of their own, each with a rank. An item is an id and a text: repeated rows are one item, different texts under one id are
ranked each, and a null id is an id. Items without a term that scores give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

K = 20
QUERY_BYTES = 2 << 20
#: Postings of a shard, about.
SHARD = 1 << 20
#: Places that the first round reads in each list; each next round reads twice as many.
STEP = 16
#: Bytes of a term stay, capitals become small, others become spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
POSTINGS = "doc_id long, n long, terms array<int>, tfs array<int>"


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


@dataclass
class Items:
    """A block of items: their ids, and the terms of all of them one after another, as numbers, with counts."""

    ids: list[int | None]
    starts: np.ndarray
    codes: np.ndarray
    counts: np.ndarray
    vocabulary: dict[bytes, int]


def items_of(ids: list, texts: list) -> Items:
    vocabulary: dict[bytes, int] = {}
    codes, counts, sizes = [], [], []
    for text in texts:
        own = np.array([vocabulary.setdefault(t, len(vocabulary)) for t in terms(text)], np.int64)
        code, n = np.unique(own, return_counts=True)
        codes.append(code), counts.append(n), sizes.append(len(code))
    empty = np.zeros(0, np.int64)
    return Items(ids, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), np.concatenate([empty, *codes]), np.concatenate([empty, *counts]), vocabulary)


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """A row per document: doc_id, n (terms), and which terms of the vocabulary it holds how often."""
    sent = shared.sent(docs.sparkSession, vocabulary)  # of at most QUERY_BYTES of text

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        size = max(1, len(known))
        for batch in batches:
            lengths, parts = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                own = terms(text)
                lengths.append(len(own))
                parts.append(np.fromiter(map(known.get, own, repeat(-1)), np.int64, len(own)))
            flat = np.concatenate([np.zeros(0, np.int64), *parts])
            doc = np.repeat(np.arange(len(lengths)), lengths)[flat >= 0]
            key, tf = np.unique(doc * size + flat[flat >= 0], return_counts=True)
            edges = pa.array(np.searchsorted(key, np.arange(len(lengths) + 1) * size).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int32))) for x in (key % size, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return shared.stage(rows.mapInArrow(shared.lean(count), POSTINGS), "postings")


def weights(found: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """(w of each term, N, L)."""
    n, total = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    rows = found.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # a row per term of the block of items
    out = np.zeros(size, np.int64)
    for term, df in zip(rows["term"].to_pylist(), rows["count"].to_pylist(), strict=True):
        out[term] = math.floor(1000 * math.log((2.0 * n + 2) / (2.0 * df + 1)))
    return out, n, total


class Shard:
    """Impact lists of some documents, and their own postings."""

    def __init__(self, batches: list[pa.RecordBatch], w: np.ndarray, n_docs: int, n_terms: int) -> None:
        column = lambda i: np.concatenate([np.asarray(b.column(i), np.int64) for b in batches])
        flat = lambda i: np.concatenate([np.asarray(b.column(i).flatten(), np.int64) for b in batches])
        self.ids, n = column(0), column(1)
        self.term, tf = flat(2), flat(3)
        self.sizes = np.concatenate([np.asarray(b.column(2).value_lengths(), np.int64) for b in batches])
        self.starts = np.cumsum(self.sizes) - self.sizes
        doc = np.repeat(np.arange(len(n)), self.sizes)
        m = 75 + (25 * n * n_docs) // max(1, n_terms)
        self.impact = w[self.term] * ((10**9 * tf) // (1000 * tf + 12 * m[doc]))
        order = np.argsort((self.term << 37) - self.impact, kind="stable")  # an impact has fewer than 37 bits
        self.list_doc, self.list_impact = doc[order], self.impact[order]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.ends = np.cumsum(np.bincount(self.term, minlength=len(w)))
        self.asked = np.zeros(len(w), np.int64)

    def search(self, codes: np.ndarray, counts: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, ids) of `best` and this shard's documents."""
        ends = self.ends[codes]
        starts = np.where(codes > 0, self.ends[codes - 1], 0)
        codes, counts, starts, ends = (x[ends > starts] for x in (codes, counts, starts, ends))
        if not len(codes):
            return best
        self.asked[codes] = counts
        seen, scored = np.zeros(len(self.term), bool), np.zeros(len(self.ids), bool)
        at, step = starts.copy(), STEP  # the first place of each list after its best position
        while True:
            # what stands at the best positions; the first entries bound the rest before any is seen
            bound = int((counts * np.where(at < ends, self.list_impact[np.minimum(np.maximum(at - 1, starts), ends - 1)], 0)).sum())
            kth = int(best[0][k - 1]) if len(best[0]) >= k else 0
            if bound < kth or not bound:
                break
            read = shared.ragged(at, np.minimum(step, ends - at))
            seen[read] = True
            new = self.list_doc[read]
            new = np.unique(new[~scored[new]])
            scored[new] = True
            if len(new):
                own = shared.ragged(self.starts[new], self.sizes[new])
                times = self.asked[self.term[own]]
                score = np.add.reduceat(self.impact[own] * times, np.cumsum(self.sizes[new]) - self.sizes[new])
                seen[self.place[own[times > 0]]] = True
                best = top(np.concatenate((best[0], score)), np.concatenate((best[1], self.ids[new])), k)
            for i, (a, e) in enumerate(zip(at.tolist(), ends.tolist(), strict=True)):
                if a < e:
                    gap = int(seen[a:e].argmin())
                    at[i] = a + gap if not seen[a + gap] else e
            step *= 2
        self.asked[codes] = 0
        return best


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    keep = scores > 0
    scores, ids = scores[keep], ids[keep]
    if len(scores) > 4 * k:  # all that tie with the k-th stay for now
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def searched(found: DataFrame, items: Items, k: int) -> DataFrame:
    """item (its number in the block), item_id, doc_id, score: the k best of each task."""
    w, n_docs, n_terms = weights(found, len(items.vocabulary))
    sent = shared.sent(found.sparkSession, (w, n_docs, n_terms, items.ids, items.starts, items.codes, items.counts))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, n_docs, n_terms, ids, starts, codes, counts = sent.value
        none = np.zeros(0, np.int64)
        best = [(none, none)] * len(ids)

        def through(group: list[pa.RecordBatch]) -> None:
            shard = Shard(group, w, n_docs, n_terms)
            for i, (a, e) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
                best[i] = shard.search(codes[a:e], counts[a:e], best[i], k)

        group, held = [], 0
        for batch in batches:
            group.append(batch)
            held += len(batch.column(2).flatten())
            if held >= SHARD:
                through(group)
                group, held = [], 0
        if held:
            through(group)
        sizes = [len(b[0]) for b in best]
        number = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        columns = [pa.array(number), pa.array(ids, pa.int64()).take(pa.array(number)), *(pa.array(np.concatenate([none, *(b[c] for b in best)])) for c in (1, 0))]
        yield pa.RecordBatch.from_arrays(columns, ["item", "item_id", "doc_id", "score"])

    rows = found.where("doc_id is not null and size(terms) > 0")
    return rows.mapInArrow(shared.lean(search), "item int, item_id long, doc_id long, score long")


def rank(docs: DataFrame, benchmark: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    items = shared.stage(items.withColumn("_dealt", F.xxhash64("item_id", "text")), "items")
    passes = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // QUERY_BYTES)
    results = []
    for at in range(passes):
        rows = items.where(F.pmod("_dealt", F.lit(passes)) == at).orderBy("_dealt").select("item_id", "text").toArrow()  # about QUERY_BYTES
        block = items_of(rows["item_id"].to_pylist(), [t.encode() for t in rows["text"].to_pylist()])
        order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        found = shared.stage(searched(postings(docs, block.vocabulary), block, k), "best-of-tasks")
        results.append(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""WITH t AS (SELECT doc_id, unnest({_TERMS}) AS t FROM documents), n AS (
  SELECT doc_id, count(*) AS n FROM t GROUP BY 1), c AS (
  SELECT count(*) AS nd, sum(n)::BIGINT AS nt FROM n), tf AS (
  SELECT doc_id, t, count(*) AS tf FROM t GROUP BY 1, 2), w AS (
  SELECT t, floor(1000 * ln((2 * (SELECT nd FROM c) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf GROUP BY 1), q AS (
  SELECT item_id, t, count(*) AS r FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY 1, 2), s AS (
  SELECT q.item_id, tf.doc_id, sum(r * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n.n * nd) // nt))))::BIGINT AS score
  FROM q JOIN tf ON tf.t = q.t JOIN w ON w.t = q.t JOIN n ON n.doc_id = tf.doc_id, c GROUP BY 1, 2), o AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS "rank", doc_id, score FROM s WHERE score > 0)
SELECT * FROM o WHERE "rank" <= {K}"""
