"""Ordinal quality classifier: a cumulative-link regression on graded ratings over hashed text.

P(grade <= k) = logistic(threshold_k - w.x) with one weight vector for all grades and ordered thresholds, so a document
gets an expected grade and the tail probability P(grade >= KEEP_GRADE), by which documents are selected. Grades come
from the labels: 0 toxic, 1 poor, 2 good.

Features are hashed into DIMENSIONS weights: each distinct word of the text (cut at ASCII white space, lower-cased, without
signs around it), its first four and five characters, and the shapes of its words (capitals, signs around it, a repeat of the
word before) by their share of all words. The fit is on the SAMPLE labelled documents of the smallest id hashes, a documented
bound: the driver gets one sparse row for each (at most DIMENSIONS numbers, summed by slot and without rare slots in the
tasks). Every document is scored whole, in one pass without a shuffle, each distinct word of a batch once. The loss is convex and
the L1 penalty keeps weights of words that say nothing at zero, so that long texts gather no noise.

Null or empty texts have no features: their grade follows from the thresholds alone. Rows with null labels or ids are
not fitted on; of different texts under one labelled id the one of least hash is fitted on; of labels of one id the lowest
grade counts. Null document ids are scored like others; repeated rows are scored each. Without labelled rows, or with
one grade only, every document is kept (the prior says nothing against it). Texts of any length are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

DIMENSIONS = 1 << 18
#: Labelled documents that the model is fitted on, at most.
SAMPLE = 8_000
GRADES = 3
KEEP_GRADE, KEEP_PROBABILITY = 2, 0.5
SHAPE_SCALE = 20.0
PENALTY, STEPS = 3e-3, 120
#: Slots with fewer mentions in the sample get no weight.
RARE = 20
#: Features that a step multiplies at once.
CHUNK = 1 << 19
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def grade(quality: str = "quality", toxic: str = "toxic") -> Column:
    return F.when(F.col(toxic) > 0, 0).when(F.col(quality) <= 0, 1).when(F.col(quality).isNotNull(), 2)


def slot(kind: str, text: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(f"{kind}:{text}".encode()) % DIMENSIONS


def word_slots(word: str) -> list[int]:
    core = word.strip(SIGNS).lower()
    if not core:
        return [slot("sign", word)]
    return [slot("word", core), slot("4", core[:4]), slot("5", core[:5])]


def shape_slot(word: str) -> int | None:
    """Capitals and the signs after a word; None for ordinary words."""
    tail = word[len(word.rstrip(SIGNS)) :][-3:]
    upper = len(word) > 1 and word.upper() == word and word.lower() != word
    return slot("shape", f"{'upper' if upper else ''}{tail}") if upper or tail not in ("", ".", ",") else None


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tail(self, score: np.ndarray, least: int) -> np.ndarray:
        """P(grade >= least)."""
        return logistic(score - self.thresholds[least - 1]) if len(self.thresholds) else np.ones_like(score)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a text, each slot once."""
    words = [w.decode() for w in text.encode().split()]
    slots = [s for word in set(words) for s in word_slots(word)]
    values = np.ones(len(slots), np.float32)
    shapes = [s for s in map(shape_slot, words) if s is not None] + [slot("shape", "repeat")] * sum(a == b for a, b in zip(words, words[1:], strict=False))
    share = np.full(len(shapes), SHAPE_SCALE / max(1, len(words)), np.float32)
    own, at = np.unique(np.array(slots + shapes, np.int32), return_inverse=True)
    return own, np.bincount(at, np.concatenate([values, share]), len(own)).astype(np.float32)


def fit(slots: np.ndarray, values: np.ndarray, lengths: np.ndarray, grades: np.ndarray) -> Model:
    """Accelerated proximal gradient steps on the cumulative-link likelihood; thresholds stay ordered.

    slots and values hold the documents' features one after another, `lengths` of them each; 32-bit numbers and chunks
    keep the sample (some ten million features) small on the driver.
    """
    if len(np.unique(grades)) < 2:
        return Model(np.zeros(DIMENSIONS, np.float32), np.zeros(0))
    n = len(lengths)
    used = np.flatnonzero(np.bincount(slots, minlength=DIMENSIONS))
    place = np.full(DIMENSIONS, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    # a square root of each column's mass evens rare and common features out
    mass = np.bincount(slots, values * values, DIMENSIONS)[used]
    scale = (1 / np.sqrt(mass / n + 20 / n)).astype(np.float32)
    chunks = []
    ends = np.cumsum(lengths)
    at = 0
    while at < n:
        first = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, first + CHUNK, "right")))
        own = place[slots[first : ends[stop - 1]]]
        keep = own >= 0
        owner = np.repeat(np.arange(stop - at, dtype=np.int32), lengths[at:stop])[keep]
        chunks.append((at, stop, owner, own[keep], values[first : ends[stop - 1]][keep] * scale[own[keep]]))
        at = stop
    del slots, values

    def forward(v: np.ndarray) -> np.ndarray:
        v = v.astype(np.float32)
        return np.concatenate([np.bincount(owner, x * v[own], stop - at) for at, stop, owner, own, x in chunks])

    def backward(g: np.ndarray) -> np.ndarray:
        g, total = g.astype(np.float32), np.zeros(len(used))
        for at, stop, owner, own, x in chunks:
            total += np.bincount(own, x * g[at:stop][owner], len(used))
        return total

    share = np.cumsum(np.bincount(grades, minlength=GRADES))[:-1] / n
    cut = np.log((share + 1e-3) / (1 - share + 1e-3))
    w = np.zeros(len(used))
    z, z_cut, momentum = w, cut, 1.0
    # the logistic's curvature is at most 1/4 (1/2 for a grade between two thresholds): power iteration bounds the step
    v = np.random.default_rng(0).normal(size=len(used))
    for _ in range(12):
        v = backward(forward(v)) / n
        norm = np.linalg.norm(v)
        v /= norm
    rate = 1 / (0.5 * norm + 0.5)
    for _ in range(STEPS):
        score = forward(z)
        upper = logistic(np.append(z_cut, np.inf)[grades] - score)
        lower = logistic(np.append(-np.inf, z_cut)[grades] - score)
        inside = np.maximum(upper - lower, 1e-9)
        d_upper, d_lower = upper * (1 - upper) / inside, lower * (1 - lower) / inside
        by_score = (d_upper - d_lower) / n
        g_cut = np.bincount(grades, -d_upper, GRADES)[:-1] / n + np.bincount(grades, d_lower, GRADES)[1:] / n
        new = z - rate * backward(by_score)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * PENALTY, 0)
        new_cut = z_cut - rate * g_cut
        new_cut[1:] = np.maximum.accumulate(np.maximum(new_cut[1:], new_cut[:-1] + 1e-3))
        ahead = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        z, z_cut = new + (momentum - 1) / ahead * (new - w), new_cut + (momentum - 1) / ahead * (new_cut - cut)
        z_cut = np.maximum.accumulate(z_cut)
        z_cut[1:] += 1e-3 * (np.diff(z_cut) < 1e-3)
        w, cut, momentum = new, new_cut, ahead
    weights = np.zeros(DIMENSIONS, np.float32)
    weights[used] = w * scale
    return Model(weights, cut)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    graded = labels.select(F.col("doc_id").alias("_id"), grade().alias("_grade")).where("_id is not null and _grade is not null")
    chosen = graded.groupBy("_id").agg(F.min("_grade").alias("_grade")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # at most `sample` ids
    rows = rows.groupBy("_id", "_grade").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(text.as_py() or "") for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))],
                ["id", "grade", "slots", "values"],
            )

    found = shared.stage(rows.mapInArrow(shared.lean(extract), "id long, grade int, slots array<int>, values array<float>"), "labelled-features")
    mentions = found.select(F.explode("slots").alias("slot")).groupBy("slot").count().where(F.col("count") >= RARE).select("slot").toArrow()  # DIMENSIONS rows at most
    common = np.zeros(DIMENSIONS, bool)  # what a few mentions say does not carry over
    common[np.asarray(mentions["slot"], np.int64)] = True
    sent = shared.sent(docs.sparkSession, np.packbits(common))

    def without_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.unpackbits(sent.value).view(bool)
        for batch in batches:
            slots, values = (np.asarray(batch.column(i).flatten()) for i in (2, 3))
            use = keep[slots]
            edges = np.concatenate(([0], np.cumsum(use)))[np.concatenate(([0], np.cumsum(np.asarray(batch.column(2).value_lengths(), np.int64))))].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x[use])) for x in (slots, values)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], batch.schema.names)

    got = found.mapInArrow(shared.lean(without_rare), found.schema).toArrow()  # `sample` rows at most
    got = got.take(pa.compute.sort_indices(got["id"]))
    lengths, grades = np.asarray(pa.compute.list_value_length(got["slots"]), dtype=np.int64), np.asarray(got["grade"], dtype=np.int64)
    slots, values = (np.concatenate([np.asarray(x.flatten()) for x in got[c].chunks]) if len(got) else np.zeros(0, kind) for c, kind in (("slots", np.int32), ("values", np.float32)))
    del got
    return fit(slots, values, lengths, grades)


def scores(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    """w.x of each text of a string column: `features` and `weights` without a feature vector, a word of the batch at a time."""
    split = pa.compute.ascii_split_whitespace(column.fill_null(""))
    encoded = split.flatten().dictionary_encode()
    words, n = encoded.dictionary.to_pylist(), len(column)
    code, doc = np.asarray(encoded.indices, np.int64), np.repeat(np.arange(n), np.asarray(split.value_lengths(), np.int64))
    named = np.array([bool(w) for w in words], bool)[code] if len(code) else np.zeros(0, bool)
    code, doc = code[named], doc[named]
    shapes = [shape_slot(w) for w in words]
    shape = np.array([weights[s] if s is not None else 0.0 for s in shapes], float)
    score = np.array([weights[word_slots(w)].sum() if w else 0.0 for w in words], float)
    each = np.unique(doc * max(1, len(words)) + code)
    total = np.bincount(each // max(1, len(words)), score[each % max(1, len(words))], n) if len(each) else np.zeros(n)
    again = np.flatnonzero((code[1:] == code[:-1]) & (doc[1:] == doc[:-1])) if len(code) else code
    shaped = np.bincount(doc, shape[code], n) + float(weights[slot("shape", "repeat")]) * np.bincount(doc[again], minlength=n) if len(code) else np.zeros(n)
    return total + SHAPE_SCALE * shaped / np.maximum(1, np.bincount(doc, minlength=n))


def predict(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """All columns of docs (but of these names, which `prefix` can change), expected_grade, tail_probability, kept."""
    sent = shared.sent(docs.sparkSession, model)  # DIMENSIONS weights, whatever the corpus
    added = [prefix + c for c in ("expected_grade", "tail_probability", "kept")]
    names = [c for c in docs.columns if c not in added]
    at = names.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            x = scores(batch.column(at), model.weights)
            grades = sum([model.tail(x, k) for k in range(1, GRADES)], np.zeros(len(x))) if len(model.thresholds) else np.full(len(x), GRADES - 1.0)
            tail = model.tail(x, KEEP_GRADE)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(grades), pa.array(tail), pa.array(tail >= KEEP_PROBABILITY)], [*names, *added])

    kept = docs.select(*names)
    schema = type(kept.schema)([*kept.schema.fields])
    for name, kind in zip(added, ("double", "double", "boolean"), strict=True):
        schema = schema.add(name, kind)
    return kept.mapInArrow(shared.lean(score), schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected_grade, tail_probability, kept for every document."""
    return predict(docs.select("doc_id", "text"), train(docs, labels)).drop("text")
