"""Language identification by hierarchical discrimination: the family first, then one-versus-one linear SVMs within it.

Features are the shares of hashed byte n-grams (SIZES, into DIMENSIONS slots) of the lower-cased text, where all ASCII signs but
letters count as spaces. Families come from the training rows: the languages' mean features are merged by average linkage of their
cosines until ceil(sqrt(languages)) families are left, so closely related languages stand together whatever their names. One-versus-rest
SVMs choose the family; within it each pair of languages has an SVM of its own, and the language with the most wins (then the largest
sum of margins) is predicted. `score` is the family's softmax share times the mean logistic of the winner's pair margins.

Training rows have a letter, a lang, and an id whose decimal CRC-32 mod PARTS is not HELD_OUT. The models are fitted on a bounded
sample of them: about max(SAMPLE, EACH * languages) rows, as many of each language as far as they go, chosen by a hash of id and text;
at most MOST_LANGUAGES languages, the most frequent ones, are learned. Tasks cut the rows into sparse features (at most DIMENSIONS
numbers a row), and the driver fits. Every document is predicted from its whole text in one pass without a shuffle; long texts go
through in pieces that overlap, so that no n-gram is lost.

Null texts and texts without a letter are `und` with score 0.0, as is everything if there is nothing to learn from; with one language
learned all others are it, with score 1.0. Rows with a null id are predicted, count as not held out and are not learned from.
Repeated rows are predicted each. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

DIMENSIONS, SIZES = 1 << 14, (1, 2, 3)
SAMPLE, EACH, MOST_LANGUAGES = 2_000, 30, 200
PARTS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: Byte positions that are hashed at once.
PIECE = 1 << 20
#: SVMs: cost of a margin's violation, passes over the sample.
COST, PASSES = 10.0, 25
SHARPNESS = 2.0
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_OVERLAP = max(SIZES) - 1


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % PARTS == HELD_OUT, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


@dataclass
class Pieces:
    """Byte strings of texts (a text may have several), each with the text it belongs to."""

    of: list[int] = field(default_factory=list)
    parts: list[bytes] = field(default_factory=list)

    def add(self, number: int, text: str) -> int:
        """How many positions the text has."""
        folded = b" " + text.lower().encode().translate(_FOLD) + b" " * _OVERLAP
        n = len(folded) - _OVERLAP
        for at in range(0, n, PIECE):
            self.of.append(number)
            self.parts.append(folded[at : at + PIECE + _OVERLAP])
        return n

    def groups(self) -> Iterator[tuple[np.ndarray, bytes, np.ndarray, np.ndarray]]:
        """(texts, bytes, first positions, ends of positions) of about PIECE positions at a time."""
        at = 0
        while at < len(self.parts):
            stop, held = at, 0
            while stop < len(self.parts) and (stop == at or held + len(self.parts[stop]) <= PIECE):
                held += len(self.parts[stop])
                stop += 1
            sizes = np.array([len(p) for p in self.parts[at:stop]], np.int64)
            ends = np.cumsum(sizes)
            yield np.array(self.of[at:stop]), b"".join(self.parts[at:stop]), ends - sizes, ends - _OVERLAP
            at = stop


def slots(data: bytes) -> Iterator[np.ndarray]:
    """For each size the slot of the n-gram at every position (but for the last ones, where none of the largest size starts)."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    n, code = len(raw) - _OVERLAP, np.zeros(len(raw), np.uint32)
    for size in range(1, max(SIZES) + 1):
        code = (code[: len(raw) - size + 1] << np.uint32(8)) | raw[size - 1 :]
        if size in SIZES:
            mixed = (code[:n] + np.uint32(size * 0x51ED270B & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            yield ((mixed * np.uint32(0x85EBCA77)) >> np.uint32(32 - DIMENSIONS.bit_length() + 1)).astype(np.intp)


def margins(pieces: Pieces, n: int, weights: np.ndarray) -> np.ndarray:
    """Sums of the rows of weights (DIMENSIONS, models) over the n-grams of each of n texts."""
    out = np.zeros((n, weights.shape[1]))
    columns = [weights[:, c].astype(np.float64) for c in range(weights.shape[1])]  # no cast while summing: equal texts get equal sums
    for of, data, first, end in pieces.groups():
        edges = np.stack((first, end), 1).ravel()
        for slot in slots(data):
            for c, column in enumerate(columns):
                np.add.at(out[:, c], of, np.add.reduceat(np.append(column[slot], 0.0), edges)[::2])
    return out


@dataclass
class Model:
    languages: list[str]
    families: list[list[int]]
    family_weights: np.ndarray
    family_bias: np.ndarray
    pairs: list[list[tuple[int, int]]]
    pair_weights: list[np.ndarray]
    pair_bias: list[np.ndarray]


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(SHARPNESS * x, -40, 40)))


class Rows:
    """Sparse rows with a constant at the end of each weight vector."""

    def __init__(self, owners: list[np.ndarray], values: list[np.ndarray], scale: np.ndarray) -> None:
        self.owners, self.values = owners, [v * scale[o] for o, v in zip(owners, values, strict=True)]
        norm = math.sqrt(max(np.mean([float(v @ v) for v in self.values]), 1e-12))
        self.values = [v / norm for v in self.values]
        self.scale = scale / norm

    def svm(self, chosen: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, float]:
        """Weights on plain shares and bias: dual coordinate descent on the squared hinge loss."""
        w, bias, loose = np.zeros(DIMENSIONS), 0.0, 1 / (2 * COST)
        alpha, random = np.zeros(len(chosen)), np.random.default_rng(7)
        square = np.array([float(self.values[i] @ self.values[i]) + 1 + loose for i in chosen])
        for _ in range(PASSES):
            most = 0.0
            for j in random.permutation(len(chosen)):
                o, v, sign = self.owners[chosen[j]], self.values[chosen[j]], signs[j]
                slope = sign * (float(w[o] @ v) + bias) - 1 + loose * alpha[j]
                step = max(alpha[j] - slope / square[j], 0.0) - alpha[j]
                if step:
                    alpha[j] += step
                    w[o] += step * sign * v
                    bias += step * sign
                    most = max(most, abs(step))
            if most < 1e-4:
                break
        return w * self.scale, bias


def families_of(means: np.ndarray) -> list[list[int]]:
    """Rows merged by average linkage of their cosines until ceil(sqrt(rows)) groups are left."""
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    near, groups = unit @ unit.T, [[i] for i in range(len(means))]
    while len(groups) > math.ceil(math.sqrt(len(means))):
        _, a, b = max((near[np.ix_(x, y)].mean(), -i, -j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        groups[-a] += groups.pop(-b)
    return [sorted(g) for g in groups]


def fit(names: list[str], owners: list[np.ndarray], values: list[np.ndarray]) -> Model | None:
    """A model of rows (a language, slots, shares)."""
    if not names:
        return None
    languages = sorted(set(names))
    own = np.array([languages.index(n) for n in names])
    means, mass = np.zeros((len(languages), DIMENSIONS)), np.zeros(DIMENSIONS)
    for k, o, v in zip(own.tolist(), owners, values, strict=True):
        means[k, o] += v
        mass[o] += v * v
    mass /= len(names)
    # rare and common n-grams come nearer to each other, none is blown up
    rows = Rows(owners, values, 1 / np.sqrt(mass + max(mass.mean(), 1e-12)))
    means = (means / np.bincount(own)[:, None]) * rows.scale
    families = families_of(means - means.mean(0) if len(languages) > 1 else means)
    of = np.zeros(len(languages), int)
    for f, members in enumerate(families):
        of[members] = f
    everyone = np.arange(len(names))
    ask = range(len(families)) if len(families) > 2 else range(len(families) - 1)
    fitted = [rows.svm(everyone, np.where(of[own] == f, 1.0, -1.0)) for f in ask]
    pairs = [[(a, b) for i, a in enumerate(g) for b in g[i + 1 :]] for g in families]
    between = [[rows.svm(c := np.flatnonzero((own == a) | (own == b)), np.where(own[c] == a, 1.0, -1.0)) for a, b in group] for group in pairs]
    if len(families) <= 2:  # the second family is what the first is not; a single one is always chosen
        fitted.append((-fitted[0][0], -fitted[0][1]) if fitted else (np.zeros(DIMENSIONS), 0.0))
    stack = lambda found: (np.stack([w for w, _ in found], 1).astype(np.float32) if found else np.zeros((DIMENSIONS, 0), np.float32), np.array([b for _, b in found]))
    own_pairs = [stack(g) for g in between]
    return Model(languages, families, *stack(fitted), pairs, [w for w, _ in own_pairs], [b for _, b in own_pairs])


def decide(model: Model, pieces: Pieces, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language numbers, scores) of texts with so many positions each."""
    n, share = len(sizes), 1 / (len(SIZES) * np.maximum(sizes, 1))[:, None]
    family = margins(pieces, n, model.family_weights) * share + model.family_bias
    chosen = family.argmax(1) if n else np.zeros(0, int)
    odds = np.exp(SHARPNESS * (family - family.max(1, initial=-np.inf, keepdims=True)))
    score = odds.max(1, initial=0) / np.maximum(odds.sum(1), 1e-300)
    language = np.zeros(n, int)
    of = np.array(pieces.of, int)
    for f, members in enumerate(model.families):
        rows = np.flatnonzero(chosen == f)
        if not len(rows):
            continue
        if len(members) == 1:
            language[rows] = members[0]
            continue
        place = np.full(n, -1)
        place[rows] = np.arange(len(rows))
        mine = [i for i in np.flatnonzero(place[of] >= 0).tolist()]
        part = Pieces(place[of[mine]].tolist(), [pieces.parts[i] for i in mine])
        against = margins(part, len(rows), model.pair_weights[f]) * share[rows] + model.pair_bias[f]
        wins, total, sure = (np.zeros((len(rows), len(members))) for _ in range(3))
        for c, (a, b) in enumerate(model.pairs[f]):
            for k, m in ((members.index(a), against[:, c]), (members.index(b), -against[:, c])):
                wins[:, k] += m > 0
                total[:, k] += m
                sure[:, k] += logistic(m) / (len(members) - 1)
        best = np.array([max(range(len(members)), key=lambda k: (w[k], t[k], -k)) for w, t in zip(wins, total, strict=True)])
        language[rows] = np.array(members)[best]
        score[rows] *= sure[np.arange(len(rows)), best]
    return language, score


def train(docs: DataFrame) -> Model | None:
    rows = docs.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & has_letter(F.col("text")))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()  # MOST_LANGUAGES rows at most
    if not counts:
        return None
    wanted = max(SAMPLE, EACH * len(counts))
    rates = [(r["lang"], min(1.0, wanted / len(counts) / r["count"])) for r in counts]
    chosen = rows.join(F.broadcast(docs.sparkSession.createDataFrame(rates, "lang string, rate double")), "lang")
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / F.lit(float(1 << 53))
    chosen = chosen.withColumn("chance", chance).where("chance < rate").select("lang", "text", "chance")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                pieces, counts = Pieces(), np.zeros(DIMENSIONS)
                total = len(SIZES) * pieces.add(0, text)
                for _, data, first, end in pieces.groups():
                    inside = shared.ragged(first, end - first)
                    for slot in slots(data):
                        counts += np.bincount(slot[inside], minlength=DIMENSIONS)
                own = np.flatnonzero(counts)
                found.append((own.astype(np.int32), (counts[own] / total).astype(np.float32)))
            lists = [pa.array([f[i] for f in found], pa.list_(kind)) for i, kind in enumerate((pa.int32(), pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *lists], ["lang", "chance", "slots", "shares"])

    found = chosen.mapInArrow(shared.lean(cut), "lang string, chance double, slots array<int>, shares array<float>")
    got = found.orderBy("chance", "lang").limit(2 * wanted).toArrow()  # features, not texts; about `wanted` rows, by chance never twice as many
    got = got.combine_chunks()
    lists = [[x for chunk in got[c].chunks for x in np.split(np.asarray(chunk.flatten()), np.cumsum(np.asarray(chunk.value_lengths()))[:-1])] for c in ("slots", "shares")]
    return fit(got["lang"].to_pylist(), *lists) if len(got) else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), has_letter(F.col("text")).alias("known"), F.col("text"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = shared.sent(docs.sparkSession, model)  # DIMENSIONS weights for each family and each pair, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            known = np.flatnonzero(np.asarray(batch.column(2)))
            pieces = Pieces()
            sizes = np.array([pieces.add(i, text) for i, text in enumerate(batch.column(3).take(pa.array(known)).to_pylist())], np.int64)
            language, score = decide(model, pieces, sizes)
            names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            for at, k in zip(known.tolist(), language.tolist(), strict=True):
                names[at] = model.languages[k]
            scores[known] = score
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(shared.lean(run), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out and predict all."""
    return predict(docs, train(docs))
