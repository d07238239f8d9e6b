"""N-gram Jaccard join by multiple-global-order filtering.

A document's set holds its distinct shingles of SHINGLE (a parameter) words (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; with fewer
words, the whole sequence as one). Two link when 100 * |both| >= LEAST * |either|; components follow the links. For a set
of n, a linked partner lacks at most m = n - ceil(LEAST n / 100) of its shingles, so under any global order of all shingles

- the first m + 1 shingles (the prefix) hold one of the partner's prefix, and
- the first m + 1 that both have are among its first 2m + 1 and among the partner's first m + m' + 1 (m' the partner's m).

1. Rows of one id and text become one, then documents of equal sets: a set is known by the number of its first row (least id), never by
   an id, so that repeated rows and different texts under one id stay apart. The first M + m + 1 shingles of each set under a random order (M the
   m of the largest partner, 100 n / LEAST) are rows (shingle, set), and shingles of two sets or more are found by
   partial aggregation. A set stays if at least m + 1 of its own are shared. (A second random order would look at another
   half of the same set: it doubles the rows and lets hardly fewer stay, so it waits for step 3.)
2. The shingles of what stays are counted; the third order is rarest first. `alone` shingles no other set has; a set stays
   if at most m are alone. The rest lacks at most m - alone, so its prefix has m - alone + 1 shingles under each order.
3. Candidates share a prefix shingle of the third order (with the positional bound on what can still be common) and
   overlap in the prefixes of the first two. First every member of a prefix list is paired with the list's most central
   document only; components follow; then all pairs that lie in different components are paired, so that a large group
   costs rows in proportion to its size and no link between components is lost. Members that can't reach the threshold
   with the best of their list are not paired at all, and each of the others only with the members that have few enough
   shingles alone for its own bound: many documents of one passage that can't link with each other meet those only with
   which they can.
4. Candidates are verified on their whole sets (64-bit hashes of shingles).

Everything between the two passes over texts is joins and aggregations on long columns. Tables that a hot shingle could
skew are written first, so that a join meets them as plain scans and adaptive execution can split its large partitions.

Null or empty texts have empty sets and link with nothing. Rows with a null id link with nothing (component null). Rows
repeated with one id and text are one document, each with its row in the result; different texts under one id are
documents of their own, each with the component of its set (the least id of the component's documents). Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared, words
from .components import connected

SHINGLE, LEAST = 4, 85
SECOND_ORDER = np.uint64(0x5851F42D4C957F2D)


def missing(n, least: int):
    """The most shingles of a set of n that a linked partner lacks: n - ceil(least n / 100)."""
    return (100 - least) * n // 100


def n_sent(n, least: int):
    """How many first shingles of a set of n hold those that a partner of any size must find in it."""
    return missing(100 * n // least, least) + missing(n, least) + 1


def sets(column: pa.Array, shingle: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    flat, counts = words.hashed(column)
    grams = words.gapped(flat, list(range(shingle)), 77)
    out, end = [], 0
    for n in counts.tolist():
        start, end = end, end + n
        if n >= shingle:
            out.append(np.unique(grams[start : end - shingle + 1]))
        elif n:
            out.append(words.gapped(flat[start:end], list(range(n)), 80 + n))
        else:
            out.append(flat[:0])
    return out


def fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    pair = words.mixed(tokens).sum(dtype=np.uint64), words.mixed(tokens ^ np.uint64(0x1234567)).sum(dtype=np.uint64)
    return tuple(int(x.view(np.int64)) for x in pair)


def lists_of(arrays: list[np.ndarray]) -> pa.Array:
    edges = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)]).astype(np.int64)))


DESCRIBED = "doc_id long, mark long, n long, print1 long, print2 long, asks array<long>"
SET = ["print1", "print2", "n"]


def describe(shingle: int, least: int):
    """A row per document (id, mark of the text, text): the size and fingerprint of its set, its first shingles in the order of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sets(batch.column(2), shingle)
            prints = np.array([fingerprint(t) for t in found], np.int64).reshape(-1, 2)
            asks = lists_of([t[: n_sent(len(t), least)].view(np.int64) for t in found])
            sizes = pa.array([len(t) for t in found], pa.int64())
            columns = [batch.column(0), batch.column(1), sizes, pa.array(prints[:, 0]), pa.array(prints[:, 1]), asks]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "n", "print1", "print2", "asks"])

    return run


def whole_sets(shingle: int):
    """(id, text) to doc_id, n, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sets(batch.column(1), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in found], pa.int64()), lists_of([t.view(np.int64) for t in found])], ["doc_id", "n", "tokens"])

    return run


CANDIDATE = "doc_id long, n long, alone long, prefix array<long>, second array<long>, third array<long>, tokens array<long>"


def prefixes(least: int):
    """(doc_id, n, df and token of each shingle that others have) to prefixes under the three orders; `prefix` is the rarest-first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, pairs, out = batch.column(1).to_pylist(), batch.column(2), []
            flat, edges = pairs.flatten(), np.concatenate(([0], np.cumsum(np.asarray(pairs.value_lengths(), np.int64))))
            df, tokens = (np.asarray(flat.field(i), np.int64) for i in range(2))
            for i, n in enumerate(sizes):
                own = tokens[edges[i] : edges[i + 1]].view(np.uint64)
                order = np.argsort(own)
                own, rarity = own[order], df[edges[i] : edges[i + 1]][order]
                alone = n - len(own)
                first = missing(n, least) + 1 - alone
                other = words.mixed(own ^ SECOND_ORDER)
                rare = own[np.lexsort((own, rarity))[:first]]
                out.append((rare.view(np.int64), own[:first].view(np.int64), np.sort(other)[:first].view(np.int64), own.view(np.int64), alone))
            alone = pa.array([o[4] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), alone, *(lists_of([o[k] for o in out]) for k in range(4))], ["doc_id", "n", "alone", "prefix", "second", "third", "tokens"])

    return run


def lacking(least: int) -> Column:
    return F.expr(f"n * {100 - least} div 100")


def same_set() -> Column:
    """A row of `described` is of the set of _print1, _print2 and _n."""
    return (F.col("print1") == F.col("_print1")) & (F.col("print2") == F.col("_print2")) & (F.col("n") == F.col("_n")) & F.col("doc_id").isNotNull()


def set_classes(described: DataFrame) -> DataFrame:
    """A row per set: print1, print2, n, doc_id and mark of its first document, row (that one's first row), repeated (it has several), alike (the set has several rows)."""
    keyed = described.where("n > 0 and doc_id is not null").groupBy(*SET, "doc_id", "mark").agg(F.min("row").alias("row"), F.count("*").alias("rows"))
    classes = keyed.groupBy(*SET).agg(F.min(F.struct("doc_id", "mark", "row", "rows")).alias("head"), F.sum("rows").alias("rows"))
    return shared.stage(classes.select(*SET, "head.doc_id", "head.mark", "head.row", (F.col("head.rows") > 1).alias("repeated"), (F.col("rows") > 1).alias("alike")), "set-classes")


def candidates(rows: DataFrame, described: DataFrame, classes: DataFrame, shingle: int, least: int) -> DataFrame:
    """The sets that can have links, with their prefixes and tokens; a set's number stands as doc_id from here on."""
    copies = classes.where("alike").select(*[F.col(c).alias(f"_{c}") for c in SET], F.col("row").alias("first"))
    own = described.where("n > 0 and doc_id is not null").join(shared.checked_broadcast(copies), same_set(), "left").where("first is null or first = row")
    asked = own.select(F.col("row").alias("doc_id"), "n", F.explode("asks").alias("shingle"))
    met = asked.groupBy("shingle").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("shingle")
    met = asked.join(shared.stage(met, "shared-beginnings"), "shingle", "left_semi")
    met = met.groupBy("doc_id", "n").agg(F.count("*").alias("shared")).where(F.col("shared") > lacking(least))
    stays = shared.stage(met.select(F.col("doc_id").alias("_set")), "staying")
    named = described.select("row", F.col("doc_id").alias("_id"), F.col("mark").alias("_of")).join(shared.checked_broadcast(stays), F.col("row") == F.col("_set"))
    named = shared.checked_broadcast(shared.stage(named.select("_set", "_id", "_of"), "staying-rows"))
    texts = rows.join(named, (F.col("_doc") == F.col("_id")) & (F.col("_mark") == F.col("_of"))).select("_set", "_text")
    again = classes.where("repeated").select(F.col("row").alias("_set"))
    if again.limit(1).count():  # these texts come once for each of their rows
        again = shared.checked_broadcast(again)
        texts = texts.join(again, "_set", "left_anti").unionByName(texts.join(again, "_set", "left_semi").dropDuplicates(["_set"]))
    listed = shared.stage(texts.mapInArrow(shared.lean(whole_sets(shingle)), "doc_id long, n long, tokens array<long>"), "whole-sets")
    each = listed.select("doc_id", "n", F.explode("tokens").alias("token"))
    common = each.groupBy("token").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("df")).where("low < high").select("token", "df")
    common = shared.stage(common, "common-shingles")
    known = each.join(common, "token").groupBy("doc_id", "n").agg(F.collect_list(F.struct("df", "token")).alias("pairs"))
    known = known.where(F.size("pairs") >= F.col("n") - lacking(least))
    return shared.stage(known.mapInArrow(shared.lean(prefixes(least)), CANDIDATE), "ordered-sets")


def verified(pairs: DataFrame, sets_: DataFrame, least: int) -> DataFrame:
    """Of candidate pairs x, y those that overlap under the other two orders and link."""
    side = lambda s: sets_.select(*[F.col(c).alias(f"{s}_{c}") for c in ("doc_id", "n", "second", "third", "tokens")])
    both = pairs.join(side("x"), F.col("x") == F.col("x_doc_id")).join(side("y"), F.col("y") == F.col("y_doc_id"))
    both = both.where(F.arrays_overlap("x_second", "y_second") & F.arrays_overlap("x_third", "y_third"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, n_x, n_y, t_x, t_y = (batch.column(i) for i in range(6))
            n_x, n_y = np.asarray(n_x, np.int64), np.asarray(n_y, np.int64)
            common = np.array([len(np.intersect1d(np.asarray(a.values), np.asarray(b.values), True)) for a, b in zip(t_x, t_y, strict=True)], np.int64)
            linked = pa.array(100 * common >= least * (n_x + n_y - common))
            yield pa.RecordBatch.from_arrays([x.filter(linked), y.filter(linked)], ["x", "y"])

    return both.select("x", "y", "x_n", "y_n", "x_tokens", "y_tokens").mapInArrow(shared.lean(verify), "x long, y long")


def bound(s: str = "") -> Column:
    """The most that can be common if this is the first common shingle: what the order leaves from here."""
    return F.col(f"{s}n") - F.col(f"{s}alone") - F.col(f"{s}at")


def can_link(least: int) -> Column:
    most = F.least(bound("x_"), bound("y_"))
    return 100 * most >= least * (F.col("x_n") + F.col("y_n") - most)


def open_pairs(members: DataFrame, least: int) -> DataFrame:
    """Pairs x, y of one token's members with alone_y <= alone_x, and no more than a partner of x can have alone.

    A link needs 100 both >= least (n_x + n_y - both) with both <= bound_x and n_y - both >= alone_y, so alone_y is at most
    100 bound_x / least - n_x. Members are dealt to bands (token, alone), and x asks the bands of its token up to that.
    """
    side = lambda s: members.select(F.col("token").alias(f"{s}_token"), *[F.col(c).alias(f"{s}_{c}") for c in ("doc_id", "n", "alone", "at", "component")])
    bands = shared.stage(members.groupBy("token", "alone").agg(F.count("*").alias("members")), "open-bands")
    room = F.floor((100 * bound("x_") - least * F.col("x_n")) / least)
    asks = side("x").join(bands.select("token", F.col("alone").alias("band")), (F.col("x_token") == F.col("token")) & (F.col("band") <= F.least("x_alone", room)))
    pairs = asks.join(side("y"), (F.col("token") == F.col("y_token")) & (F.col("band") == F.col("y_alone")))
    return pairs.where((F.col("y_alone") < F.col("x_alone")) | (F.col("x_doc_id") < F.col("y_doc_id")))


def links(sets_: DataFrame, least: int) -> DataFrame:
    """Links x, y that connect every component (not all pairs of it)."""
    rows = sets_.select("doc_id", "n", "alone", F.posexplode("prefix").alias("at", "token"))
    lists = rows.groupBy("token").agg(F.count("*").alias("members"), F.min(F.struct((F.col("alone") / F.col("n")).alias("share"), F.col("doc_id"), F.col("n"))).alias("centre"))
    lists = shared.stage(lists.where("members > 1"), "prefix-lists")
    # every member with its list's most central document
    star = rows.join(lists, "token").where("doc_id <> centre.doc_id")
    star = star.where((100 * F.least("n", "centre.n") >= least * F.greatest("n", "centre.n")))
    star = shared.stage(star.select(F.least("doc_id", "centre.doc_id").alias("x"), F.greatest("doc_id", "centre.doc_id").alias("y")).distinct(), "star-pairs")
    first = shared.stage(verified(star, sets_, least), "star-links")
    labels = connected(first)
    # what the stars have not connected: pairs of one list in different components, not tried before
    labelled = rows.join(labels, F.col("doc_id") == F.col("node"), "left").select("token", "doc_id", "n", "alone", "at", F.coalesce("component", "doc_id").alias("component"))
    labelled = shared.stage(labelled, "labelled")
    # a partner has at least `few` shingles alone and no more in common than `most`, so whoever fails with those fails with all
    open_ = labelled.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("alone").alias("few")).where("low <> high").select("token", "few")
    open_ = labelled.join(shared.stage(open_, "open-tokens"), "token").where(100 * bound() >= least * (F.col("n") + F.col("few")))
    mixed_ = shared.stage(open_, "open-lists")
    pairs = open_pairs(mixed_, least).where((F.col("x_component") != F.col("y_component")) & can_link(least))
    pairs = pairs.select(F.least("x_doc_id", "y_doc_id").alias("x"), F.greatest("x_doc_id", "y_doc_id").alias("y")).distinct().join(star, ["x", "y"], "left_anti")
    second = verified(shared.stage(pairs, "open-pairs"), sets_, least)
    return first.union(shared.stage(second, "open-links"))


def labelled_rows(docs: DataFrame, shingle: int = SHINGLE, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark (hash of the text), n_shingles, component_id, stays (it is its component's first document): one row per input row."""
    rows = docs.select(F.col(id_col).cast("long").alias("_doc"), F.xxhash64(text_col).alias("_mark"), F.col(text_col).alias("_text"))
    described = rows.mapInArrow(shared.lean(describe(shingle, least)), DESCRIBED)
    described = shared.stage(described.withColumn("row", F.monotonically_increasing_id()), "described")
    classes = set_classes(described)
    labels = connected(links(candidates(rows, described, classes, shingle, least), least))
    linked = shared.stage(classes.join(labels, F.col("row") == F.col("node")).select(*SET, "component", "doc_id", "mark"), "linked-classes")
    heads = linked.groupBy("component").agg(F.min(F.struct("doc_id", "mark")).alias("head"))
    linked = linked.select(*SET, "component").join(shared.checked_broadcast(shared.stage(heads, "component-heads")), "component").select(*SET, "head")
    others = classes.where("alike").join(labels, F.col("row") == F.col("node"), "left_anti").select(*SET, F.struct("doc_id", "mark").alias("head"))
    found = linked.unionByName(others).select(*[F.col(c).alias(f"_{c}") for c in SET], F.col("head.doc_id").alias("component"), F.col("head.mark").alias("_first_mark"))
    found = shared.checked_broadcast(shared.stage(found, "class-components"))  # a table of its own: a shuffled join can split a class of many copies
    stays = F.col("component").isNull() | ((F.col("doc_id") == F.col("component")) & (F.col("mark") == F.col("_first_mark")))
    return described.join(found, same_set(), "left").select("doc_id", "mark", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), stays.alias("stays"))


def components(docs: DataFrame, shingle: int = SHINGLE, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row per input row."""
    return labelled_rows(docs, shingle, least, id_col, text_col).drop("mark", "stays")


def first_of_each(docs: DataFrame, shingle: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """The documents, all columns, that come first (by id, then by hash of the text) in each component; rows with null ids or empty sets stay; of rows with one id and text one stays."""
    found = labelled_rows(docs.select("doc_id", "text"), shingle, least).where("stays and doc_id is not null")
    found = shared.stage(found.groupBy(F.col("doc_id").alias("__stays"), F.col("mark").alias("__mark")).agg(F.count("*").alias("_rows")), "firsts")
    same = (F.col("doc_id") == F.col("__stays")) & (F.xxhash64("text") == F.col("__mark"))
    kept = docs.join(shared.checked_broadcast(found.select("__stays", "__mark")), same, "left_semi")
    if found.where("_rows > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id is null"))
