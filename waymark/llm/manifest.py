"""Merkle manifest of a data set: nested-struct rollup of ranked leaves, with a proof for every row.

A leaf is H (lowercase hex SHA-256 of its inputs one after another) of doc_id, source, lang, n_chars and text, each `-` if null,
else its UTF-8 byte count, `:` and the value. Leaves of one lang ascend by doc_id; every FANOUT consecutive nodes (the last run:
fewer, even one) become their H while more than one is left: the lang's subroot. Subroots, by lang, give the root alike.

1. Leaves are written as short rows, sorted by range into parts and numbered part by part; counts of the parts and their
   running sums (a row per part and lang) turn these numbers into ranks. No task sees a whole lang.
2. A rank's last DIGITS digits say where a leaf stands in its block of FANOUT ** DIGITS leaves (LANG_DIGITS in the tree of subroots). After one shuffle by block
   the digit columns are grouped away, the last one first, and each grouping nests the child structs in their parent's; the keys
   stay sorted, so that the groupings are one pass over a partition. A block's row is bounded, whatever the lang's size.
3. Blocks' tops are the leaves of the next level, until every lang has one block; then the subroots are.
4. From the top down, a block's row meets the path above it (one row for one row), and a transform and an explode for each
   digit give its nodes their own paths: proofs inside blocks need no join.

A proof is the siblings left and right of the node, level by level from the leaf to the root. `folded_root` is computed from
the proof with the leaf as it is now (`tampered`: n_chars + 1 where 7 divides the CRC-32 of the decimal doc_id), and `verified`
says whether it is the root.

Repeated rows are leaves of their own. Null ids come first, equal ids ascend by leaf; null langs are a group, the first. A row with a
null id is never tampered with, nor is a null n_chars. An empty table has no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

FANOUT, DIGITS, LANG_DIGITS = 2, 9, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ONE_IN = 7


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame) -> DataFrame:
    """grp (sorts like lang, null first), lang, doc_id, h (the leaf), altered (the leaf after tampering)."""
    parts = {c: F.col(c) for c in FIELDS}
    changed = parts | {"n_chars": F.try_add(F.col("n_chars"), F.lit(1))}
    leaf = lambda p: digest(*[field(p[c]) for c in FIELDS])
    hit = F.col("n_chars").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % ONE_IN == 0)
    return docs.select(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("grp"), "doc_id", leaf(parts).alias("h"), F.when(hit, leaf(changed)).alias("altered"))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with pos (from 0, in their grp) and n (rows of the grp): parts by range are numbered, and their counts summed up."""
    parts = shared.shuffle_partitions(rows.sparkSession)
    # a place of its own for each row: equal rows, however many, are dealt to several parts
    rows = rows.withColumn("_lay", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(parts, "grp", *order, "_lay").sortWithinPartitions("grp", *order, "_lay").drop("_lay")
    numbered = shared.stage(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "numbered-nodes")
    counts = numbered.groupBy("grp", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy("grp")
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = shared.stage(counts.select("grp", "_part", "_first", before.alias("_before"), F.sum("_n").over(whole).alias("n")), "part-counts")
    placed = numbered.join(shared.checked_broadcast(counts), ["grp", "_part"])
    return placed.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_first", "_before")


def levels_above(n: str) -> Column:
    """How often n nodes are hashed together until one is left."""
    return F.expr(f"size(filter(sequence(0, 52), k -> pow({FANOUT}D, k) < {n}))")


def nested(nodes: DataFrame, payload: list[str], digits: int) -> DataFrame:
    """grp, block, n, depth, node: the nodes (grp, pos, n, depth, h and payload) of each block as one nested struct with its hash."""
    digit = lambda k: F.expr(f"int(pos div {FANOUT**k} % {FANOUT})").alias(f"d{k}")
    keys = ["grp", "block", "n", "depth"]
    rows = nodes.select("grp", F.expr(f"pos div {FANOUT**digits}").alias("block"), "n", "depth", *[digit(k) for k in reversed(range(digits))], F.struct("h", *payload).alias("node"))
    rows = rows.repartition("grp", "block")
    for k in range(digits):
        left = [*keys, *[f"d{i}" for i in reversed(range(k + 1, digits))]]
        kids = [F.first(F.when(F.col(f"d{k}") == i, F.col("node")), ignorenulls=True) for i in range(FANOUT)]
        rows = rows.groupBy(*left).agg(F.array_compact(F.array(*kids)).alias("kids"))
        own = F.when(F.col("depth") > k, digest(joined(F.col("kids")))).otherwise(F.get("kids", F.lit(0))["h"])
        rows = rows.select(*left, F.struct(own.alias("h"), "kids").alias("node"))
    return rows


def joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda x: x["h"]), "")


def climb(nodes: DataFrame, payload: list[str], digits: int) -> list[DataFrame]:
    """The nested blocks, level by level, written; in the last one each grp has one block."""
    nodes = nodes.withColumn("depth", levels_above("n"))
    most, built, width = nodes.agg(F.max("n")).first()[0] or 0, [], FANOUT**digits
    while True:
        built.append(shared.stage(nested(nodes, payload, digits), "merkle-blocks"))
        if most <= width:
            return built
        most, payload = -(-most // width), []
        nodes = built[-1].select("grp", F.col("block").alias("pos"), F.expr(f"(n + {width - 1}) div {width}").alias("n"), F.greatest(F.col("depth") - digits, F.lit(0)).alias("depth"), "node.h")


def unfolded(rows: DataFrame, level: int, rest: list[str]) -> DataFrame:
    """grp, at (place among the grp's nodes of a level), depth, node, path, rest: each node's children, with what stands left and right of them."""
    kids = F.col("node")["kids"]

    def below(kid: Column, i: Column) -> Column:
        sides = F.struct(joined(F.slice(kids, F.lit(1), i)).alias("left"), joined(F.slice(kids, i + 2, F.lit(FANOUT))).alias("right"))
        return F.struct(kid.alias("node"), F.when(F.col("depth") >= level, F.concat(F.array(sides), F.col("path"))).otherwise(F.col("path")).alias("path"))

    each = rows.select("grp", "at", "depth", *rest, F.posexplode(F.transform(kids, below)).alias("i", "x"))
    return each.select("grp", (F.col("at") * FANOUT + F.col("i")).alias("at"), "depth", "x.node", "x.path", *rest)


def descend(built: list[DataFrame], tops: DataFrame, digits: int) -> DataFrame:
    """grp, node, path, and the columns of tops (grp, path above the grp's top, others): every node at the bottom.

    A path holds pairs of what stands left and right of a node and of those above it, the lowest first.
    """
    rest = [c for c in tops.columns if c not in ("grp", "path")]
    above = tops.withColumn("block", F.lit(0).cast("long"))
    for left, blocks in zip(reversed(range(len(built))), reversed(built), strict=True):
        rows = blocks.join(above, ["grp", "block"]).withColumnRenamed("block", "at")  # one row for one row
        for level in reversed(range(1, digits + 1)):
            rows = unfolded(rows, level, rest)
        if not left:
            return rows.select("grp", "node", "path", *rest)
        above = shared.stage(rows.select("grp", F.col("at").alias("block"), "path", *rest), "merkle-paths")


def proofs(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, leaf, altered, subroot, root, path (array of left and right siblings, from the leaf up)."""
    rows = shared.stage(leaves(docs), "leaves")
    built = climb(ranked(rows, ["doc_id", "h", "altered"]), ["doc_id", "altered"], DIGITS)
    subroots = shared.stage(built[-1].select(F.lit("").alias("grp"), F.col("grp").alias("of"), F.col("node.h").alias("h")), "subroots")
    over = climb(ranked(subroots, ["of"]), ["of"], LANG_DIGITS)
    root = over[-1].select("grp", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.col("node.h").alias("root"))
    tops = descend(over, root, LANG_DIGITS).select(F.col("node.of").alias("grp"), "path", "root", F.col("node.h").alias("subroot"))
    found = descend(built, shared.checked_broadcast(shared.stage(tops, "merkle-tops")), DIGITS)
    return found.select("node.doc_id", F.col("node.h").alias("leaf"), "node.altered", "subroot", "root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda below, at: digest(at["left"], below, at["right"]))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per input row."""
    found = proofs(docs)
    siblings = F.array_join(F.transform("path", lambda at: F.concat(at["left"], at["right"])), "")
    rows = found.withColumn("folded_root", folded(F.coalesce("altered", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_CRC_STEP = "xor(c, CASE WHEN i % 8 = 0 THEN ascii(t[i // 8 + 1])::BIGINT ELSE 0 END)"
_LEAF = "sha256({})".format(" || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in FIELDS))
_SIBLING = "CASE WHEN f.pos % 2 = 0 THEN sha256(f.acc || coalesce(s.h, '')) ELSE sha256(s.h || f.acc) END, f.sibs || coalesce(s.h, '')"
SQL = f"""WITH RECURSIVE d AS MATERIALIZED (
  SELECT *, coalesce('=' || lang, '-') AS grp, doc_id::VARCHAR AS t FROM documents), l AS MATERIALIZED (
  SELECT doc_id, grp, {_LEAF} AS leaf, CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, range(0, 8 * length(t))::BIGINT[]), lambda c, i:
    xor({_CRC_STEP} >> 1, CASE WHEN {_CRC_STEP} & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % {ONE_IN} = 0 THEN {_LEAF.replace("n_chars", "(n_chars + 1)")} END AS altered,
    row_number() OVER (PARTITION BY grp ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM d), a AS (
  SELECT 0 AS level, grp, pos, leaf AS h, n FROM l UNION ALL
  SELECT level + 1, grp, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2 FROM a WHERE n > 1 GROUP BY level, grp, pos // 2), am AS MATERIALIZED (
  SELECT * FROM a), sub AS MATERIALIZED (
  SELECT grp, h AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM am WHERE n = 1), b AS (
  SELECT 0 AS level, pos, subroot AS h, n FROM sub UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2 FROM b WHERE n > 1 GROUP BY level, pos // 2), bm AS MATERIALIZED (
  SELECT * FROM b), f AS (
  SELECT doc_id, grp, leaf, 0 AS level, pos, n, coalesce(altered, leaf) AS acc, '' AS sibs FROM l UNION ALL
  SELECT f.doc_id, f.grp, f.leaf, f.level + 1, f.pos // 2, (f.n + 1) // 2, {_SIBLING}
  FROM f LEFT JOIN am s ON s.grp = f.grp AND s.level = f.level AND s.pos = xor(f.pos, 1) WHERE f.n > 1), fm AS MATERIALIZED (
  SELECT * FROM f WHERE n = 1), g AS (
  SELECT fm.doc_id, fm.leaf, sub.subroot, 0 AS level, sub.pos, sub.n, fm.acc, fm.sibs FROM fm JOIN sub ON sub.grp = fm.grp UNION ALL
  SELECT f.doc_id, f.leaf, f.subroot, f.level + 1, f.pos // 2, (f.n + 1) // 2, {_SIBLING}
  FROM g f LEFT JOIN bm s ON s.level = f.level AND s.pos = xor(f.pos, 1) WHERE f.n > 1), r AS (
  SELECT h AS root FROM bm WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(sibs) AS proof_sha256, acc AS folded_root, acc = root AS verified FROM g, r WHERE g.n = 1"""
