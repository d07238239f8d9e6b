"""Quality rules with cross-document line frequency.

Lines are normalised (lower case, white space as one space, digits as 0) and hashed; each hash is counted by distinct
documents of its host. Lines in more than MAX_DOCUMENTS documents of a host are removed; a document that keeps less than
half of its words is depleted and rejected. Base rules: at least MIN_WORDS words, and at most 30 % of the words inside
8-word windows that occur twice or more in the document.

DataFrame functions only. Texts are cut into lines once, without a shuffle, and the line hashes are written to the shared folder.
Occurrences are counted from there by (host, line, document), so that a line of a third of all documents is spread, and then by
(host, line) as partial sums. Frequent lines are broadcast only if their measured bytes allow it; beyond that the join
shuffles. Texts are not shuffled for the verdict (only `clean_text`, if it is asked for, joins them with their frequent lines).

Null or empty text: no words, base_failed. Null hosts are one host. Null ids are one document for the counts. A line's
frequency is by document id; a verdict is by row (host, id and text), so that repeated rows get the verdict that one gets and
texts under one id (or none) don't mix. Very long texts are judged whole. Columns of these names are replaced. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checked_broadcast, stage

MAX_DOCUMENTS, MIN_WORDS, WINDOW = 10, 20, 8
SPACES = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"


def no_space(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), GAP, " ")), "[0-9]", "0"))


def held(docs: DataFrame, **columns: Column) -> DataFrame:
    """docs with columns that are computed once, here: the optimiser neither merges a generator's columns into later
    expressions (where a lambda would compute an array again for every element) nor pushes filters on them below it."""
    return docs.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def base_metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    kept = docs.drop(*METRICS).withColumn("__lf_text", F.coalesce(F.col(text_col), F.lit("")))
    kept = held(kept, __lf_words=F.transform(words_of(F.col("__lf_text")), lambda w: F.xxhash64(w)))
    size = F.size("__lf_words")
    windows = F.transform(F.sequence(F.lit(1), size - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__lf_words", i, WINDOW)))
    kept = held(kept, __lf_windows=F.when(size >= WINDOW, windows))
    repeated = F.size(F.array_distinct("__lf_windows")) < F.size("__lf_windows")
    kept = held(kept, __lf_placed=F.when(repeated, F.array_sort(F.transform("__lf_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda p, k: F.coalesce(F.get("__lf_placed", k)["h"] == p["h"], F.lit(False))
    starts = F.transform(F.filter("__lf_placed", lambda p, k: same(p, k - 1) | same(p, k + 1)), lambda p: p["i"])
    lines = F.filter(F.split("__lf_text", "\n"), lambda line: no_space(line) != "")
    kept = held(kept, __lf_starts=F.array_sort(starts), __lf_lines=lines)
    covered = F.transform("__lf_starts", lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get("__lf_starts", k + 1) - at, F.lit(WINDOW))))
    counts = held(
        kept,
        n_words=F.size("__lf_words").cast("long"),
        word_chars=F.length(no_space(F.col("__lf_text"))).cast("long"),
        n_symbols=(F.length("__lf_text") - F.length(F.translate("__lf_text", "#*$%&|<>", ""))).cast("long"),
        n_dup_lines=(F.size("__lf_lines") - F.size(F.array_distinct("__lf_lines"))).cast("long"),
        n_repeat_words=F.coalesce(F.aggregate(covered, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long"),
    )
    out = counts.drop("__lf_text", "__lf_words", "__lf_windows", "__lf_placed", "__lf_starts", "__lf_lines")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_lines", "n_removed_words", "kept", "clean_text"]


def frequent_lines(docs: DataFrame, max_documents: int = MAX_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """(a row per line with a word: host, doc, row, line, n words; the lines above the limit: host, line, n_documents), both written."""
    named = docs.select(F.col("source").alias("host"), F.col("doc_id").alias("doc"), row_key().alias("row"), F.explode(F.split("text", "\n")).alias("raw"))
    named = named.where(no_space(F.col("raw")) != "").select("host", "doc", "row", line_hash(F.col("raw")).alias("line"), F.size(words_of(F.col("raw"))).alias("n"))
    lines = stage(named, "lines")
    counts = lines.select("host", "line", "doc").distinct().groupBy("host", "line").agg(F.count("*").alias("n_documents"))
    return lines, stage(counts.where(F.col("n_documents") > max_documents), "frequent-lines")


def row_key() -> Column:
    return F.xxhash64("source", "doc_id", "text")


def apply_rules(docs: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """All columns of docs, the metrics, n_removed_lines, n_removed_words, kept, clean_text (without frequent lines)."""
    lines, frequent = frequent_lines(docs, max_documents)
    frequent = checked_broadcast(frequent.select(F.col("host").alias("__lf_host"), F.col("line").alias("__lf_line")))
    hit = lines.join(frequent, F.col("host").eqNullSafe(F.col("__lf_host")) & (F.col("line") == F.col("__lf_line")), "left_semi")
    # equal rows have one key: their sums are those of one row times their number
    removed = hit.groupBy(F.col("row").alias("__lf_row")).agg(F.count("*").alias("__lf_n_lines"), F.sum("n").alias("__lf_n_words"), F.collect_set("line").alias("__lf_removed"))
    copies = docs.groupBy(row_key().alias("__lf_copy")).agg(F.count("*").alias("__lf_copies")).where("__lf_copies > 1")
    removed = removed.join(copies, F.col("__lf_row") == F.col("__lf_copy"), "left").drop("__lf_copy")
    rows = base_metrics(docs.withColumn("__lf_own", row_key())).join(removed, F.col("__lf_own") == F.col("__lf_row"), "left")
    of_one = lambda name: F.coalesce((F.col(name) / F.coalesce("__lf_copies", F.lit(1))).cast("long"), F.lit(0).cast("long"))
    lost = F.least(of_one("__lf_n_words"), F.col("n_words"))
    clean = F.array_join(F.filter(F.split("text", "\n"), lambda line: (no_space(line) == "") | ~F.array_contains("__lf_removed", line_hash(line))), "\n")
    return rows.select(
        *[c for c in rows.columns if not c.startswith("__lf_")],
        of_one("__lf_n_lines").alias("n_removed_lines"),
        lost.alias("n_removed_words"),
        (~F.col("base_failed") & (2 * (F.col("n_words") - lost) >= F.col("n_words"))).alias("kept"),
        F.when(F.col("__lf_removed").isNull(), F.col("text")).otherwise(clean).alias("clean_text"),
    )


def verdicts(docs: DataFrame) -> DataFrame:
    named = [c for c in METRICS if c != "clean_text"]
    return apply_rules(docs.select("doc_id", "source", "text")).select("doc_id", *named)


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT rid, i, array_to_string(w[i:i+7], ' ') AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), c AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g
), p AS (
  SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM c WHERE n >= 2
), r AS (
  SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words FROM p GROUP BY rid
), l AS (
  SELECT rid, doc_id, source, unnest(string_split(t, chr(10))) AS line FROM d
), lw AS (
  SELECT rid, doc_id, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         regexp_replace(trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]', '0', 'g') AS norm
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), u AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lw GROUP BY rid
), f AS (
  SELECT source, norm FROM (SELECT DISTINCT source, norm, doc_id FROM lw) GROUP BY source, norm HAVING count(*) > 10
), x AS (
  SELECT rid, count(*) AS n_lines, sum(n) AS n_words FROM lw JOIN f ON lw.source IS NOT DISTINCT FROM f.source AND lw.norm = f.norm GROUP BY rid
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(x.n_lines, 0)::BIGINT AS n_removed_lines, coalesce(x.n_words, 0)::BIGINT AS n_removed_words
  FROM d LEFT JOIN r ON d.rid = r.rid LEFT JOIN u ON d.rid = u.rid LEFT JOIN x ON d.rid = x.rid
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 2 * (n_words - n_removed_words) >= n_words AS kept
FROM m
"""
