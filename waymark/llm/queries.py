"""One query per operator, with production parameters over whole tables, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import lexical, line_frequency, manifest, perspectives, warc
from .shared import begin, scratch_path, table


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ordinal

    begin(spark)
    return ordinal.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard_join

    begin(spark)
    return jaccard_join.components(table(spark, sf_dir, "documents"))


def op3_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.verdicts(table(spark, sf_dir, "documents"))


def op5_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import packed_ids

    begin(spark)
    return packed_ids.round_trip(table(spark, sf_dir, "documents"), scratch_path(spark, "packed-ids"), public_tokenizers.path("word_bpe_49k.json"))


def op6_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import page_text

    begin(spark)
    return page_text.extract(table(spark, sf_dir, "pages"))


def op7_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    begin(spark)
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    begin(spark)
    return warc.round_trip(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))


def op9_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repeats

    begin(spark)
    return repeats.digests(table(spark, sf_dir, "documents"))


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    begin(spark)
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_language_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    begin(spark)
    return langid.identify(table(spark, sf_dir, "documents"))


def op12_best_position_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    begin(spark)
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    begin(spark)
    return manifest.manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ordinal_quality": op1_ordinal_quality,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_perspective_rotation": op3_perspective_rotation,
    "op4_line_frequency": op4_line_frequency,
    "op5_packed_ids": op5_packed_ids,
    "op6_site_templates": op6_site_templates,
    "op7_byte_level_bpe": op7_byte_level_bpe,
    "op8_warc_transactions": op8_warc_transactions,
    "op9_suffix_repeats": op9_suffix_repeats,
    "op10_spaced_seeds": op10_spaced_seeds,
    "op11_language_families": op11_language_families,
    "op12_best_position_search": op12_best_position_search,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLE_SQL: dict[str, str] = {
    "op3_perspective_rotation": perspectives.SQL,
    "op4_line_frequency": line_frequency.SQL,
    "op8_warc_transactions": warc.SQL,
    "op12_best_position_search": lexical.SQL,
    "op13_merkle_manifest": manifest.SQL,
}
