"""The corpus pipeline: STAGES over documents, each written as Parquet and read again as the next one's input.

1. quality: the ordinal classifier is fitted on the labels; documents that it rejects go.
2. near_duplicates: of each component of documents alike in at least 80 % of their five-word shingles the one with the least id stays.
3. repeats: byte strings of 100 bytes that start earlier in the corpus are cut out of the texts (characters cut in two go as well).
4. decontamination: documents that hold benchmark passages go.
5. tokens: byte-level BPE of what is left, with digests of ids and decoded bytes.

No stage fails on nulls, empty texts or repeated rows; each operator's module says what it does with them.
"""

from __future__ import annotations

import uuid
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import bpe, decontaminate, jaccard_join, ordinal, repeats, shared


#: Whose scratch the stages make: a run's own, so that neither another run nor a query loses what it has not read yet.
_RUN: ContextVar[str] = ContextVar("run", default="pipeline")


def _stage(work):
    """A stage whose scratch goes when the next one of its run begins: it has been written by then."""

    @wraps(work)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shared.begin(spark)
        shared.release(spark, _RUN.get())
        with shared.owner(_RUN.get()):
            return work(spark, docs, sf_dir)

    return staged


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = ordinal.train(docs, shared.table(spark, sf_dir, "labels"))
    return ordinal.predict(docs, model, prefix="__quality_").where("__quality_kept").select(*docs.columns)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.first_of_each(docs, shingle=5, least=80)


@_stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = repeats.deduplicate(docs, whole_characters=True, prefix="__cut_")
    text = F.when(F.col("__cut_n_removed") > 0, F.col("__cut_kept_bytes").cast("string")).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, shared.table(spark, sf_dir, "benchmark"))


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeats", cut_repeats),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: Training, components and token merges are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = shared.table(spark, sf_dir, "documents"), None
    token = _RUN.set(f"pipeline-{uuid.uuid4().hex}")
    try:
        for name, stage in STAGES:
            path = shared.scratch_path(spark, f"pipeline-{name}", owned=name == STAGES[-1][0])
            done = stage(spark, docs, sf_dir)
            done.write.parquet(path)
            docs = spark.read.schema(done.schema).parquet(path)
            if before:  # a stage's input goes when its output is whole
                shared.delete(spark, before)
            before = path
        shared.release(spark, _RUN.get())
    finally:
        _RUN.reset(token)
    return docs
