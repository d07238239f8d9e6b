"""The pipeline's stages, one after another, against a plain version of each on a small corpus."""

import hashlib
import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from waymark.llm import bpe, ordinal, shared

SF = "/root/testdata/sf0.001"


def corpus(spark, folder):
    """The small tables with planted copies, near copies, passages, leaks, nulls and an extra column."""
    random.seed(9)
    base = shared.table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in base.where("doc_id < 60 and length(text) > 400").collect()}
    item = shared.table(spark, SF, "benchmark").first().text
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(10**6, next(iter(texts.values()))), (10**6 + 1, f"start of its own {passage} end"), (10**6 + 2, f"another text {passage} here"), (10**6 + 3, f"it says {item} as is"), (10**6 + 4, None), (10**6 + 5, ""), (None, "no id")]
    for k, text in enumerate(list(texts.values())[:5]):
        w = text.split()
        w[random.randrange(len(w))] = "changed"
        rows.append((10**6 + 10 + k, " ".join(w)))
    extra = spark.createDataFrame([(*r, "en", "src0", len(r[1] or "")) for r in rows], base.schema)
    base.union(extra).withColumn("kind", F.lit("x")).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        shared.table(spark, SF, name).write.parquet(f"{folder}/{name}.parquet")


def test_stages_equal_plain_versions(spark, tmp_path):
    folder = f"file://{tmp_path}"
    corpus(spark, folder)
    docs = shared.table(spark, folder, "documents")
    benchmark = [tuple(r) for r in shared.table(spark, folder, "benchmark").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "quality":
            model = ordinal.train(docs, shared.table(spark, folder, "labels"))
            scores = [sum(model.weights[s] * v for s, v in zip(*ordinal.features(t or ""), strict=True)) for _, t in rows]
            expected = sorted((str(i), t) for (i, t), s in zip(rows, scores, strict=True) if ordinal.logistic(s - model.thresholds[1]) >= 0.5)
        elif name == "near_duplicates":
            firsts = {i for i, _, c in brute.components(rows, 5, 80) if i == c or i is None}
            expected = sorted({(str(i), t) for i, t in rows if i in firsts})
        elif name == "repeats":
            expected = sorted((str(i), kept.decode(errors="ignore") if gone else t) for (i, t), (_, _, gone, _, kept) in zip(rows, brute.repeats(rows), strict=True))
        elif name == "decontamination":
            expected = sorted((str(i), t) for i, t in rows if not brute.leaked_items(t, benchmark))
        done = stage(spark, docs, folder)
        done.write.parquet(f"{folder}/out-{name}")
        docs = spark.read.parquet(f"{folder}/out-{name}")
        if name != "tokens":
            assert docs.columns == columns
            got = sorted((str(r.doc_id), r.text) for r in docs.collect())
            plain = lambda x: sorted((i, t or "") for i, t in x)
            assert plain(got) == plain(expected), name
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    expected = sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest(), len(encoding.encode_ordinary(t or ""))) for i, t in rows)
    assert sorted((str(r.doc_id), r.decoded_sha256, r.n_tokens) for r in docs.collect()) == expected


def test_cut_repeats_keeps_replacement_characters(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, f"one \ufffd {passage}ñ."), (2, f"two \ufffd é {passage}ò \ufffd end")]  # ñ and ò share their first byte
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    assert got == {i: kept.decode(errors="ignore") for i, _, _, _, kept in brute.repeats(rows)}
    assert got[1] == rows[0][1] and got[2].count("\ufffd") == 2


def test_pipeline_of_empty_documents(spark, tmp_path):
    folder = f"file://{tmp_path}"
    shared.table(spark, SF, "documents").limit(0).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        shared.table(spark, SF, name).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []
