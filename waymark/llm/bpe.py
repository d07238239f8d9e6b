"""Byte-level BPE over a corpus: distinct words are shuffled and encoded once, ids go back by position.

Encoding runs in three steps. (1) A task numbers the words of its texts in one dictionary, until that holds DICTIONARY_WORDS words or
BLOCKS blocks. Each block of texts (bounded bytes) becomes a row of numbers in order (the positions), and each dictionary one of its
words, dealt into buckets by a hash of the word. A word is a run of whole pre-tokens: what lies between two places where a space
starts a pre-token. (2) The lists are shuffled by bucket; a word meets all its mentions in one task and is encoded there
once. (3) The ids return to their dictionary, where positions pick them into documents. The rows of step 1 stay in a table
bucketed by dictionary, so that texts are never shuffled; words travel once a dictionary, ids once. What is shuffled is a row per
dictionary and bucket, however the texts are cut into blocks; a hot word is mentioned once a dictionary, so no key is large.

Rows: one per input row, in no order. Null or empty text: no ids. Null ids stay null, repeated rows stay repeated,
other columns are not read. Decoding joins ids with the token-byte table, bounded by the vocabulary, inside a task.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

BLOCK_BYTES = 4 << 20
#: A dictionary ends after so many distinct words, or blocks: bounds of a task's memory, here and where ids are put back.
DICTIONARY_WORDS, BLOCKS = 400_000, 16
#: A space that does not start a pre-token of its own: texts with one are cut by the pattern itself.
ODD_SPACE = re.compile(r"\s (?=\s|\Z)")
CODED = "dictionary long, doc_ids array<long>, counts array<int>, codes binary, numbers binary, words array<struct<bucket:int,list:binary>>"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def words_of(text: str, pattern) -> list[str]:
    """Whole pre-tokens, cut where a single space starts one; `"".join` gives the text again."""
    if "\0" in text or ODD_SPACE.search(text):
        return pattern.findall(text)
    return text.replace(" ", "\0 ").split("\0") if text else []


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


_CODED = pa.schema(
    [
        ("dictionary", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("counts", pa.list_(pa.int32())),
        ("codes", pa.binary()),
        ("numbers", pa.binary()),
        ("words", pa.list_(pa.struct([("bucket", pa.int32()), ("list", pa.binary())]))),
    ]
)


def _words_row(dictionary: int, seen: dict[str, int], n_buckets: int, press) -> pa.RecordBatch:
    """A dictionary's words by bucket, and their numbers in that order."""
    words = [w.encode() for w in seen]
    bucket_of = [zlib.crc32(w) % n_buckets for w in words]
    order = np.array(sorted(range(len(words)), key=lambda i: (bucket_of[i], words[i])), np.int64)  # neighbours share beginnings
    edges = np.searchsorted(np.array(bucket_of, np.int32)[order], np.arange(n_buckets + 1))
    lists = [{"bucket": b, "list": press(shared.pack_lists([words[i] for i in order[edges[b] : edges[b + 1]]]))} for b in range(n_buckets) if edges[b] < edges[b + 1]]
    row = {"dictionary": dictionary, "doc_ids": [], "counts": [], "codes": None, "numbers": order.astype("<u4").tobytes(), "words": lists}
    return pa.RecordBatch.from_pylist([row], _CODED)


def _coder(pattern: str, n_buckets: int):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import zstandard

        press = zstandard.ZstdCompressor(level=9).compress
        cut, names = regex.compile(pattern), shared.block_number()
        seen, held, dictionary = _Numbers(), 0, next(names)
        for group in shared.blocks(batches, 1, BLOCK_BYTES):
            flat, counts, ids = [], [], []
            for batch in group:
                ids += batch.column(0).to_pylist()
                for text in batch.column(1):
                    found = words_of(text.as_py() or "", cut)
                    counts.append(len(found))
                    flat.append(np.fromiter(map(seen.__getitem__, found), np.uint32, len(found)))
            codes = np.concatenate([np.zeros(0, np.uint32), *flat])
            planes = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T)
            yield pa.RecordBatch.from_pylist([{"dictionary": dictionary, "doc_ids": ids, "counts": counts, "codes": planes.tobytes(), "numbers": None, "words": []}], _CODED)
            held += 1
            if held >= BLOCKS or len(seen) >= DICTIONARY_WORDS:
                yield _words_row(dictionary, seen, n_buckets, press)
                seen, held, dictionary = _Numbers(), 0, next(names)
        if held:
            yield _words_row(dictionary, seen, n_buckets, press)

    return code


def _encoder(ranks, pattern: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        import zstandard

        press, unpress = zstandard.ZstdCompressor().compress, zstandard.ZstdDecompressor().decompress
        encode_one = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={}).encode_ordinary
        known: dict[bytes, bytes] = {}
        bucket_now = None
        for batch in batches:
            dictionary, bucket, lists = (batch.column(i).to_pylist() for i in range(3))
            out = []
            for b, blob in zip(bucket, lists, strict=True):
                if b != bucket_now:  # rows come sorted by bucket: words of others are not met again
                    known.clear()
                    bucket_now = b
                got = []
                for word in shared.unpack_lists(unpress(blob)):
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = np.array(encode_one(word.decode()), "<u4").tobytes()
                    got.append(ids)
                out.append(press(shared.pack_lists(got)))
            yield pa.RecordBatch.from_arrays([pa.array(dictionary, pa.int64()), pa.array(bucket, pa.int32()), pa.array(out, pa.binary())], ["dictionary", "bucket", "ids"])

    return encode


def _assemble(key, coded: pa.Table, encoded: pa.Table) -> pa.Table:
    import zstandard

    unpress = zstandard.ZstdDecompressor().decompress
    lists = dict(zip(encoded.column("bucket").to_pylist(), map(unpress, encoded.column("ids").to_pylist()), strict=True))
    out = [pa.RecordBatch.from_pylist([], pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))]
    sizes, data = [], []
    for b in sorted(lists):
        n = int(np.frombuffer(lists[b], "<u4", 1)[0])
        sizes.append(np.frombuffer(lists[b], "<u4", n, 4) // 4)
        data.append(np.frombuffer(lists[b], "<u4", -1, 4 * (n + 1)))
    sizes = np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)
    data = np.concatenate(data).astype(np.int32) if data else np.zeros(0, np.int32)
    # by bucket so far; by number from here on
    numbers = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x, "<u4") for x in coded.column("numbers").to_pylist() if x)])
    starts = np.empty(len(numbers), np.int64)
    starts[numbers] = np.cumsum(sizes) - sizes
    by_number = np.empty(len(numbers), np.int64)
    by_number[numbers] = sizes
    sizes = by_number
    for row in range(coded.num_rows):
        planes = np.frombuffer(coded.column("codes")[row].as_buffer() or b"", np.uint8)
        codes = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()
        doc_ids = coded.column("doc_ids")[row].values
        ends = np.cumsum(np.asarray(coded.column("counts")[row].values, np.int64))
        at = 0
        while at < len(ends):  # slices of bounded size
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + 1_000_000, "right")))
            part = codes[before : ends[stop - 1]]
            n = sizes[part]
            ids = data[shared.ragged(starts[part], n)]
            edges = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], ends[at:stop] - before))]
            out.append(pa.RecordBatch.from_arrays(
                [doc_ids.slice(at, stop - at), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids))], ["doc_id", "ids"]
            ))
            at = stop
    return pa.Table.from_batches(out)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, ids array<int>), one row per input row."""
    spark: SparkSession = docs.sparkSession
    n = shared.shuffle_partitions(spark)
    name = shared.scratch_table("bpe")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows.mapInArrow(shared.lean(_coder(pattern, 2 * n)), CODED).write.bucketBy(n, "dictionary").option("compression", "zstd").option("path", shared.scratch_path(spark, "bpe")).saveAsTable(name)
    coded = spark.table(name)
    ranks = shared.sent(spark, load_ranks(ranks_path))  # bounded by the vocabulary
    lists = word_lists(coded).repartition(n, "bucket").sortWithinPartitions("bucket")
    encoded = lists.mapInArrow(shared.lean(_encoder(ranks, pattern)), "dictionary long, bucket int, ids binary")
    return coded.drop("words").groupBy("dictionary").cogroup(encoded.groupBy("dictionary")).applyInArrow(_assemble, "doc_id long, ids array<int>")


def word_lists(coded: DataFrame) -> DataFrame:
    """dictionary, bucket, list: what is shuffled."""
    return coded.select("dictionary", F.explode("words").alias("w")).select("dictionary", "w.bucket", "w.list")


def decode(tokens: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "bytes") -> DataFrame:
    """tokens with a binary column of the tokens' bytes in order; null ids give null."""
    table = shared.sent(tokens.sparkSession, {rank: token for token, rank in load_ranks(ranks_path).items()})
    at = tokens.columns.index(ids_col)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(table.value, default=-1) + 1
        token_bytes = np.empty(most, object)
        for rank, token in table.value.items():
            token_bytes[rank] = token
        for batch in batches:
            out = []
            for ids in batch.column(at):
                out.append(b"".join(token_bytes[np.asarray(ids.values)].tolist()) if ids.is_valid else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, out_col])

    fields = [f for f in tokens.schema.fields if f.name != out_col]
    schema = type(tokens.schema)([*fields]).add(out_col, "binary")
    return tokens.select(*[f.name for f in fields]).mapInArrow(shared.lean(join), schema)


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the decimal ids and of the decoded bytes."""
    decoded = decode(encode(docs, ranks_path, pattern), ranks_path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
