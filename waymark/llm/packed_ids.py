"""Token ids in files of fixed bit width, with block offsets for vectorised unpacking and random access.

File: magic ``WMPACK01``; blocks; footer; footer length (8 bytes, little-endian); magic. Every block holds 2**16 ids (the
last one fewer), each in the minimum bits of the vocabulary, packed little-endian into 32-bit words: 32 ids fill
exactly ``bits`` words. Footer: bits, ids, blocks, documents (8 bytes each); the blocks' byte offsets; the documents'
ids, a byte each that says whether the id is null, and their first ids (starts).

A file covers one range of (document id, text hash), in order; ranges follow each other by file name, so document
order is ascending over all files. The manifest (one row per file) gives counts; a document's start is the sum of the
files before plus the start inside. Null or empty text: the end id alone. A null document id sorts first, repeated rows
stay repeated (by text hash), other columns are not read. An empty table gives an empty manifest. Texts of any length are
encoded whole; blocks are written as they fill, so a writer holds one Arrow batch's ids, a block and the footer.

Ids are the library's for a plain `encode(text, add_special_tokens=False)`: an added token's own string in a text
(`<|endoftext|>`) becomes that token's id.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

MAGIC = b"WMPACK01"
BLOCK = 1 << 16
#: A file is closed after the Arrow batch with which it has so many ids.
FILE_IDS = 32 << 20
#: Entries of a cache of words in a worker before they become the old ones: some twenty MB.
CACHE = 200_000
MANIFEST = "path string, bits int, n_docs long, n_ids long"


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """32 ids to `bits` words of 32 bits; the tail is filled with zeros."""
    lanes = np.zeros(-(-len(ids) // 32) * 32, np.uint32)
    lanes[: len(ids)] = ids
    lanes = lanes.reshape(-1, 32)
    words = np.zeros((len(lanes), bits), "<u4")
    for lane in range(32):
        word, shift = divmod(lane * bits, 32)
        words[:, word] |= lanes[:, lane] << np.uint32(shift)
        if shift + bits > 32:
            words[:, word + 1] |= lanes[:, lane] >> np.uint32(32 - shift)
    return words.tobytes()


def unpack(blob: bytes, bits: int, count: int) -> np.ndarray:
    words = np.frombuffer(blob, "<u4").reshape(-1, bits)
    lanes = np.empty((len(words), 32), np.uint32)
    mask = np.uint32((1 << bits) - 1)
    for lane in range(32):
        word, shift = divmod(lane * bits, 32)
        value = words[:, word] >> np.uint32(shift)
        if shift + bits > 32:
            value = value | (words[:, word + 1] << np.uint32(32 - shift))
        lanes[:, lane] = value & mask
    return lanes.ravel()[:count]


class PackedWriter:
    """Takes documents one by one and writes each block as it fills; close() writes the footer and gives the file its name."""

    def __init__(self, uri: str, bits: int) -> None:
        self.part, self.bits = shared.Part(uri), bits
        self.at, self.n_ids, self.n_held = self.part.write(MAGIC), 0, 0
        self.offsets: list[int] = []
        self.held: list[np.ndarray] = []
        self.doc_ids, self.nulls, self.starts = array("q"), bytearray(), array("q")

    def add(self, doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> None:
        """Documents with their numbers of ids, and all those ids."""
        self.doc_ids.extend(d or 0 for d in doc_ids)
        self.nulls.extend(d is None for d in doc_ids)
        self.starts.extend((self.n_ids + np.cumsum(sizes) - sizes).tolist())
        self.n_ids += len(ids)
        self.n_held += len(ids)
        self.held.append(ids)
        if self.n_held >= BLOCK:
            ids = np.concatenate(self.held)
            whole = len(ids) // BLOCK * BLOCK
            for first in range(0, whole, BLOCK):
                self._block(ids[first : first + BLOCK])
            self.held, self.n_held = [ids[whole:].copy()], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        self.at += self.part.write(pack(ids, self.bits))

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        footer = np.array([self.bits, self.n_ids, len(self.offsets), len(self.doc_ids), *self.offsets], "<u8").tobytes()
        footer += np.array(self.doc_ids, "<i8").tobytes() + bytes(self.nulls) + np.array(self.starts, "<u8").tobytes()
        self.part.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.part.close()


class PackedFile:
    """Random access: only the footer and the blocks asked for are read."""

    def __init__(self, uri: str) -> None:
        store, path = shared.filesystem(uri)
        self.file = store.open_input_file(path)
        end = self.file.size()
        tail = self.file.read_at(16, end - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"not a packed id file: {uri}")
        size = int.from_bytes(tail[:8], "little")
        footer = self.file.read_at(size, end - 16 - size)
        self.bits, self.n_ids, n_blocks, self.n_docs = (int(x) for x in np.frombuffer(footer, "<u8", 4))
        self.offsets = np.frombuffer(footer, "<u8", n_blocks, 32).astype(np.int64)
        at = 32 + 8 * n_blocks
        self.doc_ids = np.frombuffer(footer, "<i8", self.n_docs, at)
        self.nulls = np.frombuffer(footer, np.uint8, self.n_docs, at + 8 * self.n_docs).astype(bool)
        self.starts = np.frombuffer(footer, "<u8", self.n_docs, at + 9 * self.n_docs).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if start >= stop:
            return np.zeros(0, np.uint32)
        parts = []
        for block in range(start // BLOCK, (stop - 1) // BLOCK + 1):
            count = min(BLOCK, self.n_ids - block * BLOCK)
            blob = self.file.read_at(-(-count // 32) * 4 * self.bits, int(self.offsets[block]))
            parts.append(unpack(blob, self.bits, count))
        return np.concatenate(parts)[start - start // BLOCK * BLOCK :][: stop - start]

    def close(self) -> None:
        self.file.close()


#: Settings of the tokenizer file (fixed values) for which ids of a text are those of its words, as WordIds takes them.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PRETOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


class Recent(dict):
    """Values of the keys asked for lately: a full cache becomes the old one, whose entries come back when asked for again."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        found = self.old.get(key)
        self[key] = found = self.make(key) if found is None else found
        return found


class WordIds:
    """Ids of texts (as bytes of unsigned 32-bit integers), by their chunks without white space.

    If the tokenizer's file declares the settings above, white space is dropped and merges stay inside words, so ids of a
    text are those of its chunks. Chunks of plain Latin letters and signs, which normalisation only lower-cases, go to the
    library's model by pre-token; any other chunk goes through the library's whole encoder. So do whole texts that may hold
    an added token's string, and all texts if the file declares anything else.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        declared = json.loads(self.whole.to_str())
        inner = [(declared.get(kind) or {}).get(parts) for kind, parts in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        model = declared["model"]
        plain_model = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback"))
        self.by_words = inner == [NORMALIZERS, PRETOKENIZERS] and plain_model and not declared.get("truncation") and not declared.get("padding")
        self.added = os.path.commonprefix([t["content"] for t in declared["added_tokens"]]) if declared["added_tokens"] else None
        self.plain = regex.compile(r"[\x21-\x7e\xa1-ɏ]*").fullmatch
        self.cut = regex.compile(SPLIT).findall
        self.bytes_as = [self._sign(b) for b in range(256)]
        self.tokenize = self.whole.model.tokenize
        self.chunks, self.words = Recent(self._chunk), Recent(self._word)

    @staticmethod
    def _sign(byte: int) -> str:
        """The printable sign that byte-level vocabularies write for a byte: itself where printable, else from U+0100 on."""
        printable = lambda b: 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
        return chr(byte) if printable(byte) else chr(256 + sum(not printable(b) for b in range(byte)))

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():  # one word
            return self.words[chunk.lower()]
        if self.plain(chunk):
            return b"".join(map(self.words.__getitem__, self.cut(chunk.lower())))
        return array("I", self.whole.encode(chunk, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        signs = word if word.isascii() else "".join([self.bytes_as[b] for b in word.encode()])
        return array("I", [t.id for t in self.tokenize(signs)]).tobytes()

    def text(self, text: str) -> bytes:
        added = self.added is not None and self.added in text
        if added or not self.by_words or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:  # white space to Python, not to the vocabulary
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.chunks.__getitem__, text.split()))


#: A worker's coders, with their words of earlier tasks (CACHE bounds them).
_CODERS: dict[str, WordIds] = {}


def write(docs: DataFrame, out_uri: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, write the files under out_uri, return the (materialised) manifest, one row per file."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = _CODERS.get(tokenizer_path) or _CODERS.setdefault(tokenizer_path, WordIds(tokenizer_path))
        bits, end = width(words.whole.get_vocab_size()), np.array([end_id], "<u4").tobytes()
        part, closed, out, path = TaskContext.get().partitionId(), 0, None, ""

        def manifest() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "bits": pa.array([bits], pa.int32()), "n_docs": [len(out.doc_ids)], "n_ids": [out.n_ids]})

        for batch in batches:
            if out is None:
                path = f"{out_uri}/part-{part:07d}-{closed:05d}.wmpack"
                out, closed = PackedWriter(path, bits), closed + 1
            coded = [words.text(text or "") + end for text in batch.column(1).to_pylist()]
            out.add(batch.column(0).to_pylist(), np.fromiter(map(len, coded), np.int64, len(coded)) // 4, np.frombuffer(b"".join(coded), "<u4"))
            if out.n_ids >= FILE_IDS:
                yield manifest()
                out = None
        if out is not None:
            yield manifest()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    ranged = rows.repartitionByRange(shared.shuffle_partitions(docs.sparkSession), "doc_id", tie).sortWithinPartitions("doc_id", tie)
    return shared.stage(ranged.mapInArrow(shared.lean(save), MANIFEST), "packed-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens long, ids binary: little-endian unsigned 32 bits), read from the files of the manifest."""
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    based = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    files = based.repartition(shared.shuffle_partitions(manifest.sparkSession), "path")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packed = PackedFile(path)
                edges = np.append(packed.starts, packed.n_ids)
                at = 0
                while at < packed.n_docs:  # about a million ids at a time
                    stop = max(at + 1, int(np.searchsorted(edges, edges[at] + (1 << 20), "right")) - 1)
                    first, last = int(edges[at]), int(edges[stop])
                    ids, rows = packed.ids(first, last), range(at, stop)
                    data = ids.astype("<u4").tobytes()
                    cuts = (edges[at : stop + 1] - first).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(packed.doc_ids[at:stop], mask=packed.nulls[at:stop]),
                            pa.array(base + edges[at:stop]),
                            pa.array(np.diff(edges[at : stop + 1])),
                            pa.array([data[4 * a : 4 * b] for a, b in pairwise(cuts)], pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )
                    at = rows.stop
                packed.close()

    return files.mapInArrow(shared.lean(load), "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, out_uri: str, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write, read back, and digest: doc_id, start, n_tokens, ids_crc32."""
    return read(write(docs, out_uri, tokenizer_path, end_id)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
