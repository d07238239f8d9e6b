"""Operators against brute force, round trips and hand-made cases: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from tests.llm import brute
from waymark.llm import bpe, components, decontaminate, jaccard_join, langid, lexical, line_frequency, manifest, ordinal, packed_ids, page_text, perspectives, repeats, shared, warc
from waymark.llm import words as hashed_words

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [(None, "an id that is null"), (-5, None), (-4, ""), (-3, " \t\n"), (-2, "a  b   c \n d\n\n  e  x's ÉÀ ß 12 \x00 z 　 q \x1c r"), (-1, "x" * 20_000), (-7, "same row"), (-7, "same row")]


def documents(spark, extra=()):
    base = shared.table(spark, SF, "documents").select("doc_id", "text")
    return base.union(spark.createDataFrame([*ODD, *extra], "doc_id long, text string"))


def clashing(df):
    """The same rows with columns named like inner and added ones."""
    for name in ("block", "kept", "ids", "bytes", "n_bytes", "component", "token", "_doc", "mark", "bucket"):
        df = df.withColumn(name, F.lit("clash"))
    return df


# --- helpers
def test_lists_round_trip():
    assert shared.unpack_lists(shared.pack_lists([b"", b"a\0b", b"xyz"])) == [b"", b"a\0b", b"xyz"]
    assert shared.ragged(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    data = np.frombuffer(b"0123456789abc", np.uint8)
    assert hashed_words.words_of_eight(data).tolist() == [int.from_bytes(bytes(data[i : i + 8]), "little") for i in range(6)]
    assert len(hashed_words.words_of_eight(data[:7])) == 0


def test_broadcast_only_what_fits(spark):
    rows = spark.range(1000).withColumn("s", F.repeat(F.lit("x"), F.lit(100))).withColumn("a", F.array("id", "id"))
    assert shared.fits(rows, 1000 * (24 + 24 + 100 + 32)) and not shared.fits(rows, 1000 * (24 + 24 + 100 + 31)) and shared.fits(rows.limit(0), 0)


def test_scratch_belongs_to_its_owner(spark, tmp_path):
    with shared.owner("a"):
        mine = shared.stage(spark.range(3), "kept")
    with shared.owner("b"):
        other = shared.stage(spark.range(4), "gone")
        shared.stage(spark.range(5), "kept")
        shared.forget(spark, "kept")  # b's own, not a's
    shared.release(spark, "b")
    assert mine.count() == 3
    with pytest.raises(Exception, match="(?i)no such file|does not exist|not found"):
        other.collect()
    shared.release(spark, "a")
    shared.release(spark, "nobody")


def test_scratch_follows_the_session(spark):
    assert shared.scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


# --- byte-level BPE
def test_words_are_whole_pre_tokens():
    cut = regex.compile(public_tokenizers.PATTERN)
    random.seed(1)
    for _ in range(3000):
        text = "".join(random.choice(["a", "b'", "'s", " ", "  ", "\n", "\t", "é", "1", "!", "\xa0", "\0"]) for _ in range(random.randrange(14)))
        parts = bpe.words_of(text, cut)
        assert "".join(parts) == text
        assert [m for p in parts for m in cut.findall(p)] == cut.findall(text), repr(text)


def test_bpe_equals_the_library_and_decodes(spark):
    docs = documents(spark)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    expected = Counter()
    for row in docs.collect():
        ids = encoding.encode_ordinary(row.text or "")
        expected[row.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((row.text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.digests(clashing(docs), RANKS, public_tokenizers.PATTERN).collect())) == expected
    assert bpe.digests(docs.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


def test_bpe_shuffles_a_row_per_dictionary_and_bucket(spark, monkeypatch):
    docs = shared.table(spark, SF, "documents").select("doc_id", "text").coalesce(1)
    expected = Counter(map(tuple, bpe.digests(docs, RANKS, public_tokenizers.PATTERN).collect()))

    def shuffled(size, blocks):
        monkeypatch.setattr(bpe, "BLOCK_BYTES", size)
        monkeypatch.setattr(bpe, "BLOCKS", blocks)
        coded = docs.mapInArrow(bpe._coder(public_tokenizers.PATTERN, 8), bpe.CODED)
        return coded.where("codes is not null").count(), bpe.word_lists(coded).count()

    few, many, more = shuffled(4 << 20, 1000), shuffled(20_000, 1000), shuffled(20_000, 5)
    assert few[0] == 1 and many[0] > 10 and few[1] == many[1] == 8 and more[1] == 8 * -(-many[0] // 5)
    assert Counter(map(tuple, bpe.digests(docs, RANKS, public_tokenizers.PATTERN).collect())) == expected


def test_decode_keeps_null_ids(spark):
    rows = spark.createDataFrame([(1, [0]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.bytes for r in bpe.decode(rows, RANKS).collect()}
    assert got[2] is None and bytes(got[3]) == b"" and len(got[1]) >= 1


# --- packed ids
@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 31, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003, dtype=np.uint64).astype(np.uint32)
    assert (packed_ids.unpack(packed_ids.pack(ids, bits), bits, len(ids)) == ids).all()


def test_packed_files_round_trip(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    monkeypatch.setattr(packed_ids, "BLOCK", 1 << 10)
    docs = documents(spark, [(-20, "ΣΑΣ İ ǅ é <|endoftext|> ﬁ ①² x\x1fy"), (-20, "other text of one id")])
    expected, start, ids_of = Counter(), 0, {}
    for row in sorted(docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h)):
        ids = [*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 2]
        ids_of[start] = ids
        expected[row.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        start += len(ids)
    manifest = packed_ids.write(clashing(docs), f"file://{tmp_path}/ids", WORDS, 2)
    got = packed_ids.read(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc"))
    assert Counter(map(tuple, got.collect())) == expected
    packed = packed_ids.PackedFile(manifest.orderBy("path").first().path)  # random access into the middle
    assert packed.bits == 16
    a, b = int(packed.starts[3]), int(packed.starts[4])
    assert packed.ids(a, b).tolist() == ids_of[a] and packed.ids(a + 1, b - 1).tolist() == ids_of[a][1:-1] and packed.ids(b, b).tolist() == []
    assert packed_ids.round_trip(docs.limit(0), f"file://{tmp_path}/none", WORDS).collect() == []


def test_ids_by_words_only_under_the_declared_settings(tmp_path):
    import json

    from tokenizers import Tokenizer

    texts = ["Some Words, and MORE'S words 42!", "a<|endoftext|>b <|STARTOFTEXT|>", "<|startoftext|>", "", "e\u0301 fi"]
    assert packed_ids.WordIds(WORDS).by_words
    changed = json.load(open(WORDS))
    changed["normalizer"]["normalizers"].pop()
    path = tmp_path / "other.json"
    path.write_text(json.dumps(changed))
    assert not packed_ids.WordIds(str(path)).by_words
    for name in (WORDS, str(path)):
        plain, own = Tokenizer.from_file(name), packed_ids.WordIds(name)
        for text in texts:
            assert np.frombuffer(own.text(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


# --- WARC
def test_warc_round_trip(spark, tmp_path):
    odd = [(10**6, None, None), (10**6 + 2, "http://a", "x" * 100), (10**6 + 3, "http://b\nc", "x" * 100), (10**6 - 1, "u", "x" * 100), (None, "n", "x" * 100), (7 * 10**6, "q", "x" * 99), (8 * 10**6, "q", "x" * 99), (10**6 - 1, "u", "x" * 100)]
    pages = shared.table(spark, SF, "pages").union(spark.createDataFrame(odd, "page_id long, url string, html string"))
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for i, html in rows:
        if len(html) >= 100 and i is not None:
            first[html] = min(first.get(html, i), i)
    expected = Counter()
    for i, html in rows:
        other = first.get(html) if first.get(html) != i else None
        expected[i, len(html), hashlib.sha256(html).hexdigest(), "response" if other is None else "revisit", other, 1, 1] += 1
    assert Counter(map(tuple, warc.round_trip(clashing(pages), f"file://{tmp_path}/w").collect())) == expected
    assert warc.round_trip(pages.limit(0), f"file://{tmp_path}/none").collect() == []


def test_warc_records_without_a_capture_are_kept(spark, tmp_path):
    path = tmp_path / "x.warc"
    record = lambda kind, name, extra, body: f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\n{extra}Content-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"
    path.write_bytes("".join([record("response", "r", "", "abc"), record("request", "q", "WARC-Concurrent-To: <r>\r\n", "GET"), record("metadata", "m", "WARC-Concurrent-To: <gone>\r\n", "a: b"), record("warcinfo", "i", "", "")]).encode())
    files = warc.archives(spark, str(path))
    got = {r.transaction_id: r for r in warc.transactions(warc.read(files)).collect()}
    assert set(got) == {"<r>", "<gone>", "<i>"}
    assert got["<r>"].capture.payload_bytes == 3 and [q.record_id for q in got["<r>"].requests] == ["<q>"]
    assert got["<gone>"].capture is None and [m.record_id for m in got["<gone>"].metadata] == ["<m>"]


def test_damaged_archives_keep_what_can_be_read(spark, tmp_path):
    import gzip

    record = lambda kind, name, size, body: f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\nContent-Length: {size}\r\n\r\n{body}\r\n\r\n".encode()
    good = record("response", "r", 3, "abc")
    (tmp_path / "short.warc").write_bytes(good + record("response", "s", 999, "cut"))
    (tmp_path / "number.warc").write_bytes(good + record("response", "n", "x", "abc"))
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(good) + gzip.compress(record("response", "c", 40_000, "".join(map(str, range(9000)))[:40_000]))[:-900])
    (tmp_path / "none.warc").write_bytes(b"no archive\n")
    found = warc.read(warc.archives(spark, str(tmp_path))).collect()
    assert Counter((r.record_type, r.record_id) for r in found) == Counter([("response", "<r>")] * 3 + [("damaged", "<s>"), ("damaged", "<n>"), ("damaged", "<c>")])
    nameless = spark.createDataFrame([(None, "warcinfo", [], {}, None, 0, ""), (None, "warcinfo", [], {}, None, 0, ""), ("a", "response", [], {}, b"1", 1, ""), ("a", "response", [], {}, b"2", 1, "")], warc.RECORD)
    got = warc.transactions(nameless).collect()
    assert len(got) == 3 and [len(r.captures) for r in got if r.transaction_id == "a"] == [2]


def test_archives_are_read_on_after_damaged_members(spark, tmp_path):
    import gzip

    random.seed(1)

    def member(name, size):
        body = "".join(random.choice("abcdefgh") for _ in range(size))
        digest = hashlib.sha256(body.encode()).hexdigest()
        return gzip.compress(f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <{name}>\r\nWARC-Payload-Digest: sha256:{digest}\r\nContent-Length: {size}\r\n\r\n{body}\r\n\r\n".encode())

    whole = [member(f"r{i}", 90_000) for i in range(6)]
    changed = whole[1][:5000] + bytes(40) + whole[1][5040:]
    (tmp_path / "a.warc.gz").write_bytes(whole[0] + changed + whole[2] + whole[3][:20_000] + whole[4] + bytes(100) + whole[5] + bytes(2))
    (tmp_path / "b.warc.gz").write_bytes(whole[0] + b"\x1f\x8b\x08 no member" * 3 + whole[5])
    (tmp_path / "c.warc.gz").write_bytes(b"")
    found = warc.read(warc.archives(spark, str(tmp_path))).collect()
    assert sorted(r.record_id for r in found if r.record_type == "response") == ["<r0>", "<r0>", "<r2>", "<r4>", "<r5>", "<r5>"]
    assert {"<r1>", "<r3>"} <= {r.record_id for r in found if r.record_type == "damaged"}


# --- decontamination
def test_masks_hit_every_allowed_window():
    for bad in itertools.combinations(range(decontaminate.WINDOW), decontaminate.SUBSTITUTIONS):
        assert any(not set(bad) & {at + o for o in mask} for mask in decontaminate.MASKS for at in range(decontaminate.WINDOW - max(mask))), bad


def test_decontamination_equals_brute_force(spark):
    random.seed(5)
    benchmark = [(r.item_id, r.text) for r in shared.table(spark, SF, "benchmark").collect()] + [(900, "one two three four five six seven eight"), (901, "too short"), (902, None)]
    rows = [(-30, benchmark[3][1]), (-31, "well one two three four five six seven eight then"), (-32, "one two three four five six seven nine")]
    for k in range(150):
        w = random.choice(benchmark[:40])[1].split()
        at = random.randrange(max(1, len(w) - 13))
        w = w[at : at + random.randrange(10, 25)]
        for _ in range(random.randrange(5)):
            w[random.randrange(len(w))] = "zz"
        rows.append((10**6 + k, " ".join(["pre"] * random.randrange(4) + w + ["post"] * random.randrange(30))))
    docs = documents(spark, rows).where("doc_id is null or doc_id <> -1 or length(text) < 100")
    table = spark.createDataFrame(benchmark, "item_id long, text string")
    got = Counter((r.doc_id, r.contaminated, r.n_items) for r in decontaminate.report(clashing(docs), clashing(table)).collect())
    expected = Counter()
    for r in docs.collect():
        n = len(brute.leaked_items(r.text, benchmark))
        expected[r.doc_id, n > 0, n] += 1
    assert got == expected
    kept = decontaminate.clean(clashing(docs), table)
    assert kept.columns == clashing(docs).columns and kept.count() == sum(n for (_, leaks, _), n in expected.items() if not leaks)
    assert decontaminate.report(docs.limit(0), table).count() == 0
    assert not any(r.contaminated for r in decontaminate.report(docs, table.limit(0)).collect())


def test_decontamination_of_long_texts_and_by_row(spark):
    long_item = " ".join(f"i{k}" for k in range(20_000))
    far = " ".join(f"i{k}" for k in range(19_980, 19_997))
    rows = [(1, "x " * 30_000 + far), (1, "a clean text under the same id"), (None, far.replace("i19985", "other")), (None, "a clean text without an id"), (2, "y " * 50_000), (3, far), (3, far)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame([(None, long_item), (7, long_item), (8, " ".join("ab" for _ in range(2000)))], "item_id long, text string")
    got = Counter((r.doc_id, r.contaminated, r.n_items, r.n_agreeing) for r in decontaminate.report(docs, table).collect())
    assert got == Counter([(1, True, 2, 13), (1, False, 0, 0), (None, True, 2, 12), (None, False, 0, 0), (2, False, 0, 0), (3, True, 2, 13), (3, True, 2, 13)])
    assert {r.text for r in decontaminate.clean(docs, table).collect()} == {rows[1][1], rows[3][1], rows[4][1]}


def test_decontamination_in_passes_and_of_shared_contexts(spark, monkeypatch):
    random.seed(9)
    head = [f"h{i}" for i in range(40)]  # an instruction at the head of every item
    own = {k: [f"w{k}_{i}" for i in range(25)] for k in range(30)}
    table = spark.createDataFrame([(k, " ".join(head + w)) for k, w in own.items()], "item_id long, text string")
    rows = [(i, " ".join(["p"] * i + head + ["q"] * 20)) for i in range(20)] + [(100 + k, " ".join(w)) for k, w in own.items()] + [(200, "nothing of it " * 30), (201, " ".join(head[:11] + ["x", "y"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    places = decontaminate.places(table)
    contexts = decontaminate.contexts(places)
    # inside the instruction a context is one for all items: only those that reach an item's own words are each item's
    assert places.count() == 30 * 65 and contexts.count() == 40 - 12 + 30 * (25 + 12)
    expected = Counter()
    for i, text in rows:
        n = len(brute.leaked_items(text, [(r.item_id, r.text) for r in table.collect()]))
        expected[i, n > 0, n] += 1
    for most in (1 << 20, 700):
        monkeypatch.setattr(decontaminate, "PASS_SEEDS", most)
        got = decontaminate.report(docs, table)
        assert Counter((r.doc_id, r.contaminated, r.n_items) for r in got.collect()) == expected
    assert expected[3, True, 30] == 1 and expected[105, True, 1] == 1
    plain = decontaminate.overlaps(docs, table).groupBy("doc_id").agg(F.count_distinct("item").alias("n"))
    assert {(r.doc_id, r.n) for r in plain.collect()} == {(i, n) for (i, leaks, n) in expected if leaks}


# --- ordinal classifier
def test_ordinal_held_out(spark):
    docs, labels = (shared.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    model = ordinal.train(docs, labels, 2000)
    assert (np.diff(model.thresholds) > 0).all()
    graded = labels.select("doc_id", ordinal.grade().alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").offset(2000)
    rows = ordinal.predict(docs, model).join(graded, "doc_id").groupBy("grade").agg(F.avg(F.col("kept").cast("double")).alias("kept"), F.avg("expected_grade").alias("mean")).collect()
    got = {r.grade: r for r in rows}
    assert got[2].kept > 0.98 and got[1].kept < 0.35 and got[0].kept < 0.2
    assert got[0].mean < got[1].mean < got[2].mean


def objective(x, grades, w, cut, penalty):
    """Mean loss of the cumulative-link model and its L1 penalty, as defined."""
    score = x @ w
    edges = np.concatenate(([-np.inf], cut, [np.inf]))
    upper, lower = (1 / (1 + np.exp(-(edges[grades + k] - score))) for k in (1, 0))
    return -np.log(np.maximum(upper - lower, 1e-12)).mean() + penalty * np.abs(w).sum()


def test_ordinal_fit_reaches_the_plain_optimum(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(ordinal, "STEPS", 3000)
    x = (rng.random((300, 6)) < 0.4).astype(float)
    grades = np.digitize(x @ np.array([2.0, -1.5, 1.0, 0, 0, 0]) + rng.logistic(size=300), [-0.5, 1.0])
    doc, slots = np.nonzero(x)
    model = ordinal.fit(slots.astype(np.int32), np.ones(len(slots), np.float32), np.bincount(doc, minlength=300), grades)
    scale = 1 / np.sqrt((x**2).sum(0) / 300 + 20 / 300)  # the penalty is on scaled weights
    w, cut = model.weights[:6] / scale, model.thresholds
    best = objective(x * scale, grades, w, cut, ordinal.PENALTY)
    edge = 1e-4
    for k in range(6):  # no single step makes it better
        for step in (-0.05, 0.05):
            other = w.copy()
            other[k] += step
            assert objective(x * scale, grades, other, cut, ordinal.PENALTY) > best - edge
    for k in range(2):
        for step in (-0.05, 0.05):
            other = cut.copy()
            other[k] += step
            assert objective(x * scale, grades, w, other, ordinal.PENALTY) > best - edge
    plain_w, plain_cut = np.zeros(6), np.array([-1.0, 1.0])  # plain proximal steps with numeric gradients
    for _ in range(1500):
        grad = lambda i, h=1e-5: (objective(x * scale, grades, plain_w + h * np.eye(6)[i], plain_cut, 0) - objective(x * scale, grades, plain_w - h * np.eye(6)[i], plain_cut, 0)) / (2 * h)
        grad_cut = lambda i, h=1e-5: (objective(x * scale, grades, plain_w, plain_cut + h * np.eye(2)[i], 0) - objective(x * scale, grades, plain_w, plain_cut - h * np.eye(2)[i], 0)) / (2 * h)
        g, g_cut = np.array([grad(i) for i in range(6)]), np.array([grad_cut(i) for i in range(2)])
        plain_w = plain_w - 0.5 * g
        plain_w = np.sign(plain_w) * np.maximum(np.abs(plain_w) - 0.5 * ordinal.PENALTY, 0)
        plain_cut = plain_cut - 0.5 * g_cut
    assert abs(best - objective(x * scale, grades, plain_w, plain_cut, ordinal.PENALTY)) < 1e-4
    assert np.abs(w - plain_w).max() < 0.02 and np.abs(cut - plain_cut).max() < 0.02


def test_ordinal_scores_are_features_times_weights():
    import pyarrow as pa

    weights = np.random.default_rng(2).normal(size=ordinal.DIMENSIONS).astype(np.float32)
    texts = ["", None, "  ", "Fine fine fine! words\n\tHERE HERE É\xa0x", "BAD!! " * 50, "x" * 30_000, " a "]
    got = ordinal.scores(pa.array(texts), weights)
    expected = [sum(float(weights[s]) * float(v) for s, v in zip(*ordinal.features(t or ""), strict=True)) for t in texts]
    assert np.allclose(got, expected, rtol=1e-4, atol=1e-4)


def test_ordinal_of_repeated_ids(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    rows = [(i, f"{'good' if i % 2 else 'poor'} w{i}") for i in range(60)]
    one, many = (ordinal.train(spark.createDataFrame(r, "doc_id long, text string"), labels) for r in (rows, [*rows, *rows[:30] * 5]))
    assert np.allclose(one.weights, many.weights) and np.allclose(one.thresholds, many.thresholds)


def test_ordinal_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (None, 1, 0), (4, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "fine words here"), (2, "BAD!! BAD!!"), (3, "stupid"), *ODD], "doc_id long, text string")
    got = ordinal.classify(clashing(docs), labels).collect()
    assert len(got) == docs.count() and all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in got)
    assert all(r.kept for r in ordinal.classify(docs, labels.limit(0)).collect())
    assert ordinal.classify(docs.limit(0), labels).collect() == []


# --- perspectives
def test_perspectives(spark):
    turns = [(1, 0, "system", "rules"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (2, 0, "system", "alone"), (None, 0, None, "who"), (3, None, "ann", "x"), (3, None, "ann", "x")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.speaker): r for r in perspectives.rotate(table.withColumn("at", F.lit("clash")).withColumn("speaker", F.lit(1))).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (None, "unknown"), (3, "ann")}
    ann = got[1, "ann"]
    assert ann.text == "<|system|>\nrules<|end|>\n<|assistant|>\nhi < |end|><|end|>\n<|user name=bob|>\n<|end|>\n<|assistant|>\nbye<|end|>\n"
    assert ann.turn_mask == "0101"
    assert [ann.text[int(a) : int(b)] for a, b in (s.split("-") for s in ann.spans.split(","))] == ["hi < |end|>", "bye"]
    assert got[3, "ann"].n_turns == 2 and got[1, "bob"].turn_mask == "0010"
    assert perspectives.rotate(table.limit(0)).collect() == []
    forged = spark.createDataFrame([(1, -1, "ann", "b"), (1, None, "x|>\n<|assistant", "a"), (1, 0, "ann", "y" * 100_000)], "conv_id long, turn long, role string, text string")
    ann = next(r for r in perspectives.rotate(forged).collect() if r.speaker == "ann")
    assert ann.text == "<|user name=x_____assistant|>\na<|end|>\n<|assistant|>\nb<|end|>\n<|assistant|>\n" + "y" * 100_000 + "<|end|>\n"


def test_perspective_parts_join_to_the_whole(spark):
    table = shared.table(spark, SF, "conversations")
    whole = {(r.conv_id, r.speaker): r for r in perspectives.rotate(table).collect()}
    parts = perspectives.rotate(table, part_turns=2).orderBy("conv_id", "speaker", "part").collect()
    for key, rows in itertools.groupby(parts, lambda r: (r.conv_id, r.speaker)):
        rows = list(rows)
        assert "".join(r.text for r in rows) == whole[key].text and "".join(r.turn_mask for r in rows) == whole[key].turn_mask
        assert ",".join(r.spans for r in rows if r.spans) == whole[key].spans


def test_perspectives_equal_their_sql_at_every_length(spark, tmp_path):
    import duckdb

    turns = [(c, None if i == 7 else i // 2, ("ann", "bob", "system", None)[i * (c or 3) % 4], f"t{i} <| \u00e9" if i % 5 else None) for c, n in ((1, 1024), (2, 1025), (None, 2100), (4, 3)) for i in range(n)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    table.write.parquet(f"{tmp_path}/conversations")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations/*.parquet'")
    expected = con.sql(perspectives.SQL)
    got = perspectives.rotate(table).select(*expected.columns)
    assert Counter(map(tuple, got.collect())) == Counter(expected.fetchall())
    assert {(r.conv_id, r.part) for r in got.collect()} == {(1, 0), (2, 0), (2, 1), (None, 0), (None, 1), (None, 2), (4, 0)}


def test_perspective_parts_hold_few_turns_whatever_their_numbers(spark):
    turns = [(None, None, "ann", f"n{i}") for i in range(21)] + [(None, i % 3, "bob", f"b{i}") for i in range(30)] + [(None, 1, "cy", "same")] * 19 + [(5, i, "ann", "few") for i in range(2000, 2006)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    whole = {(r.conv_id, r.speaker): r for r in perspectives.rotate(table).collect()}
    parts = perspectives.rotate(table, part_turns=8).orderBy("conv_id", "speaker", "part").collect()
    assert max(r.n_turns for r in parts) == 8 and len(parts) == 3 * 9 + 1 and len(whole) == 4
    for key, rows in itertools.groupby(parts, lambda r: (r.conv_id, r.speaker)):
        rows = list(rows)
        assert [r.part for r in rows] == list(range(len(rows)))
        assert "".join(r.text for r in rows) == whole[key].text and "".join(r.turn_mask for r in rows) == whole[key].turn_mask
        assert ",".join(r.spans for r in rows if r.spans) == whole[key].spans


# --- line frequency
def test_line_rules_equal_brute_force(spark):
    rows = [(i, "h", f"unique line number {'abcdefghijkl'[i]} with its own words here\nShared  LINE 1{i}\nShared line {i}7") for i in range(12)]
    rows += [(100, None, None), (101, None, ""), (102, "h", " \n\t\n"), (103, "g", "a b c d e f g h i j " * 30), (104, "g", "x " * 8 + "y " * 40 + "\r\nz\x0bq"), (105, "h", "shared line 10\n" * 3)]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string").union(shared.table(spark, SF, "documents").select("doc_id", "source", "text").withColumn("doc_id", F.col("doc_id") + 1000))
    expected = brute.line_rules([tuple(r) for r in table.collect()])
    got = line_frequency.apply_rules(clashing(table).withColumn("host", F.lit("clash")))
    for r in got.collect():
        assert {k: r[k] for k in expected[r.doc_id]} == expected[r.doc_id], r.doc_id
    assert line_frequency.verdicts(table.limit(0)).collect() == []
    clean = {r.doc_id: r.clean_text for r in got.where("doc_id in (0, 105)").collect()}
    assert clean[0] == "unique line number a with its own words here" and clean[105] == ""
    twice = table.union(table.where("doc_id = 3"))
    assert line_frequency.verdicts(twice).where("doc_id = 3").count() == 2
    assert Counter(map(tuple, line_frequency.verdicts(twice).collect())) == Counter(map(tuple, line_frequency.verdicts(table).collect())) + Counter(map(tuple, line_frequency.verdicts(table).where("doc_id = 3").collect()))
    mixed = spark.createDataFrame([(None, "h", rows[0][2]), (None, "h", "no frequent line " * 8)] + [(r[0], r[1], r[2]) for r in [*rows[1:12], rows[-1]]], "doc_id long, source string, text string")
    assert {r.n_words: r.n_removed_lines for r in line_frequency.verdicts(mixed).where("doc_id is null").collect()} == {len(rows[0][2].split()): 2, 24: 0}


# --- page text
@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain", "plain"),
        ("<p>a <b>b<br>c</b>\n d<p>e &amp; f&nbsp;g &lt;i&gt;", "a b c d\n\ne & f g <i>"),
        ("<header>top</header><nav>menu</nav><article><header><h1>T</h1></header><p>x</p><aside>s</aside><div class='reader-comments'>c</div><footer>f</footer></article><p>out</p>", "T\n\nx"),
        ("<main><div id=cookie-banner>n</div><ul><li>a<li>b</ul></main>rest", "a\n\nb"),
        ("<body><script>var t='</p>';</script><style>p{}</style><!-- c --><form>f</form>kept<p", "kept"),
        ("<div>a<table><tr><td>1<td>2</table></div></p>b", "a\n\n1\n\n2\n\nb"),
        ("<article><p>one</article><article><p>two</p></article>", "one\n\ntwo"),
        ("<textarea>t</textarea><p title='a > b'>x<!-- open", "x"),
    ],
)
def test_main_text(page, text):
    assert page_text.main_text(page) == text


STORY = f"<h1>Head</h1><p>{'story text goes on ' * 12}</p><p>second part</p>"
NAV = "<nav><ul><li><a href=x>a</a></li></ul></nav>"
FOOT = f"<footer><p>{'legal words ' * 90}</p></footer>"


#: Pages around the same story, and what else their text holds.
STORIES = [
    (f"<body>{NAV}<div class='content has-sidebar'>{STORY}</div>{FOOT}</body>", ""),
    (f"<div class='share-price-report'>{STORY}</div>{FOOT}", ""),
    (f"<div class='layout no-comments'>{STORY}</div><div class='reader-comments'><p>{'me too ' * 200}</p></div>", ""),
    (f"<body><form id=aspnetForm action=x>{NAV}{STORY}<label>Mail<input></label><button>Go</button><select><option>1</select></form></body>", "Mail"),
    (f"<div>{STORY}</div><article class=card><h3>Teaser</h3><p>More</p></article>", "Teaser\n\nMore"),
    (f"<body><header>Site</header><section><header>{STORY[:13]}</header>{STORY[13:]}</section></body>", ""),
    (f"<header><h1>Logo</h1><p>line</p></header><article>{STORY}</article><p>out</p>", ""),
    (f"<article>{STORY}<div class=comments-area><article class=comment><p>{'me too ' * 200}</p></article></div></article>", ""),
    (f"<div class=content-sidebar-wrap><div class=content>{STORY}</div><div class='widget sidebar-wrapper'><p>x</p></div></div>", ""),
    (f"<div class=promo>{STORY}</div><div class=ad-slot>ad</div><div class=ad_container><p>Buy</p></div><div id=share-buttons>Share</div>", ""),
    (f"<aside><article><h3>t</h3><p>{'teaser ' * 100}</p></article></aside><div>{STORY}</div>", ""),
    (f"<form><p>Name<input></p></form><div>{STORY}</div>", ""),
]


@pytest.mark.parametrize(("page", "more"), STORIES)
def test_names_never_delete_the_story(page, more):
    story = page_text.main_text(STORY)
    assert page_text.main_text(page) == (f"{story}\n\n{more}" if more else story)


def test_stories_of_small_hosts_are_whole(spark):
    story = page_text.main_text(STORY)
    table = spark.createDataFrame([(i, f"http://host{i}.org/", page) for i, (page, _) in enumerate(STORIES)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in page_text.extract(table).collect()}
    assert got == {i: f"{story}\n\n{more}" if more else story for i, (_, more) in enumerate(STORIES)}


def test_site_templates_are_removed_per_host(spark):
    box = "<div><span>Follow us everywhere</span></div>"
    rows = [(i, f"http://{'ab'[i % 2]}.org/{i}", f"<body>{box if i % 2 else ''}<div><p>story {i}</p></div></body>") for i in range(30)]
    rows += [(100, "http://a.org/z", f"<body>{box}<p>own</p></body>"), (101, None, None), (102, "http://b.org/same", rows[1][2]), (None, "http://b.org/n", rows[1][2])]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in page_text.extract(clashing(table)).collect()}
    assert got[3].text == "story 3" and got[100].text == "Follow us everywhere\n\nown" and got[101].text == "" and got[101].n_chars == 0
    assert len(got) == len(rows) and page_text.extract(table.limit(0)).collect() == []


def test_template_counting_alone_finds_the_article(spark):
    pages = shared.table(spark, "/root/testdata/sf0.1", "pages").where("html is not null")
    host = F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1))
    large = pages.groupBy(host.alias("_host")).count().where("count >= 20")
    pages = pages.withColumn("_host", host).join(large, "_host", "left_semi").drop("_host")
    counted = {r.page_id: r.text for r in page_text.extract(pages, by_name=False).collect()}
    named = {r.page_id: r.text for r in page_text.extract(pages).collect()}
    assert len(counted) > 1500 and sum(counted[i] == named[i] for i in named) >= 0.99 * len(named)


def test_templates_equal_a_plain_version(spark):
    pages = shared.table(spark, "/root/testdata/sf0.01", "pages")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    page = "<body><div class='box'>Sale {i} now</div><div class='menu{i}'><ul><li>a{i}<li>b</ul></div><div><p>text {i}{more}</p></div></body>"
    rows += [(10**6 + i, "http://s.org/x", page.format(i=i, more="")) for i in range(12)]
    rows += [(2 * 10**6 + i, "http://l.org/x", page.format(i=i, more=" with many words of its own")) for i in range(12)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in page_text.extract(table, by_name=False).collect()}
    assert got == brute.page_texts(rows)
    assert got[10**6 + 3] == "Sale 3 now\n\ntext 3"  # the box holds over a third of the page's text: no template by shape
    assert got[2 * 10**6 + 3] == "text 3 with many words of its own"


def test_broken_and_long_pages():
    import time

    began = time.time()
    assert page_text.main_text('<p class="x>a</p>' * 20_000).count("a") == 10_000  # by HTML's rule the next quote ends the value, in the next tag
    assert page_text.main_text("<div>" * 50_000 + "x" + "</div>" * 50_000) == "x"
    assert page_text.main_text("</div>" * 50_000 + "<p>" * 50_000 + "y") == "y"
    assert page_text.main_text("word " * 400_000).count("word") == 400_000
    assert time.time() - began < 30


# --- repeats
def test_repeats_equal_brute_force(spark):
    random.seed(2)
    base = "".join(random.choice("abcdefgh ") for _ in range(2500))
    rows = [(None, base[:500]), (-20, "a" * 1000), (-21, "a" * 99), (-22, "a" * 100), (-23, "ab" * 300 + "\0" * 250 + "é" * 130), (-24, base), (-24, base), (-25, "é" * 50 + "\0" * 101)]
    for k in range(60):
        a, n = random.randrange(2200), random.choice([95, 99, 100, 101, 130, 220])
        rows.append((10**6 + k, f"X{k}" * random.randrange(30) + base[a : a + n] + f"Y{k}" * random.randrange(30) + base[(a * 7) % 2000 :][:105]))
    docs = documents(spark, rows)
    expected = Counter((i, n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, n, gone, spans, kept in brute.repeats([tuple(r) for r in docs.collect()]))
    assert Counter(map(tuple, repeats.digests(clashing(docs)).collect())) == expected
    kept = repeats.deduplicate(clashing(docs))
    assert sorted(kept.columns) == sorted({*clashing(docs).columns, "n_bytes", "n_removed", "n_spans", "kept_bytes"}) and kept.count() == docs.count()
    assert repeats.digests(docs.limit(0)).collect() == []


def test_longest_previous_factors():
    random.seed(3)
    for n in (0, 1, 2, 7, 60, 300):
        position = np.array(random.sample(range(n), n) if n % 2 else [random.randrange(n) for _ in range(n)], np.int64)
        shares = np.array([0 if i == 0 else random.choice([0, 5, 99, 100, 101, 140, 168]) if n < 100 else random.choice([100, 120, 130]) for i in range(n)], np.int32)
        expected = []
        for i in range(n):
            best = 0
            for step in (-1, 1):
                j, low = i, 1 << 30
                while True:
                    if not 0 <= j + step < n:
                        break
                    low = min(low, shares[j] if step < 0 else shares[j + 1])
                    j += step
                    if position[j] < position[i]:
                        best = max(best, low if low >= 100 else 0)
                        break
            expected.append(best)
        assert repeats.longest_previous(position, shares).tolist() == expected


def test_suffix_order_is_the_order_of_suffixes():
    random.seed(8)
    base = "".join(random.choice("ab") for _ in range(30)) * 9
    contexts = sorted({base[a : a + 100 + random.randrange(69)] for a in random.sample(range(100), 40)})
    sizes = np.array([len(c) for c in contexts])
    texts = np.zeros((len(contexts), 2 * sizes.max()), np.uint8)
    for row, c in zip(texts, contexts, strict=True):
        row[: len(c)] = np.frombuffer(c.encode(), np.uint8)
    context, step, shares = repeats.suffix_order(texts, sizes)
    suffixes = [contexts[c][s:] for c, s in zip(context.tolist(), step.tolist(), strict=True)]
    assert len(suffixes) == sum(sizes - 99) and len({(c, s) for c, s in zip(context.tolist(), step.tolist(), strict=True)}) == len(suffixes)
    n = int((shares > 0).sum())
    for a, b, k in zip(suffixes, suffixes[1:], shares[1:].tolist(), strict=False):
        common = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert k == common or (k == 0 and common < 100)
    assert n > 100 and suffixes[: n // 2] == sorted(suffixes[: n // 2])


def rounds(texts):
    """The steps of `removals` without Spark: {doc: (starts, stops)}, and the most windows of a group in a round."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in texts]), pa.array([7 * k for k, _ in texts]), pa.array([t for _, t in texts])], ["doc", "key", "text"])
    grams = Counter(g for b in repeats.find_anchors(iter([batch.select(["key", "text"])])) for g in b.column(0).to_pylist())
    asked = [[{"gram": g, "copies": n} for g, n in grams.items() if n > 1]] * len(texts)
    kind = pa.list_(pa.struct([("gram", pa.int64()), ("copies", pa.int64())]))
    parts = [batch.slice(i, 10).append_column("asked", pa.array(asked[i : i + 10], kind)) for i in range(0, len(texts), 10)]
    rows = [r for b in repeats.cut_contexts(iter(parts)) for r in b.to_pylist()]
    found, most, n_rounds = {k: ([], []) for k, _ in texts}, 0, 0
    while rows:
        most = max([most, *Counter((r["part"], r["salt"]) for r in rows).values()])
        rows.sort(key=lambda r: (r["part"], r["salt"]))
        out = [r for b in repeats.settle(iter([pa.RecordBatch.from_pylist(rows[i : i + 50], repeats.DEALT_ARROW) for i in range(0, len(rows), 50)])) for r in b.to_pylist()]
        for r in out:
            if r["bytes"] is None:
                found[r["doc"]][0].append(r["start"])
                found[r["doc"]][1].append(r["stop"])
        rows = [r | {"at": r["start"]} for r in out if r["bytes"] is not None]
        n_rounds += 1
    return found, most, n_rounds


def same_as_plain(texts, found):
    for i, n, removed, spans, _ in brute.repeats(texts):
        start, stop = repeats.removed_ranges(*(np.array(x, np.int64) for x in found[i]), n)
        assert (len(start), int((stop - start).sum())) == (spans, removed), i


def test_repeats_over_pieces_and_groups(monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 700)
    monkeypatch.setattr(repeats, "SORTED", 500)
    random.seed(4)
    base = "".join(random.choice("abcd") for _ in range(4000))
    texts = [(k, base[k * 150 : k * 150 + 900] + str(k) * 3 + base[: 200 + k]) for k in range(20)]
    same_as_plain(texts, rounds(texts)[0])


def test_repeats_of_a_passage_in_many_documents(monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 4000)
    monkeypatch.setattr(repeats, "GROUP", 4)
    monkeypatch.setattr(repeats, "SORTED", 300)
    random.seed(6)
    own = lambda: "".join(random.choice("abcdefgh ") for _ in range(180))
    passage = own() + own()
    texts = [(k, own() + passage + own()) for k in range(80)]
    found, most, n_rounds = rounds(texts)
    same_as_plain(texts, found)
    assert n_rounds == 4 and most < 20  # 80 contexts in 20 groups, then 5, 2 and 1


def test_every_removal_is_decided_by_an_lpf_value(monkeypatch):
    texts = [(k, "the same text of some length for all documents, " * 5 + str(k)) for k in range(6)]
    assert any(starts for starts, _ in rounds(texts)[0].values())
    monkeypatch.setattr(repeats, "longest_previous", lambda position, shares: np.zeros(len(position), np.int32))
    assert not any(starts for starts, _ in rounds(texts)[0].values())


# --- Jaccard join
def near_copies():
    random.seed(2)
    base, hot = [f"w{i}" for i in range(300)], [f"h{i}" for i in range(60)]
    rows = [(-40, "a b"), (-41, "A  b"), (-42, "a\xa0b"), (-43, "x y z"), (-43, "x y z"), (-44, "x Y z"), (-45, "x y z w"), (None, "x y z")]
    for k in range(150):
        w = list(base)
        for _ in range(random.choice([0, 1, 2, 3, 4, 5, 6, 8, 12])):
            w[random.randrange(len(w))] = f"m{k}_{random.randrange(99)}"
        rows.append((10**6 + k, " ".join(w)))
    rows += [(2 * 10**6 + k, " ".join(hot + [f"q{k}_{i}" for i in range(random.randrange(1, 14))])) for k in range(80)]
    rows += [(3 * 10**6 + k, " ".join(random.choice("abc") for _ in range(random.randrange(1, 9)))) for k in range(120)]
    return rows


@pytest.mark.parametrize(("shingle", "least"), [(4, 85), (5, 80)])
def test_jaccard_components_equal_brute_force(spark, shingle, least):
    docs = documents(spark, near_copies())
    expected = brute.components([tuple(r) for r in docs.collect()], shingle, least)
    assert Counter(map(tuple, jaccard_join.components(clashing(docs), shingle, least).collect())) == expected


@pytest.mark.parametrize("least", [85, 80])
def test_first_shingles_are_enough_for_every_size(least):
    for n in range(1, 400):
        m = jaccard_join.missing(n, least)
        for other in range(n, 100 * n // least + 1):
            if 100 * n >= least * other or 100 * (n - m) >= least * (n + other - n + m):
                assert jaccard_join.n_sent(n, least) >= jaccard_join.missing(other, least) + m + 1 and jaccard_join.n_sent(other, least) >= jaccard_join.missing(other, least) + m + 1


@pytest.mark.parametrize(("shingle", "least"), [(4, 85), (5, 80)])
def test_jaccard_small_sets_of_words_nobody_else_has(spark, shingle, least):
    random.seed(shingle)
    rows = []
    for k in range(400):
        w = [f"v{k}_{i}" for i in range(random.randrange(1, 41))]
        rows.append((10 * k, " ".join(w)))
        for j in range(1, random.randrange(2, 4)):
            x = list(w)
            for _ in range(random.randrange(1, 4)):
                at = random.randrange(len(x) + 1)
                x[at : at + random.randrange(2)] = [f"z{k}_{j}_{random.randrange(9)}"] * random.randrange(2)
            rows.append((10 * k + j, " ".join(x)))
    found = Counter(map(tuple, jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string"), shingle, least).collect()))
    assert found == brute.components(rows, shingle, least)


def test_jaccard_different_texts_under_one_id(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "g h i j k l"), (3, "g h i j k l"), (4, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, jaccard_join.components(docs).collect())) == Counter([(1, 3, 1), (2, 3, 1), (2, 3, 2), (3, 3, 2), (4, 3, 1)])
    assert Counter(map(tuple, jaccard_join.first_of_each(docs).collect())) == Counter([rows[0], rows[2]])


@pytest.mark.parametrize(("shingle", "least"), [(4, 85), (5, 80)])
def test_jaccard_of_repeated_rows_and_ids(spark, shingle, least):
    random.seed(least)
    rows = []
    for k in range(60):  # near copies at 60 to 95 %, with rows repeated and ids shared by texts of one size
        w = [f"r{k}_{i}" for i in range(random.choice([30, 100, 140]))]
        for j in range(3):
            keep = random.randrange(60, 96)
            x = w[: len(w) * keep // 100] + [f"o{k}_{j}_{i}" for i in range(len(w) - len(w) * keep // 100)]
            rows += [(random.randrange(3 * k, 3 * k + 4), " ".join(x))] * random.choice([1, 1, 2, 5])
    rows += [(3, "a b c d e f g h"), (3, "a b c d e f g h"), (None, "a b c d e f g h"), (4, "a b c d e f g i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected = brute.components_by_set(rows, shingle, least)
    assert Counter(map(tuple, jaccard_join.components(docs, shingle, least).collect())) == expected
    # one row of each component stays, and those with a null id
    kept = Counter(map(tuple, jaccard_join.first_of_each(docs, shingle, least).collect()))
    assert max(kept.values()) == 1 and kept[None, "a b c d e f g h"] == 1
    assert all(len(g) == 1 for g in brute.groups_of([row for row in kept if row[0] is not None], shingle, least))
    assert {i for i, _ in kept} == {c for _, _, c in expected}
    n_components = len({id(g) for g in brute.groups_of(rows, shingle, least)})
    assert len(kept) == n_components + 1


def test_jaccard_repeats_make_no_false_links(spark):
    w = [f"w{i}" for i in range(110)]
    a, b = " ".join(w), " ".join(w[:90] + [f"x{i}" for i in range(20)])  # 87 of 107 shingles each
    docs = spark.createDataFrame([(3, a), (3, a), (4, b)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.components(docs).collect())) == [(3, 107, 3), (3, 107, 3), (4, 107, 4)]
    assert sorted(r.doc_id for r in jaccard_join.first_of_each(docs).collect()) == [3, 4]
    y, z = ([f"{c}{i}" for i in range(60)] for c in "yz")
    docs = spark.createDataFrame([(1, " ".join(w[:60] + y[:43])), (1, " ".join(w[60:103] + z)), (2, " ".join(w[:103]))], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.components(docs).collect())) == [(1, 100, 1), (1, 100, 1), (2, 100, 2)]


def test_members_that_can_not_link_are_not_paired(spark):
    # 5,000 documents of one passage, each with as much of its own as a set may have, and three that share all they have
    names = "doc_id long, token long, n long, alone long, at long, component long"
    rows = [(i, 1, 100, 15, 0, i) for i in range(5000)] + [(5000 + i, 1, 85 + i, 0, 0, 5000 + i) for i in range(3)]
    members = spark.createDataFrame(rows, names).repartition(4)
    pairs = jaccard_join.open_pairs(members, 85)
    assert pairs.count() <= 3 * 5000 + 3
    random.seed(3)
    rows = [(i, i % 3, n := random.randrange(20, 60), random.randrange(0, 5), random.randrange(0, 4), random.randrange(60)) for i in range(150)]
    members = spark.createDataFrame(rows, names)
    met = jaccard_join.open_pairs(members, 85).where(jaccard_join.can_link(85)).select("x_doc_id", "y_doc_id").collect()

    def may(x, y):
        most = min(x[2] - x[3] - x[4], y[2] - y[3] - y[4])
        return x[1] == y[1] and x[0] < y[0] and 100 * most >= 85 * (x[2] + y[2] - most)

    assert sorted(tuple(sorted(r)) for r in met) == sorted((x[0], y[0]) for x in rows for y in rows if may(x, y))


@pytest.mark.parametrize(("shingle", "least"), [(4, 85), (5, 80)])
def test_jaccard_links_one_word_more(spark, shingle, least):
    rows = []
    for n in range(shingle, 40):
        w = [f"p{n}_{i}" for i in range(n)]
        rows += [(2 * n, " ".join(w)), (2 * n + 1, " ".join([*w, "more"]))]
    found = Counter(map(tuple, jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string"), shingle, least).collect()))
    assert found == brute.components(rows, shingle, least)


def test_jaccard_first_of_each(spark):
    docs = documents(spark, near_copies())
    found = brute.components([tuple(r) for r in docs.collect()])
    kept = jaccard_join.first_of_each(clashing(docs))
    assert kept.columns == clashing(docs).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({i: n if i is None else 1 for (i, _, c), n in found.items() if i == c or i is None}) | Counter({None: sum(n for (i, _, _), n in found.items() if i is None)})
    assert jaccard_join.components(docs.limit(0)).collect() == []


def test_connected_components_of_a_long_chain(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (7, 7)]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(pairs, "x long, y long")).collect()}
    assert got == {i: 0 for i in range(41)} | {98: 98, 99: 98, 100: 98}


def test_word_hashes():
    import pyarrow as pa

    flat, counts = hashed_words.hashed(pa.array(["A b\x0bé\xa0x", None, "", "a B"]))
    assert counts.tolist() == [3, 0, 0, 2] and flat[0] == flat[3] and flat[1] == flat[4]


# --- language families
def test_languages_are_told_apart_on_held_out_rows(spark):
    docs = shared.table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.train(docs)
    assert model.languages == ["de", "en", "es", "fr"] and sorted(map(len, model.families)) == [2, 2]
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(spark):
    odd = [(None, "the and with", None), (-1, None, "en"), (-2, "", "en"), (-3, "12 34 ... \u2603 \u00b2", "de"), (-4, "\u4f60\u597d", None), (-5, "a", None), (-6, "the " * 400_000, None), (-6, "the " * 400_000, None)]
    base = shared.table(spark, SF, "documents").select("doc_id", "text", "lang")
    docs = base.union(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    rows = [tuple(r) for r in langid.identify(clashing(docs.withColumn("held_out", F.lit(True)).withColumn("score", F.lit("x")))).collect()]
    got = Counter(rows)
    assert sum(got.values()) == docs.count()
    assert {r[0] for r in rows if r[2] == "und"} == {-1, -2, -3} and all(r[3] == 0.0 for r in rows if r[2] == "und")
    assert [r for r in rows if r[0] is None][0][1] is False and got[[r for r in rows if r[0] == -6][0]] == 2
    assert langid.identify(docs.limit(0)).collect() == []
    unlabelled = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in unlabelled.collect()} == {("und", 0.0)}
    single = langid.identify(docs.where("lang = 'en' or lang is null"))
    assert {(r.lang_pred, r.score) for r in single.collect()} == {("und", 0.0), ("en", 1.0)}
    # labels, sources and ids of predicted rows change nothing
    held = docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    rest = docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.lit(True)))
    other = langid.identify(rest.union(held.withColumn("lang", F.lit("xx"))))
    assert Counter(map(tuple, other.collect())) == got


def test_language_pieces_lose_no_n_gram(monkeypatch):
    random.seed(4)
    texts = ["".join(random.choice("abc \u00e9\u00df1") for _ in range(random.randrange(1, 300))) for _ in range(40)]
    weights = np.random.default_rng(0).normal(size=(langid.DIMENSIONS, 3)).astype(np.float32)

    def sums():
        pieces = langid.Pieces()
        n = [pieces.add(i, t) for i, t in enumerate(texts)]
        return langid.margins(pieces, len(texts), weights), n

    whole, n = sums()
    monkeypatch.setattr(langid, "PIECE", 17)
    cut, m = sums()
    assert n == m and np.allclose(whole, cut)
    plain = np.zeros((len(texts), 3))
    for i, text in enumerate(texts):
        data = b" " + bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in text.lower().encode()) + b"  "
        for s, slot in enumerate(langid.slots(data)):
            plain[i] += weights[slot[: len(data) - 2]].sum(0, dtype=np.float64)
    assert np.allclose(plain, whole, atol=1e-3)


def test_svm_reaches_the_plain_optimum(monkeypatch):
    random.seed(2)
    monkeypatch.setattr(langid, "PASSES", 2000)
    rows = [np.sort(np.array(random.sample(range(12), 5))) for _ in range(30)]
    values = [np.array([random.random() for _ in r], np.float32) for r in rows]
    signs = np.array([1.0 if 3 in r else -1.0 for r in rows])
    data = langid.Rows(rows, values, np.ones(langid.DIMENSIONS))
    w, bias = data.svm(np.arange(30), signs)
    x = np.zeros((30, 13))
    for i, (r, v) in enumerate(zip(rows, data.values)):
        x[i, r], x[i, 12] = v, 1

    def loss(u):
        return u @ u / 2 + langid.COST * (np.maximum(0, 1 - signs * (x @ u)) ** 2).sum()

    u = np.append(w[:12] / data.scale[:12], bias)
    best = loss(u)
    for _ in range(300):
        assert loss(u + np.random.default_rng(_).normal(size=13) * 0.01) >= best - 1e-3


def test_families_follow_the_nearest_means():
    means = np.array([[1, 0, 0.1], [0, 1, 0], [0.9, 0, 0.2], [0, 0.8, 0.1]])
    assert langid.families_of(means) == [[0, 2], [1, 3]] and langid.families_of(means[:1]) == [[0]]
    assert [len(langid.families_of(np.eye(n))) for n in (2, 3, 5, 9)] == [2, 2, 3, 3]


# --- ranked search
def search(spark, docs, items, k=20):
    frame = lambda rows, c: spark.createDataFrame(rows, f"{c} long, text string").repartition(3)
    return sorted(map(tuple, lexical.rank(clashing(frame(docs, "doc_id")), clashing(frame(items, "item_id")), k).collect()), key=repr)


@pytest.mark.parametrize(("shard", "step", "block"), [(1 << 20, 16, 1 << 20), (200, 1, 400), (3000, 2, 1 << 20)])
def test_search_equals_brute_force(spark, monkeypatch, shard, step, block):
    for name, value in (("SHARD", shard), ("STEP", step), ("QUERY_BYTES", block)):
        monkeypatch.setattr(lexical, name, value)
    random.seed(shard)
    common, rare = [f"w{i}" for i in range(40)], [f"\u00e9{i}" for i in range(400)]
    say = lambda n: " ".join(random.choice(common if random.random() < 0.7 else rare).upper() if random.random() < 0.1 else random.choice(common if random.random() < 0.6 else rare) for _ in range(n))
    docs = [(i, say(random.randrange(0, 90))) for i in range(400)] + [(1000 + i, "w1 w2 w3") for i in range(60)] + [(i, f"W1_w2-w{i % 5}") for i in range(5)] * 2
    docs += [(7, None), (8, ""), (None, "w1 w2 \u00e93"), (9, "..."), (10, "w1 " * 30_000), (-1, "\u00e9" * 50_000)]
    items = [(i, say(random.randrange(1, 30))) for i in range(25)] + [(100, "w1 w1 w2"), (100, "w1 w1 w2"), (100, "w3"), (None, "w2 \u00e93"), (101, ""), (102, None), (103, "nowhere at all"), (104, "w1\x00w2")]
    for k in (20, 3):
        assert search(spark, docs, items, k) == brute.search(docs, items, k)


def test_search_of_empty_tables(spark):
    assert search(spark, [], [(1, "a")]) == [] and search(spark, [(1, "a"), (2, "b")], []) == [] and search(spark, [(1, None)], [(1, "a")]) == []


def test_best_positions_stop_early(monkeypatch):
    import pyarrow as pa

    # one list falls off at once: the search must not read it to its end
    n = 5000
    tf = np.where(np.arange(n) < 25, 50, 1).astype(np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.full(n, 100)), pa.array([[0]] * n, pa.list_(pa.int32())), pa.array([[int(t)] for t in tf], pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tfs"])
    shard = lexical.Shard([batch], np.array([700]), n, 100 * n)
    read, ragged = [], shared.ragged
    monkeypatch.setattr(shared, "ragged", lambda s, c: read.append(int(np.sum(c))) or ragged(s, c))
    none = np.zeros(0, np.int64)
    scores, ids = shard.search(np.array([0]), np.array([2]), (none, none), 20)
    assert ids.tolist() == list(range(20)) and len(set(scores.tolist())) == 1 and sum(read) < 400


# --- Merkle manifest
def manifest_rows(docs):
    return sorted(map(tuple, manifest.manifest(clashing(docs)).collect()), key=repr)


@pytest.mark.parametrize(("fanout", "digits"), [(2, 9), (2, 2), (3, 1)])
def test_manifest_equals_brute_force(spark, monkeypatch, fanout, digits):
    monkeypatch.setattr(manifest, "FANOUT", fanout)
    monkeypatch.setattr(manifest, "DIGITS", digits)
    monkeypatch.setattr(manifest, "LANG_DIGITS", 1)
    base = [tuple(r) for r in shared.table(spark, SF, "documents").select("doc_id", "source", "lang", "n_chars", "text").limit(60).collect()]
    odd = [(None, "s", "en", 3, "x"), (None, None, None, None, None), (-7, "s", None, None, "\u00e9" * 9), (14, "", "", 0, ""), (14, "", "", 0, ""), (14, "", "", 1, ""), (5, "s", "z\u00e9", 5, "a:1"), (1 << 40, "s", "zz", None, "x" * 300_000)]
    docs = spark.createDataFrame(base + odd, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    got = manifest_rows(docs)
    assert got == sorted(brute.manifest(base + odd, fanout), key=repr)
    assert {r[-1] for r in got} == {True, False}
    if digits < 9:
        return
    assert manifest_rows(docs.limit(0)) == []
    one = manifest_rows(docs.where("lang = 'zz'"))
    assert one[0][1] == one[0][2] == one[0][3] and one[0][4] == hashlib.sha256(b"").hexdigest()
