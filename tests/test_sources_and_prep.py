import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from waymark import fixtures, sources, streaming
from waymark.operators import metrics, order, prep, rollout
from waymark.plans import report


def tree(root):
    def put(path, text):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)

    doc = {"instance_id": "i", "target": "[]", "total_reward": 9.0, "reward_dict": {"a": 1.0, "b": 0.5}, "messages": [{"kind": "TokenEvent"}, {"kind": "TokenEvent"}, {"kind": None}]}
    put("step_2/train/a_0.json", json.dumps(doc, indent=2))
    put("step_10/eval/b_1.json", json.dumps(doc | {"final_message": "x" * 501}))
    put("step_x/eval/c_0.json", json.dumps(doc | {"reward_dict": {}}))
    put("step_2/train/bad.json", "{ not json")
    put("step_2/train/a_0.error", "boom")
    put("other/train/z.json", json.dumps(doc))


def test_trajectory_tree_to_report(spark, tmp_path):
    tree(tmp_path)
    rows = report.report(sources.read_trajectories(spark, str(tmp_path))).collect()
    assert [(r.step, r.phase, r.id) for r in rows] == [(0, "eval", "c_0"), (2, "train", "a_0"), (10, "eval", "b_1")]
    assert rows[1].count_TokenEvent == 2 and rows[1].total_reward == 1.5 and rows[0].total_reward == 0.0
    assert rows[2].final_message == "x" * 500 + "..." and rows[1].final_message == ""
    table = report.report(sources.read_trajectories(spark, str(tmp_path)))
    assert table.columns == ["id", "step", "phase", "num_messages", "total_reward", "count_TokenEvent", "count_Unknown", "final_message"]
    total = report.summary(table).first()
    assert (total.n_trajectories, total.min_step, total.max_step, total.mean_reward) == (3, 0, 10, 1.0)
    sources.write_report_csv(table, f"{tmp_path}/csv", "step", "id")
    back = spark.read.option("header", True).csv(f"{tmp_path}/csv")
    assert back.columns == table.columns and back.count() == 3 and len(list((tmp_path / "csv").glob("*.csv"))) == 1


def test_kinds_are_those_of_the_data(spark):
    log = spark.createDataFrame([(1, "TokenEvent"), (1, "PauseEvent"), (2, "ActionEvent"), (2, None), (2, "a.b"), (2, "SystemPromptEvent"), (3, "PauseEvent")], "traj_id long, kind string")
    wide = metrics.kind_pivot(log)
    assert wide.columns == ["traj_id"] + [f"count_{k}" for k in ("ActionEvent", "PauseEvent", "SystemPromptEvent", "TokenEvent", "Unknown", "a.b")]
    assert sum(sum(r[1:]) for r in wide.collect()) == log.count()
    assert metrics.kind_pivot(log, ["TokenEvent"]).columns == ["traj_id", "count_TokenEvent"]
    assert metrics.kind_pivot(log.limit(0)).columns == ["traj_id"]
    spark.conf.set("spark.sql.pivotMaxValues", "3")
    with pytest.raises(ValueError, match="more than 3 kinds"):
        metrics.kind_pivot(log)
    spark.conf.unset("spark.sql.pivotMaxValues")
    runs = spark.createDataFrame([(1, "train", "x", [("PauseEvent",), (None,), ("a.b",)], {"a": 1.0}, None), (2, "train", "y", None, None, "m")], "step int, phase string, id string, messages array<struct<kind:string>>, reward_dict map<string,double>, final_message string")
    table = report.report(runs)
    assert [tuple(r) for r in table.collect()] == [("x", 1, "train", 3, 1.0, 1, 1, 1, ""), ("y", 2, "train", 0, 0.0, 0, 0, 0, "m")]
    assert report.summary(table).first()["sum_a.b"] == 1


def test_rejected_documents_are_kept_and_counted(spark, tmp_path):
    tree(tmp_path)
    odd = tmp_path / "step_3" / "train"
    odd.mkdir(parents=True)
    (odd / "a b%2+c.json").write_text('{"messages": []}')
    (odd / "empty.json").write_text(" ")
    (odd / "list.json").write_text('[{"messages": []}]')
    (odd / "typed.json").write_text('{"messages": {"kind": 1}}')
    (odd / "extra.json").write_text('{"messages": [{"kind": "x", "more": 1}], "unknown": [1]}')
    seen = Observation("trajectories")
    read = sources.read_trajectories(spark, str(tmp_path), seen)
    assert sorted(r.id for r in read.collect()) == ["a b%2+c", "a_0", "b_1", "c_0", "extra"]
    assert seen.get == {"n_read": 9, "n_rejected": 4}
    refused = {r.path.rsplit("/", 1)[1]: r.reason for r in sources.rejects(sources.scan_trajectories(spark, str(tmp_path))).collect()}
    assert refused == {"bad.json": "not a JSON document", "empty.json": "empty file", "list.json": "not an object", "typed.json": "a field has an unexpected type"}


def test_files_of_no_bytes_are_rejected(spark, tmp_path):
    tree(tmp_path / "a,b")
    empty = tmp_path / "a,b" / "step_2" / "train" / "n o%2+.json"
    empty.touch()
    (empty.parent / "none.error").touch()
    (empty.parent / "lone").mkdir()
    only = tmp_path / "a,b" / "step_4" / "eval" / "x.json"
    only.parent.mkdir(parents=True)
    only.touch()
    for root in (f"{tmp_path}/a,b", [f"{tmp_path}/a,b/step_2/train", f"{tmp_path}/a,b/step_4/eval"]):
        seen = Observation("scan")
        scan = sources.scan_trajectories(spark, root, seen)
        refused = {(r.step, r.phase, r.id, r.path, r.reason) for r in scan.where("reason is not null").collect()}
        bad = (2, "train", "bad", f"file:{empty.parent}/bad.json", "not a JSON document")
        assert refused == {bad, (2, "train", "n o%2+", f"file:{empty}", "empty file"), (4, "eval", "x", f"file:{only}", "empty file")}
        assert seen.get["n_rejected"] == 3
    store = f"file://{tmp_path}/store"
    sources.convert_trajectories(spark, f"file://{tmp_path}/a,b", store)
    assert spark.read.parquet(f"{store}/_rejects").where("reason = 'empty file'").count() == 2


def test_empty_files_are_those_of_the_listing(spark, tmp_path):
    tree(tmp_path / "a,b")
    tree(tmp_path / "axb")  # a folder that a pattern for the other's name would match too
    for root in (f"{tmp_path}/a,b", [f"{tmp_path}/a,b/step_2/train"]):
        assert [r.path for r in sources.rejects(sources.scan_trajectories(spark, root)).collect()] == [f"file:{tmp_path}/a,b/step_2/train/bad.json"]
    (tmp_path / "a,b" / "step_2" / "train" / "\u3000 %.json").touch()
    assert [(r.id, r.reason) for r in sources.scan_trajectories(spark, f"file://{tmp_path}/a,b/").where("reason <> 'not a JSON document'").collect()] == [("\u3000 %", "empty file")]


def test_folders_are_listed_and_not_each_file(spark, tmp_path):
    tree(tmp_path)
    train = tmp_path / "step_2" / "train"
    for i in range(40):
        (train / f"n{i}.json").write_text("{}")
    for deep in ("k=v", "step_3/eval"):  # neither a column nor a run of this tree
        (train / deep).mkdir(parents=True)
        (train / deep / "z.json").write_text("{}")
        (train / deep / "empty.json").touch()
    (tmp_path / "step_2" / "high.json").write_text("{}")
    spark.sparkContext.setJobGroup("listing of a tree", "")
    scans = [sources.scan_trajectories(spark, root) for root in (str(tmp_path), [str(train)])]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("listing of a tree")) == []  # with a task for each file beyond 32 of them
    ids = [f"n{i}" for i in range(40)] + ["a_0", "bad"]
    assert [sorted(r.id for r in scan.select("id").collect()) for scan in scans] == [sorted([*ids, "b_1", "c_0"]), sorted(ids)]


def test_folders_are_converted_once_and_pruned(spark, tmp_path):
    tree(tmp_path / "runs")
    root, store = f"file://{tmp_path}/runs", f"file://{tmp_path}/store"
    first = sources.convert_trajectories(spark, root, store)
    assert [f.rsplit("/", 2)[1:] for f in first] == [["step_10", "eval"], ["step_2", "train"], ["step_x", "eval"]]
    for old in (tmp_path / "runs" / "step_2" / "train").glob("*"):  # what was taken is not read again
        old.unlink()
    late = tmp_path / "runs" / "step_2" / "eval"
    late.mkdir()
    (late / "d e.json").write_text('{"messages": [{"kind": "TokenEvent"}]}')
    assert [f.rsplit("/", 2)[1:] for f in sources.convert_trajectories(spark, root, store)] == [["step_2", "eval"]]
    assert sources.convert_trajectories(spark, root, store) == []
    got = sources.read_store(spark, store)
    assert sorted((r.step, r.phase, r.id) for r in got.collect()) == [(0, "eval", "c_0"), (2, "eval", "d e"), (2, "train", "a_0"), (10, "eval", "b_1")]
    assert spark.read.parquet(f"{store}/_rejects").count() == 1
    plan = got.where("step = 2 and phase = 'train'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(step" in plan


def test_csv_is_one_sorted_file_of_parallel_parts(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 7).alias("step"), F.concat(F.lit('a "b", '), F.col("id")).alias("id"), F.lit("x\ny").alias("c,d"))
    sources.write_report_csv(rows, f"file://{tmp_path}/out", "step", "id")
    rows.orderBy("step", "id").coalesce(1).write.option("header", True).csv(f"file://{tmp_path}/plain")
    assert [p.read_bytes() for p in (tmp_path / "out").glob("*.csv")] == [p.read_bytes() for p in (tmp_path / "plain").glob("*.csv")]
    sources.write_report_csv(rows.limit(0), f"file://{tmp_path}/none", "step", "id")
    assert [p.read_text() for p in (tmp_path / "none").glob("*.csv")] == ['step,id,"c,d"\n']


def test_search_counts_lines_over_splits(spark, tmp_path):
    text = "".join(f"line {i} {'needle' if i % 97 == 0 else ''}\n" for i in range(1, 5001))
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "sub dir" / "long+a.py").write_text(text)
    (tmp_path / "b.txt").write_text("needle\n")
    (tmp_path / "c.py").write_text("\nx\r\n\nneedle")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    found = sources.search_files(spark, str(tmp_path), "needle$", "*.py", 40)
    assert found.rdd.getNumPartitions() >= 1 and spark.read.text(str(tmp_path / "sub dir")).rdd.getNumPartitions() > 5
    got = [(r.path.rsplit("/", 1)[1], r.line) for r in found.collect()]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [("c.py", 4)] + [("long+a.py", 97 * i) for i in range(1, 40)]
    assert sources.search_files(spark, str(tmp_path), "needle").count() == 53


def test_places_sums_and_zips(spark):
    rows = spark.createDataFrame([(i, i % 3, "x") for i in range(100)] + [(None, 1, "y"), (5, 2, "x")], "k int, v int, s string").repartition(5)
    got = order.placed(rows, "k", count=F.col("v"), running="before").orderBy("_place").collect()
    assert [r._place for r in got] == list(range(102)) and [r.k for r in got] == [None, *sorted([*range(100), 5])]
    assert [r.before for r in got] == [sum(x.v for x in got[:i]) for i in range(102)]
    same = order.placed(spark.range(50).select(F.lit(1).alias("k")), "k")
    assert sorted(r._place for r in same.collect()) == list(range(50))
    assert order.placed(rows.limit(0), "k").collect() == []
    left, right = spark.range(40).repartition(3), spark.range(40).select((F.col("id") * 2).alias("twice"), F.col("id").alias("id")).repartition(2)
    both = order.zipped(left, right, ["id"], [-F.col("twice")])
    assert sorted((r.id, r.twice) for r in both.collect()) == [(i, 78 - 2 * i) for i in range(40)]
    with pytest.raises(ValueError, match="40 and 39"):
        order.zipped(left, right.limit(39), ["id"], ["id"])


def test_values_are_carried_over_ranges(spark):
    rows = spark.createDataFrame([(k, i, "r" if i in (3, 40) else "v" if i in (1, 7, 20) else None) for k in ("a", None) for i in range(60) if i != 5], "k string, pos int, m string").repartition(4)
    mark = {"held": F.when(F.col("m") == "v", F.struct(F.col("pos").alias("x"))).when(F.col("m") == "r", F.struct(F.lit(None).cast("int").alias("x")))}
    for size in (1, 4, 7, 1000):
        got = {(r.k, r.pos): r.held for r in order.carried(rows, "k", "pos", mark, size).collect()}
        for (_, i), held in got.items():
            expected = None if i < 1 else max(j for j in (1, 3, 7, 20, 40) if j <= i)
            assert (held is None) if expected is None else held.x == (None if expected in (3, 40) else expected)
        assert len(got) == 118


def test_parts_grow_with_the_rows(spark, monkeypatch):
    few = spark.range(100)
    assert order.parts_of(few) == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(order, "TASK_ROWS", 10)
    assert order.parts_of(few) == 10 and order.parts_of(few, 3) == 30
    items = fixtures.items(spark, "/root/testdata/sf0.001")
    assert "hashpartitioning(key#" in items._jdf.queryExecution().executedPlan().toString() and items.rdd.getNumPartitions() == 600
    lines = spark.createDataFrame([(k, p, p % 3 == 0) for k in (None, 0, 1) for p in range(20)], "k long, p int, m boolean")
    found = order.carried(lines, "k", "p", {"last": F.when(F.col("m"), F.col("p"))}, 4, parts=7)
    assert ", 7), REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(found.collect(), key=str) == sorted([(k, p, p % 3 == 0, p // 3 * 3) for k in (None, 0, 1) for p in range(20)], key=str)


def test_batches_and_fan_out(spark):
    steps = spark.createDataFrame([(g, i, f"t{g}", float(10 * g + i), i == g) for g in range(6) for i in range(g + 1)], "g int, i int, id string, adv double, last boolean").repartition(4)
    got = rollout.batches(steps, ["id", "adv"], 4, "g", "i").orderBy("batch").collect()
    assert [r.first for r in got] == [0, 4, 8, 12, 16, 20] and [r.n for r in got] == [4] * 5 + [1]
    flat = [x for r in got for x in r.id]
    assert flat == [f"t{g}" for g in range(6) for _ in range(g + 1)]
    fan = rollout.fanned_out(steps, "adv", "last", "g", "i")
    assert {(r.g, r.i): r.adv_of_last for r in fan.collect()} == {(g, i): 11.0 * g for g in range(6) for i in range(g + 1)}
    with pytest.raises(ValueError, match="not flagged"):
        rollout.fanned_out(steps.where("g < 5 or i < 5"), "adv", "last", "g", "i")


def test_tail_split_is_exact_under_ties(spark):
    rows = spark.createDataFrame([(i % 10, f"r{i % 25}", {"a": i % 2}) for i in range(50)], "k int, s string, m map<string,int>").repartition(3)
    for asked in (0, 1, 5, 7, 12, 50, 70):
        done = prep.tail_split(rows, [F.col("k")], asked)
        held = [r.k for r in done.where("split = 'validation'").collect()]
        assert sorted(held, reverse=True) == sorted([i % 10 for i in range(50)], reverse=True)[:asked] and done.count() == 50
    equal = prep.tail_split(spark.range(30).select(F.lit(1).alias("k")), [F.col("k")], 7)
    assert equal.where("split = 'validation'").count() == 7 and equal.count() == 30
    assert prep.tail_split(rows.limit(0), [F.col("k")], 7).count() == 0


def test_trajectories_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [("i/1".replace("/", "-"), 0, 3, "train", "[]", 1.0, {"a": 1.0}, None), ("j", 1, 3, "eval", "[]", 0.0, {}, "failed")],
        "instance_id string, repetition_id int, step int, phase string, target string, total_reward double, reward_dict map<string,double>, error string",
    )
    sources.write_trajectories(rows, str(tmp_path))
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.*") if p.is_file()) == ["step_3/eval/j_1.error", "step_3/train/i-1_0.json"]
    got = sources.read_trajectories(spark, str(tmp_path)).first()
    assert got.id == "i-1_0" and got.reward_dict == {"a": 1.0} and got.step == 3


def test_documents_are_laid_out_row_by_row(spark, tmp_path, monkeypatch):
    plans, write = [], sources.write_files
    monkeypatch.setattr(sources, "write_files", lambda df, *more: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, *more)))
    rows = spark.createDataFrame([("i", 0, 3, "train", {"\u00fc": 1.0}, None)], "instance_id string, repetition_id int, step int, phase string, reward_dict map<string,double>, error string")
    sources.write_trajectories(rows, str(tmp_path))
    assert not any("MapInPandas" in plan for plan in plans)  # no batch of rows in Python
    assert (tmp_path / "step_3" / "train" / "i_0.json").read_text() == '{\n  "instance_id": "i",\n  "reward_dict": {\n    "\u00fc": 1.0\n  }\n}'


def test_splits_round_trip(spark, tmp_path):
    rows = spark.range(250).withColumnRenamed("id", "instance_id")
    split = prep.tail_split(rows, [F.col("instance_id")])
    folder = sources.write_splits(split, str(tmp_path), "org/name", "test")
    assert folder.endswith("org__name_test")
    assert spark.read.parquet(f"{folder}/train.parquet").count() == 150
    assert [r.instance_id for r in spark.read.parquet(f"{folder}/validation.parquet").orderBy("instance_id").collect()] == list(range(150, 250))
    few = prep.tail_split(rows.limit(40), [F.col("instance_id")])
    assert few.where("split = 'train'").count() == 0


def test_ratio_split_is_exact_and_repeatable(spark):
    rows = spark.range(1003).withColumnRenamed("id", "i")
    a, b = (prep.ratio_split(rows.repartition(n), "i") for n in (2, 7))
    test = {r.i for r in a.where("split = 'test'").collect()}
    assert len(test) == 201 and test == {r.i for r in b.where("split = 'test'").collect()}
    assert prep.select_mode(a, b, "other") == (a, b)


def test_rows_by_id_and_ordinal(spark):
    rows = spark.range(10, 20).withColumnRenamed("id", "i")
    assert prep.by_ordinal(rows, [F.col("i")], 3).first().i == 13
    assert prep.by_id(rows, "i", 15).count() == 1
    with pytest.raises(IndexError):
        prep.by_ordinal(rows, [F.col("i")], 10)


def test_first_keys_keep_all_their_rows(spark):
    rows = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, "c"), (4, "a")], "i int, repo string")
    assert {r.i for r in prep.first_n_keys(rows, "repo", "i", 2).collect()} == {0, 1, 2, 4}


def test_search_and_listing(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.py").write_text("one\nTwo two\n")
    (tmp_path / "b.txt").write_text("two")
    texts = sources.read_texts(spark, f"{tmp_path}/*")
    assert [(r.line, r.text) for r in sources.search_lines(sources.read_texts(spark, f"{tmp_path}/d/*"), "[Tt]wo", "*.py").collect()] == [(2, "Two two")]
    assert sources.search_lines(texts, "^two", "*.py").count() == 0
    listed = sources.list_directory(spark, str(tmp_path)).first()
    assert listed.n_files == 2 and listed.n_python == 1 and len(listed.first) == 2
    hits = spark.createDataFrame([("a.py:1:x",), ("b.py:2:y",), ("a.py:3:z",)], "hit string")
    got = sources.hit_files(hits).first()
    assert got.files == ["a.py", "b.py"] and got.n_files == 2 and got.display == "a.py\nb.py"


def test_streaming_counts_equal_batch_counts(spark, tmp_path):
    rows = spark.createDataFrame([(1, "TokenEvent", "2024-01-01 00:10:00", [1], [1, 2]), (1, "TokenEvent", "2024-01-01 00:50:00", [1], None), (2, "ActionEvent", "2024-01-01 05:00:00", None, None)], "traj_id long, kind string, ts string, prompt_token_ids array<int>, response_token_ids array<int>").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = streaming.windowed_kinds(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    running = stream.writeStream.outputMode("complete").format("memory").queryName("kinds_seen").option("checkpointLocation", f"{tmp_path}/state").start()
    running.processAllAvailable()
    running.stop()
    seen = {tuple(r) for r in spark.table("kinds_seen").collect()}
    assert seen == {tuple(r) for r in streaming.windowed_kinds(rows).collect()} and len(seen) == 2
    assert {(r.prompt_tokens, r.response_tokens) for r in streaming.windowed_tokens(rows).collect()} == {(2, 2), (0, 0)}


def test_snapshot_of_events_in_memory(spark):
    rows = sources.snapshot(spark, [{"traj_id": 1, "pos": 1, "kind": "TokenEvent", "prompt_token_ids": [1]}, {"traj_id": 1, "pos": 2}])
    assert [(r.kind, r.prompt_token_ids, r.tool_calls) for r in rows.collect()] == [("TokenEvent", [1], None), (None, None, None)]
    assert sources.snapshot(spark, []).collect() == []
