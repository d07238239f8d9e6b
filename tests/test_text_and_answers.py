import time

from pyspark.sql import functions as F

from waymark import fixtures
from waymark.functions import answer, diff, text
from waymark.operators import scoring
from waymark.plans import catalog


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return rows.select(column.alias("x")).first().x


def test_paths_and_cuts(spark):
    assert one(spark, text.normalize_path(F.col("p")), p="\t ./src/a.py\n") == "src/a.py"
    assert one(spark, text.normalize_path(F.col("p")), p="././a") == "./a"
    assert one(spark, text.truncated(F.col("p")), p="x" * 500) == "x" * 500
    assert one(spark, text.truncated(F.col("p")), p="x" * 501) == "x" * 500 + "..."
    assert one(spark, text.checkout_name(F.col("r"), F.col("i")), r="a/b", i="i-1") == "a_b_i-1"


def test_fences(spark):
    assert one(spark, text.fenced_or_whole(F.col("p")), p="a ```x\ny``` b ```z```") == "x\ny"
    assert one(spark, text.fenced_or_whole(F.col("p")), p="a `````` b") == ""
    assert one(spark, text.fenced_or_whole(F.col("p")), p="no fence") == "no fence"


def test_reasoning(spark):
    got = one(spark, text.reasoning_and_content(F.col("p")), p="pre <think>\n\nwhy\n\n</think>\n\nthe </think>\nend")
    assert tuple(got) == ("why", "end")
    assert tuple(one(spark, text.reasoning_and_content(F.col("p")), p="plain")) == (None, "plain")


def test_tool_arguments(spark):
    ok = one(spark, text.tool_arguments(F.col("p")), p='{"a": "b"}')
    assert ok.arguments == {"a": "b"} and ok.error is None
    twice = one(spark, text.tool_arguments(F.col("p")), p='"{\\"a\\": \\"b\\"}"')
    assert twice.arguments == {"a": "b"}
    for bad in ("[1]", "{broken", "text", '"just text"'):
        assert one(spark, text.tool_arguments(F.col("p")), p=bad).error.startswith("Error: Invalid tool arguments"), bad


def test_steps_hits_and_templates(spark):
    assert one(spark, text.step_number(F.col("p")), p="step_12") == 12
    assert one(spark, text.step_number(F.col("p")), p="step_x") == 0
    assert one(spark, text.hit_file(F.col("p")), p="a/b.py:12:x: y") == "a/b.py"
    assert one(spark, text.rendered("in {{ w }}: {{ i }}", w=F.col("w"), i=F.col("i")), w="/w", i="fix") == "in /w: fix"


PATCH = """diff --git a/a.py b/a.py
--- a/a.py
+++ b/a.py
@@ -1,3 +1,4 @@ def f():
+x
@@ -10 +11,2 @@
-y
diff --git a/gone.py b/gone.py
--- a/gone.py
+++ /dev/null
@@ -5,0 +0,0 @@
-z
diff --git a/b.bin b/b.bin
Binary files differ
"""


def test_old_side_targets_keep_the_file_before_a_deleted_one(spark):
    rows = diff.old_side_targets(spark.createDataFrame([("i", PATCH), ("none", "no diff"), ("first", PATCH[PATCH.index("diff --git a/gone") :])], "instance_id string, patch string"))
    assert sorted((r.instance_id, r.file, r.old_start, r.old_count) for r in rows.collect()) == [("i", "a.py", 1, 3), ("i", "a.py", 5, 0), ("i", "a.py", 10, 1)]
    column = {r.instance_id: r.target for r in diff.targets_column(spark.createDataFrame([("i", PATCH), ("none", "")], "instance_id string, patch string")).collect()}
    assert [(t.file, t.old_start) for t in column["i"]] == [("a.py", 1), ("a.py", 10), ("a.py", 5)] and column["none"] == []


def test_rows_of_one_id_stay_apart(spark):
    other = PATCH.replace("a.py", "z.py").replace("@@ -1,3", "@@ -7,3")
    rows = spark.createDataFrame([("i", PATCH), ("i", other), ("i", None), ("i", PATCH + PATCH)], "instance_id string, patch string")
    got = [[(t.file, t.old_start) for t in r.target] for r in diff.targets_column(rows).collect()]
    assert got == [[("a.py", 1), ("a.py", 10), ("a.py", 5)], [("z.py", 7), ("z.py", 10), ("z.py", 5)], [], [("a.py", 1), ("a.py", 10), ("a.py", 5)] * 2]
    assert sorted(r.file for r in diff.file_extents(rows).collect()) == ["a.py", "a.py", "gone.py", "gone.py", "gone.py", "z.py"]
    mixed = "+++ b/x\n@@ -1 +1 @@\n+++ b/y\n@@ -2 +2 @@\n+++ b/x\n@@ -3 +3 @@"
    target = diff.targets_column(spark.createDataFrame([("m", mixed)], "instance_id string, patch string")).first().target
    assert [(t.file, t.old_start) for t in target] == [("x", 1), ("x", 3), ("y", 2)]
    answers = spark.createDataFrame([(1, "a.py\nfunction: f"), (1, "b.py\nclass: C"), (1, "function: g")], "traj_id long, answer string")
    assert [(r.file, r.function) for r in answer.locations(answers).collect()] == [("a.py", "f")]
    assert [r.entities for r in answer.answer_sets(answers).collect()] == [["a.py:f"], [], []]


def test_file_hunks_and_extents(spark):
    hunks = diff.file_hunks(spark.createDataFrame([("i", PATCH)], "instance_id string, patch string"))
    assert sorted((r.file, r.old_start, r.old_count, r.new_start, r.new_count) for r in hunks.collect()) == [("a.py", 1, 3, 1, 4), ("a.py", 10, 1, 11, 2), ("gone.py", 5, 0, 0, 0)]
    extents = {r.file: r for r in diff.file_extents(spark.createDataFrame([("i", PATCH)], "instance_id string, patch string")).collect()}
    assert (extents["a.py"].old_start, extents["a.py"].old_count, extents["a.py"].new_start, extents["a.py"].new_count) == (1, 10, 1, 12)


ANSWER = """```
a.py
class: C
function: f
function: D.g.h (note)
method: run()

function: free
class: x.py
function: last
b.py
function: C.__init__
c.py
```"""


def test_answer_locations(spark):
    rows = answer.locations(spark.createDataFrame([(1, ANSWER), (2, "function: early"), (3, None)], "traj_id long, answer string")).orderBy("pos").collect()
    assert [(r.file, r["class"], r.function) for r in rows] == [
        ("a.py", "C", "f"),
        ("a.py", "D", "g.h"),
        ("a.py", "C", "run"),
        ("a.py", None, "free"),
        ("class: x.py", None, "last"),
        ("b.py", "C", "__init__"),
    ]


def test_answer_sets(spark):
    got = {r.traj_id: r for r in answer.answer_sets(spark.createDataFrame([(1, "b.py\nfunction: C.__init__\nfunction: f"), (2, "nothing")], "traj_id long, answer string")).collect()}
    assert got[1].files == ["b.py"] and got[1].entities == ["b.py:C", "b.py:f"] and got[1].modules == ["b.py:C", "b.py:f"]
    assert got[2].files == []


def test_bad_function_line_is_marked(spark):
    rows = answer.locations(spark.createDataFrame([(1, "a.py\nfunction:\nfunction: f")], "traj_id long, answer string")).orderBy("pos").collect()
    assert [r.bad for r in rows] == [True, False]


def test_tables_of_lines_give_what_texts_give(spark):
    odd = "+++ b/x\n@@ -1 +1 @@\r\n+++ b/\n@@ -2 +2 @@\n+++ b/y\n@@ -3,4 +3 @@ @@ -9 +9 @@\n x @@ -5 +5 @@\r@@ -6 +6 @@"
    patches = spark.createDataFrame([("i", PATCH), ("j", PATCH + PATCH.replace("a.py", "z.py")), ("k", odd), ("n", None)], "instance_id string, patch string")
    whole = sorted(tuple(r)[:2] + tuple(r)[3:] for r in diff.old_side_targets(patches).collect())
    for size in (1, 3, 1 << 16):
        assert sorted((r.instance_id, r.file, r.old_start, r.old_count) for r in diff.targets_of_lines(diff.patch_lines(patches), size).collect()) == whole
    answers = spark.createDataFrame([(1, ANSWER), (2, "function: early"), (3, None), (4, "class: C\na.py\nfunction: f\nclass: D\nx\nmethod: D.\nb.py c\n \nfunction:"), (5, ANSWER + ANSWER)], "traj_id long, answer string")
    whole = sorted((tuple(r)[0], *map(str, tuple(r)[2:])) for r in answer.locations(answers).collect())
    for size in (1, 3, 1 << 16):
        assert sorted((tuple(r)[0], *map(str, tuple(r)[2:])) for r in answer.locations_of_lines(answer.answer_lines(answers), size).collect()) == whole


def test_parsed_patches_as_a_column(spark):
    twice = PATCH + "diff --git a/c.py b/c.py\n@@ -4 +4 @@\n" + PATCH.replace("@@ -1,3 +1,4 @@", "@@ -2,3 +2,7 @@").replace("@@ -10 +11,2 @@", "@@ -20,5 +30 @@")
    got = diff.with_patch_info(spark.createDataFrame([("i", twice), ("n", None)], "instance_id string, patch string")).withColumn("paths", F.map_keys("patch_info")).orderBy("instance_id").collect()
    assert got[0].paths == ["a.py", "gone.py", "c.py"] and got[1].patch_info == {}
    a = got[0].patch_info["a.py"]
    assert (a.old_start, a.old_count, a.new_start, a.new_count, len(a.hunks)) == (2, 23, 2, 29, 2)


def test_rows_of_a_hundred_thousand_entries(spark):
    n = 100_000
    began = time.time()
    rows = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("f"), (i % 50_000).cast("string"), F.lit(".py\nfunction: g"), i.cast("string"))), "\n").alias("answer"), F.lit(1).alias("traj_id"))
    assert answer.locations(rows).count() == n
    sets = answer.answer_sets(rows).first()
    assert len(sets.files) == 50_000 and len(sets.entities) == n
    path = lambda i: F.concat(F.lit("m"), (i % 60_000).cast("string"), F.lit(".py"))
    part = lambda i: F.concat(F.lit("diff --git a/"), path(i), F.lit(" b/"), path(i), F.lit("\n+++ b/"), path(i), F.lit("\n@@ -"), i.cast("string"), F.lit(" +1 @@\n"))
    patch = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), part), "").alias("patch"), F.lit("i").alias("instance_id"))
    target = diff.targets_column(patch).first().target
    assert len(target) == n and [t.old_start for t in target[:3]] == [1, 60_001, 2]
    files = diff.file_hunks(patch).where("file_pos < 2").orderBy("file_pos").collect()
    assert [(r.file, r.old_start) for r in files] == [("m1.py", 60_001), ("m2.py", 60_002)]
    assert time.time() - began < 120


def test_tagged_files(spark):
    cases = {"<files>\n ./a.py \n\nb.py</files>": ["a.py", "b.py"], '<files>["./a.py"]</files>': ["a.py"], "<files>[broken</files>": [], "<files></files>": [], "none": None}
    for reply, expected in cases.items():
        assert one(spark, answer.tagged_files(F.col("p")), p=reply) == expected, reply


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_patches_and_answers_are_dealt_once(spark):
    for rows in (fixtures.patches(spark, "/root/testdata/sf0.001"), fixtures.answers(spark, "/root/testdata/sf0.001")):
        assert plan_of(rows).count("Exchange hashpartitioning") == 1


def test_an_evaluation_row_is_read_back_once(spark):
    assert plan_of(catalog.QUERIES["p3_evaluation_row"](spark, "/root/testdata/sf0.001")).count("from_json(") == 1


def test_what_is_used_often_is_worked_out_once(spark):
    rows = spark.createDataFrame([("+++ b/a.py\n@@ -1,2 +3 @@", ["a", None])], "text string, items array<string>")
    assert plan_of(rows.select(diff.parsed_files(F.col("text")))).count("regexp_extract(") <= 2  # the path; hunks are cut into words
    assert plan_of(rows.select(scoring.set_f1(F.col("items"), F.col("items")))).count("array_distinct(") <= 4
    assert plan_of(rows.select(answer.location_list(F.col("text")))).count("regexp_extract(") <= 2  # the name


def test_marks_of_one_text_are_not_taken_for_another(spark):
    text = "Fake\nMock\nC\n- x\n a.py\nCat\nfunction: f\n\tclass: - K \nMethod\nmethod: M() B\nB\n\nfunction: C.F.g\nlast \x0b.py\nmethod: \u3000h i\nfunction:"
    rows = spark.createDataFrame([(1, text)], "traj_id long, answer string")
    expected = [("a.py", None, "f", False), ("a.py", "- K", "M", False), ("a.py", "C", "F.g", False), ("last \x0b.py", None, "h", False), ("last \x0b.py", None, "", True)]
    assert [tuple(x) for x in rows.select(answer.location_list(F.col("answer")).alias("l")).first().l] == expected
    assert [tuple(x)[2:] for x in answer.locations(rows).orderBy("pos").collect()] == expected
