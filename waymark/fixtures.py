"""Inputs in this package's schemas, derived from the star-schema tables by integer formulas (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.order import parts_of
from .schemas import TOOL_CALL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVENT_ROW: a trajectory per user; views and clicks are token events, purchases and errors actions."""
    order = Window.partitionBy("user_id").orderBy("ts")
    e = table(spark, sf_dir, "events")
    token = F.col("event_type").isin("view", "click")
    rid = F.sum(token.cast("int")).over(order)
    ids = lambda n: F.when(token, F.array_repeat((F.col("event_id") % 50000).cast("int"), (F.col("event_id") % n).cast("int")))
    return e.select(
        F.col("user_id").alias("traj_id"),
        F.row_number().over(order).cast("long").alias("pos"),
        F.when(token, "TokenEvent").when(F.col("event_type").isin("purchase", "error"), "ActionEvent").otherwise("MessageEvent").alias("kind"),
        F.when(rid > 0, rid.cast("string")).alias("llm_response_id"),
        F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("content"),
        ids(97).alias("prompt_token_ids"),
        ids(31).alias("response_token_ids"),
        F.lit(None).cast(f"array<{TOOL_CALL}>").alias("tool_calls"),
        "ts",
        "value",
    )


def mixed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """traj_id, pos, kind: the log with a kind for each event type, and none for every eleventh event."""
    order = Window.partitionBy("user_id").orderBy("ts")
    names = {"view": "TokenEvent", "click": "ObservationEvent", "purchase": "ActionEvent", "error": "SystemPromptEvent", "signup": "MessageEvent"}
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("event_type"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("traj_id"), F.row_number().over(order).cast("long").alias("pos"), F.when(F.col("event_id") % 11 != 0, kind).alias("kind"))


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages: assistant turns have (7 conv + 3 turn) % 4 calls with names of three."""
    n = ((F.col("conv_id") * 7 + F.col("turn") * 3) % 4).cast("int")
    call = lambda i: F.struct(
        i.cast("string").alias("id"), F.struct(F.concat(F.lit("tool"), ((F.col("conv_id") + i) % 3).cast("string")).alias("name"), F.lit("{}").alias("arguments")).alias("function")
    )
    calls = F.when((F.col("role") == "assistant") & (n > 0), F.transform(F.sequence(F.lit(1), n), call))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("traj_id"),
        F.col("turn").alias("pos"),
        F.when(F.col("role") == "assistant", "TokenEvent").otherwise("MessageEvent").alias("kind"),
        F.lit(None).cast("string").alias("llm_response_id"),
        "role",
        F.col("text").alias("content"),
        F.array_repeat(F.lit(1), (F.col("turn") % 5).cast("int")).alias("prompt_token_ids"),
        F.array_repeat(F.lit(2), (F.col("turn") % 3).cast("int")).alias("response_token_ids"),
        calls.cast(f"array<{TOOL_CALL}>").alias("tool_calls"),
    )


def item_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long predictions and gold, a row per line of an order: key (order), item (part), predicted, gold."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("item"), (F.col("l_returnflag") == "R").alias("predicted"), (F.col("l_linestatus") == "F").alias("gold"))


def items(spark: SparkSession, sf_dir: str, by: tuple[str, ...] = ("key", "item")) -> DataFrame:
    """The same with each item of a key once; dealt once, by what is to meet in a task."""
    flag = lambda c: F.max(F.col(c).cast("int")) == 1
    rows = item_rows(spark, sf_dir)
    return rows.repartition(parts_of(rows), *by).groupBy("key", "item").agg(flag("predicted").alias("predicted"), flag("gold").alias("gold"))


def item_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as arrays of paths: key, predicted, gold."""
    path = F.concat(F.lit("src/m"), F.col("item").cast("string"), F.lit(".py"))
    return items(spark, sf_dir, ("key",)).groupBy("key").agg(F.collect_set(F.when(F.col("predicted"), path)).alias("predicted"), F.collect_set(F.when(F.col("gold"), path)).alias("gold"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p"), "l_quantity")
    # dealt once, by what an answer or a patch is made of
    return rows.repartition(parts_of(rows), "l_orderkey").groupBy("l_orderkey", "p").agg(F.min("l_quantity").cast("int").alias("q"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """traj_id, answer: a block per part of an order, in the forms that answers take, fenced."""
    s = lambda c: c.cast("string")
    p = F.col("p")
    body = (
        F.when(p % 3 == 0, F.concat(F.lit("class: C"), s(p % 5), F.lit("\nfunction: f"), s(p % 11)))
        .when(p % 3 == 1, F.concat(F.lit("function: C"), s(p % 5), F.lit(".__init__()")))
        .otherwise(F.concat(F.lit("method: g"), s(p % 7), F.lit("() note")))
    )
    block = F.concat(F.lit("src/m"), s(p % 97), F.lit(".py\n"), body)
    blocks = _pairs(spark, sf_dir).groupBy(F.col("l_orderkey").alias("traj_id")).agg(F.array_sort(F.collect_list(F.struct("p", block.alias("b")))).alias("bs"))
    return blocks.select("traj_id", F.concat(F.lit("```\n"), F.array_join(F.transform("bs", lambda b: b["b"]), "\n\n"), F.lit("\n```")).alias("answer"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instance_id, patch: a diff with a file per part; every 13th part's file is deleted, so its hunk counts for the file before."""
    s = lambda c: c.cast("string")
    p, q = F.col("p"), F.col("q")
    path = F.concat(F.lit("src/m"), s(p), F.lit(".py"))
    count = F.when(q == 1, F.lit("")).otherwise(F.concat(F.lit(","), s(q)))
    new = F.when(p % 13 == 0, F.lit("+++ /dev/null")).otherwise(F.concat(F.lit("+++ b/"), path))
    text = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path, F.lit("\n"), new, F.lit("\n@@ -"), s(p + 1), count, F.lit(" +"), s(p + 2), count, F.lit(" @@\n-old\n+new"))
    files = _pairs(spark, sf_dir).groupBy(F.col("l_orderkey").alias("instance_id")).agg(F.array_sort(F.collect_list(F.struct("p", text.alias("t")))).alias("ts"))
    return files.select("instance_id", F.concat(F.array_join(F.transform("ts", lambda t: t["t"]), "\n"), F.lit("\n")).alias("patch"))


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instance_id, repo, base_commit, problem_statement from documents."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("instance_id"),
        F.concat(F.col("lang"), F.lit("/"), F.col("source")).alias("repo"),
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("base_commit"),
        F.col("text").alias("problem_statement"),
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, word, reply: conversations' words inside tags, fences and thoughts, by turn number."""
    word = F.concat(F.lit("src/w"), F.col("conv_id").cast("string"), F.lit(".py"))
    kind = (F.col("conv_id") + F.col("turn")) % 6
    reply = (
        F.when(kind == 0, F.concat(F.lit("see <files>\n ./"), word, F.lit(" \n\nb.py\n</files> done")))
        .when(kind == 1, F.concat(F.lit('<files>["./'), word, F.lit('", "b.py"]</files>')))
        .when(kind == 2, F.concat(F.lit("<files>[broken</files> "), word))
        .when(kind == 3, F.concat(F.lit("<think>\nwhy "), word, F.lit("\n</think>\n\n"), word))
        .when(kind == 4, F.concat(F.lit("x ```"), word, F.lit("``` y")))
        .otherwise(word)
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", kind.alias("form"), word.alias("word"), reply.alias("reply"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group_id"), F.lit(50).alias("now_step"), (F.col("o_orderkey") % 50).alias("scheduled_step"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("pos"))
