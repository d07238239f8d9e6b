"""Training batches: a row per step of a trajectory, last-step flags, masks, batch means and staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .metrics import is_kind
from .order import placed

#: Token of the row that stands for a trajectory without a step (a fixed value of the tokenizer in use).
SENTINEL = 151643
IDS = "array<int>"


def rollout_steps(events: DataFrame, trajectories: DataFrame) -> DataFrame:
    """A row per token event with the trajectory's reward, or one sentinel row; trajectories: traj_id, reward.

    traj_id, step_id, prompt_token_ids, response_ids, reward, stop_reason, loss_mask, is_last_step.
    """
    order = Window.partitionBy("traj_id").orderBy("pos")
    own = events.where(is_kind("TokenEvent")).select(F.col("traj_id").alias("_id"), "pos", "prompt_token_ids", "response_token_ids")
    joined = trajectories.select("traj_id", "reward").join(own, F.col("traj_id") == F.col("_id"), "left")
    found = F.col("_id").isNotNull()
    sentinel = F.array(F.lit(SENTINEL)).cast(IDS)
    response = F.when(found, F.coalesce("response_token_ids", F.array().cast(IDS))).otherwise(sentinel)
    return joined.select(
        "traj_id",
        (F.row_number().over(order) - 1).cast("long").alias("step_id"),
        F.when(found, F.coalesce("prompt_token_ids", F.array().cast(IDS))).otherwise(sentinel).alias("prompt_token_ids"),
        response.alias("response_ids"),
        "reward",
        F.when(found, "complete").otherwise("error").alias("stop_reason"),
        F.transform(response, lambda _: F.lit(1)).alias("loss_mask"),
        (F.row_number().over(order) == F.count("*").over(Window.partitionBy("traj_id"))).alias("is_last_step"),
    )


def turn_masks(events: DataFrame) -> DataFrame:
    """traj_id, loss_mask: per step zeros for what the prompt adds to all before, ones for the response."""
    order = Window.partitionBy("traj_id").orderBy("pos")
    prompt, response = (F.coalesce(F.size(c), F.lit(0)) for c in ("prompt_token_ids", "response_token_ids"))
    sizes = events.where(is_kind("TokenEvent")).select("traj_id", "pos", prompt.alias("p"), response.alias("r"))
    steps = sizes.withColumn("before", F.lag(F.col("p") + F.col("r")).over(order))
    seen = F.when(F.col("before").isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), F.col("p") - F.col("before")))
    piece = F.concat(F.array_repeat(F.lit(0), seen), F.array_repeat(F.lit(1), F.col("r")))
    pieces = steps.select("traj_id", F.struct("pos", piece.alias("mask")).alias("s"))
    return pieces.groupBy("traj_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["mask"])).alias("loss_mask"))


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns of numbers; truth values count as numbers."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def batch_means(rewards: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: the mean of each numeric column over the rows that have it, as reward/<name> and metrics/<name>."""
    one = lambda df, prefix: df.agg(*[F.avg(F.col(c).cast("double")).alias(f"{prefix}/{c}") for c in numeric_columns(df) if c != "traj_id"])
    return one(rewards, "reward").crossJoin(one(metrics, "metrics"))  # one row each


def group_means(groups: DataFrame, first_group) -> DataFrame:
    """key, mean: unweighted means of scalar keys over groups (group_id, key, value); keys are the first group's, and only those all groups have."""
    n = groups.agg(F.count_distinct("group_id").alias("n"))
    means = groups.groupBy("key").agg(F.avg("value").alias("mean"), F.count("value").alias("have"), F.max((F.col("group_id") == first_group).cast("int")).alias("in_first"))
    return means.join(F.broadcast(n), F.col("have") == F.col("n")).where("in_first = 1").select("key", "mean")  # n is one row


def staleness(groups: DataFrame, limit: int) -> DataFrame:
    """One row of statistics on now_step - scheduled_step."""
    late = F.col("now_step") - F.col("scheduled_step")
    return groups.agg(
        F.avg(late).alias("mean"),
        F.max(late).alias("max"),
        F.min(late).alias("min"),
        (F.count_if(late > 0) / F.count("*")).alias("stale_share"),
        F.count_if(late > limit).alias("n_over_limit"),
    )


def all_or_none(df: DataFrame, column: str) -> DataFrame:
    """One row `ok`: the column is null everywhere or nowhere; an error otherwise."""
    present = F.count(column).isin(F.lit(0)) | (F.count(column) == F.count("*"))
    return df.agg(present.alias("ok")).select(F.coalesce(F.assert_true("ok", F.lit(f"{column} is null in some rows only")).cast("boolean"), F.lit(True)).alias("ok"))


def concatenated(steps: DataFrame, column: str) -> DataFrame:
    """All groups' lists as one, groups in order: group_id, values per group in order of pos, flattened in the last step."""
    return steps.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", column))), lambda s: s[column]).alias("values"))


def in_batch_order(steps: DataFrame, *order: Column | str) -> DataFrame:
    """steps with `place`: where each stands once all groups are concatenated (groups and their steps in `order`), from 0."""
    return placed(steps, *order, name="place")


def batches(steps: DataFrame, columns: list[str], size: int, *order: Column | str) -> DataFrame:
    """batch, first, n and a list for each column: all groups concatenated in order and cut into batches of `size` steps, as parallel lists.

    A row holds `size` steps at most, and no group is gathered whole; an id that a trajectory's steps share is repeated.
    """
    rows = in_batch_order(steps, *order).select(F.floor(F.col("place") / size).alias("batch"), F.struct("place", *columns).alias("s"))
    lists = rows.groupBy("batch").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return lists.select("batch", F.get("s", F.lit(0))["place"].alias("first"), F.size("s").alias("n"), *[F.col("s")[c].alias(c) for c in columns])


def fanned_out(steps: DataFrame, value: str, is_last: str, *order: Column | str) -> DataFrame:
    """steps with `<value>_of_last`: the value of the last step of each one's trajectory.

    A trajectory is a run of steps, in `order`, that ends with a step flagged last: its number is how many flags came before. Flags
    are counted part by part, and last steps join the steps of their number. ValueError if the steps do not end with a flag.
    """
    flag = F.coalesce(F.col(is_last), F.lit(False))
    rows = placed(steps, *order, name="_place", count=flag.cast("long"), running="_trajectory")
    lasts = rows.where(flag).select("_trajectory", F.col(value).alias(f"{value}_of_last"))
    open_ = rows.agg(F.max_by(flag, "_place").alias("closed")).first()["closed"]
    if open_ is False:
        raise ValueError("the last step is not flagged as one")
    return rows.join(lasts, "_trajectory", "left").drop("_trajectory", "_place")


def first_call_carries_thought(calls: DataFrame) -> DataFrame:
    """calls (response_id, thought, calls array) to a row per call; only the first keeps the thought."""
    return calls.select("response_id", "thought", F.posexplode("calls").alias("i", "call")).select("response_id", "i", "call", F.when(F.col("i") == 0, F.col("thought")).alias("thought"))
