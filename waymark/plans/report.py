"""The trajectory report: a tree of runs to one line each, sorted by step, with a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncated
from ..operators.metrics import kind_name, listed_kinds, map_total


def message_kinds(trajectories: DataFrame) -> DataFrame:
    """kind: the distinct kinds of all messages."""
    return trajectories.select(F.explode("messages").alias("m")).select(kind_name(F.col("m.kind")).alias("kind")).distinct()


def report(trajectories: DataFrame, kinds: list[str] | None = None, message_col: str = "final_message") -> DataFrame:
    """id, step, phase, num_messages, total_reward, count_<kind> in order of name, final_message; sorted by step and id.

    The kinds are those of the messages unless given; a message without one is `Unknown`. total_reward is the sum of all parts.
    """
    kinds = listed_kinds(message_kinds(trajectories)) if kinds is None else sorted(kinds)
    messages = F.coalesce("messages", F.array())
    of = lambda kind: F.size(F.filter(messages, lambda m: kind_name(m["kind"]) == kind))
    return trajectories.select(
        "id",
        "step",
        "phase",
        F.size(messages).cast("long").alias("num_messages"),
        map_total(F.col("reward_dict")).alias("total_reward"),
        *[of(k).cast("long").alias(f"count_{k}") for k in kinds],
        truncated(F.coalesce(F.col(message_col), F.lit(""))).alias("final_message"),
    ).orderBy("step", "id")


def summary(rows: DataFrame) -> DataFrame:
    """One row: trajectories, first and last step, sum per kind, mean reward to four places."""
    counts = [c for c in rows.columns if c.startswith("count_")]
    return rows.agg(
        F.count("*").alias("n_trajectories"),
        F.min("step").alias("min_step"),
        F.max("step").alias("max_step"),
        *[F.sum(f"`{c}`").alias(f"sum_{c[6:]}") for c in counts],
        F.round(F.avg("total_reward"), 4).alias("mean_reward"),
    )


def head(rows: DataFrame, n: int = 10) -> DataFrame:
    return rows.orderBy("step", "id").limit(n)
