"""Metrics of event logs: everything of a trajectory comes from one conditional aggregation on traj_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import UNKNOWN_KIND


def is_kind(kind: str) -> Column:
    return F.coalesce(F.col("kind") == kind, F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def size_of(column: str) -> Column:
    return F.coalesce(F.size(column), F.lit(0)).cast("long")


def total_of(column: str) -> Column:
    return F.coalesce(F.sum(F.when(is_kind("TokenEvent"), size_of(column))), F.lit(0)).cast("long")


def n_steps() -> Column:
    return F.count_if(is_kind("TokenEvent"))


def token_totals(events: DataFrame) -> DataFrame:
    """traj_id, token sums and their means per token event; zeros without one."""
    sums = events.groupBy("traj_id").agg(total_of("prompt_token_ids").alias("prompt_tokens"), total_of("response_token_ids").alias("response_tokens"), n_steps().alias("steps"))
    return sums.select(
        "traj_id",
        (F.col("prompt_tokens") + F.col("response_tokens")).alias("total_tokens"),
        "prompt_tokens",
        "response_tokens",
        ratio(F.col("prompt_tokens"), F.col("steps")).alias("avg_prompt_tokens"),
        ratio(F.col("response_tokens"), F.col("steps")).alias("avg_response_tokens"),
    )


def steps(events: DataFrame) -> DataFrame:
    return events.groupBy("traj_id").agg(n_steps().alias("steps"))


def tool_call_names(events: DataFrame) -> DataFrame:
    """traj_id, name, n: calls in assistant messages; a call without a name is ``unknown``."""
    calls = events.where((F.col("role") == "assistant") & F.col("tool_calls").isNotNull()).select("traj_id", F.explode("tool_calls").alias("call"))
    return calls.groupBy("traj_id", F.coalesce(F.col("call.function.name"), F.lit("unknown")).alias("name")).agg(F.count("*").alias("n"))


def tool_calls(events: DataFrame) -> DataFrame:
    """traj_id, total_tool_calls, avg_tool_calls_per_step, tool_call_breakdown (map, names in order)."""
    # an event's row for itself (no name), and one for each of its calls: one scan and one shuffle for steps and names
    calls = F.when(F.col("role") == "assistant", F.transform("tool_calls", lambda c: F.struct(F.coalesce(c["function"]["name"], F.lit("unknown")).alias("name"))))
    entries = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("name"))), F.coalesce(calls, F.array().cast("array<struct<name:string>>")))
    rows = events.select("traj_id", is_kind("TokenEvent").alias("step"), F.explode(entries).alias("entry"))
    named = F.col("entry.name").isNotNull()
    counts = rows.groupBy("traj_id", F.col("entry.name").alias("name")).agg(F.count("*").alias("n"), F.count_if(F.col("step") & ~named).alias("steps"))
    own = F.when(F.col("name").isNotNull(), F.struct("name", "n"))
    each = counts.groupBy("traj_id").agg(F.sum("steps").alias("steps"), F.coalesce(F.sum(F.when(F.col("name").isNotNull(), F.col("n"))), F.lit(0)).alias("calls"), F.map_from_entries(F.array_sort(F.collect_list(own))).alias("breakdown"))
    return each.select("traj_id", F.col("calls").alias("total_tool_calls"), ratio(F.col("calls"), F.col("steps")).alias("avg_tool_calls_per_step"), F.col("breakdown").alias("tool_call_breakdown"))


def efficiency(events: DataFrame, wall_clock: DataFrame | None = None) -> DataFrame:
    """The flat efficiency row, from one aggregation; wall_clock: traj_id, wall_clock_duration."""
    calls = F.coalesce(F.sum(F.when(F.col("role") == "assistant", size_of("tool_calls"))), F.lit(0))
    row = events.groupBy("traj_id").agg(total_of("prompt_token_ids").alias("prompt_tokens"), total_of("response_token_ids").alias("response_tokens"), n_steps().alias("steps"), calls.alias("calls"))
    if wall_clock is not None:
        row = row.join(wall_clock, "traj_id", "left")
    else:
        row = row.withColumn("wall_clock_duration", F.lit(0.0))
    per_step = lambda c: ratio(F.col(c), F.col("steps"))
    return row.select(
        "traj_id",
        (F.col("prompt_tokens") + F.col("response_tokens")).alias("tokens"),
        "steps",
        per_step("calls").alias("avg_tool_calls_per_step"),
        "wall_clock_duration",
        "prompt_tokens",
        "response_tokens",
        per_step("prompt_tokens").alias("avg_prompt_tokens"),
        per_step("response_tokens").alias("avg_response_tokens"),
    )


def turns_and_calls(events: DataFrame) -> DataFrame:
    return events.groupBy("traj_id").agg(n_steps().alias("turns"), F.count_if(is_kind("ActionEvent")).alias("tool_calls"))


def trajectory(events: DataFrame) -> DataFrame:
    """traj_id, turns, tool_calls, tool_calls_per_turn, tool_calls_by_turn (per response id, first seen first; calls without an id only in the total)."""
    action = is_kind("ActionEvent")
    named = action & (F.coalesce("llm_response_id", F.lit("")) != "")
    by_id = events.groupBy("traj_id", F.when(named, F.col("llm_response_id")).alias("of")).agg(F.min("pos").alias("first"), n_steps().alias("turns"), F.count_if(action).alias("n"))
    turn = F.when(F.col("of").isNotNull(), F.struct("first", "n"))
    lists = by_id.groupBy("traj_id").agg(F.sum("turns").alias("turns"), F.sum("n").alias("tool_calls"), F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["n"]).alias("tool_calls_by_turn"))
    return lists.select("traj_id", "turns", "tool_calls", ratio(F.col("tool_calls"), F.col("turns")).alias("tool_calls_per_turn"), "tool_calls_by_turn")


def kind_name(kind: Column | None = None) -> Column:
    return F.coalesce(F.col("kind") if kind is None else kind, F.lit(UNKNOWN_KIND))


def kind_histogram(events: DataFrame) -> DataFrame:
    return events.groupBy("traj_id", kind_name().alias("kind")).agg(F.count("*").alias("n"))


def observed_kinds(events: DataFrame) -> DataFrame:
    """kind: the distinct kinds of an event log, `Unknown` for events without one."""
    return events.select(kind_name().alias("kind")).distinct()


def listed_kinds(kinds: DataFrame) -> list[str]:
    """A frame of distinct kinds as a sorted list, for a schema; at most as many as Spark lets a pivot have."""
    most = int(kinds.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    found = sorted(r["kind"] for r in kinds.limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"more than {most} kinds of events")
    return found


def kind_pivot(events: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """traj_id and count_<kind> for each kind, 0 where absent; the kinds are those of the data unless given (others are then left out)."""
    kinds = listed_kinds(observed_kinds(events)) if kinds is None else sorted(kinds)
    wide = events.withColumn("kind", kind_name()).groupBy("traj_id").pivot("kind", kinds).count().na.fill(0)
    return wide.select("traj_id", *[F.col(f"`{k}`").cast("long").alias(f"count_{k}") for k in kinds])


def has_tool_turn(events: DataFrame) -> DataFrame:
    """1 if any message calls a tool, else 0."""
    return events.groupBy("traj_id").agg(F.coalesce(F.max((size_of("tool_calls") > 0).cast("int")), F.lit(0)).alias("has_tool_turn"))


def mean_calls_of_tool_turns(events: DataFrame, clip: float = 5.0) -> DataFrame:
    """Mean calls over messages that have any, cut at `clip`, as a share of it."""
    n = size_of("tool_calls")
    return events.groupBy("traj_id").agg((F.least(F.lit(clip), F.coalesce(F.avg(F.when(n > 0, n)), F.lit(0.0))) / F.lit(clip)).alias("tool_turn_mean"))


def completed(chat: DataFrame, max_turns: int, too_long: Column | None = None) -> DataFrame:
    """traj_id, completed: the last message is the assistant's and has both file tags (in any order), or the turns are used up, or the prompt is `too_long`."""
    last = chat.groupBy("traj_id").agg(F.max_by(F.struct("role", "content"), "pos").alias("last"), F.count("*").alias("n"), *([] if too_long is None else [F.max(too_long).alias("long")]))
    text = F.coalesce("last.content", F.lit(""))
    done = F.coalesce(F.col("last.role") == "assistant", F.lit(False)) & text.contains("<files>") & text.contains("</files>") | (F.col("n") >= max_turns)
    return last.select("traj_id", (done if too_long is None else done | F.coalesce("long", F.lit(False))).alias("completed"))


def rubric(events: DataFrame, weights: tuple[float, float] = (1.0, 1.0), clip: float = 5.0) -> DataFrame:
    """traj_id, score: has_tool_turn and tool_turn_mean weighed and summed, in one aggregation."""
    n = size_of("tool_calls")
    mean = F.least(F.lit(clip), F.coalesce(F.avg(F.when(n > 0, n)), F.lit(0.0))) / F.lit(clip)
    has = F.coalesce(F.max((n > 0).cast("int")), F.lit(0))
    return events.groupBy("traj_id").agg((F.lit(weights[0]) * has + F.lit(weights[1]) * mean).alias("score"))


def map_total(rewards: Column) -> Column:
    """The sum of a map's values, nulls left out, 0.0 for none."""
    return F.aggregate(F.coalesce(F.map_values(rewards), F.array().cast("array<double>")), F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0)))
