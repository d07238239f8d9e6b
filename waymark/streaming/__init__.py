"""Extensions beyond the batch operators: event counts and token sums of running trajectories, with late events bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_kinds(events: DataFrame, time_col: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """events (traj_id, kind, a timestamp) to counts per window and kind; works on streams and on tables."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("window"), "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "kind", "n")


def windowed_tokens(events: DataFrame, time_col: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Prompt and response tokens per window."""
    size = lambda c: F.sum(F.coalesce(F.size(c), F.lit(0)))
    sums = events.withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("window")).agg(size("prompt_token_ids").alias("prompt_tokens"), size("response_token_ids").alias("response_tokens"))
    return sums.select(F.col("window.start").alias("start"), "prompt_tokens", "response_tokens")
