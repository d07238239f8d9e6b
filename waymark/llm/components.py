"""Connected components of a table of links, by least labels with pointer jumping; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def connected(links: DataFrame) -> DataFrame:
    """links: x, y (long). Returns node, component (its least node) for every node of a link."""
    both = shared.stage(links.select("x", "y").union(links.select("y", "x")).where("x <> y").distinct(), "links")
    labels = shared.stage(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.min("x")).alias("component")), "labels")
    while True:
        at_y = labels.select(F.col("node").alias("y"), F.col("component").alias("seen"))
        near = both.join(at_y, "y").groupBy(F.col("x").alias("node")).agg(F.min("seen").alias("seen"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "seen").alias("component"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("far"))
        lower = lower.join(jump, F.col("component") == F.col("via"), "left").select("node", "was", F.least("component", F.coalesce("far", "component")).alias("component"))
        lower = shared.stage(lower, "labels")
        changed = lower.where("component <> was").limit(1).count()
        labels = lower.select("node", "component")
        if not changed:
            return labels
