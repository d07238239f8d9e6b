"""Set scores: precision, recall and F1 under the rules for empty sets that are in use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(common: Column, predicted: Column, gold: Column, both_empty: float = 0.0) -> Column:
    """F1 of three sizes; `both_empty` is the score of two empty sets (0.0 strict, 1.0 lenient); one empty set scores 0."""
    p, r = _ratio(common, predicted), _ratio(common, gold)
    score = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return F.when((predicted == 0) & (gold == 0), F.lit(both_empty)).otherwise(score)


def precision(common: Column, predicted: Column) -> Column:
    return _ratio(common, predicted)


def recall(common: Column, gold: Column) -> Column:
    return _ratio(common, gold)


def clean_set(items: Column) -> Column:
    """Distinct items without nulls; null as an empty set."""
    return F.array_distinct(F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: x.isNotNull()))


def set_sizes(predicted: Column, gold: Column) -> tuple[Column, Column, Column]:
    p, g = clean_set(predicted), clean_set(gold)
    return F.size(F.array_intersect(p, g)), F.size(p), F.size(g)


def set_f1(predicted: Column, gold: Column, both_empty: float = 0.0) -> Column:
    """F1 of two sets, which are worked out once however often their sizes are used."""
    sets = F.struct(clean_set(predicted).alias("p"), clean_set(gold).alias("g"))
    sizes = lambda s: F.struct(F.size(F.array_intersect(s["p"], s["g"])).alias("c"), F.size(s["p"]).alias("p"), F.size(s["g"]).alias("g"))
    return let(let(sets, sizes), lambda n: f1(n["c"], n["p"], n["g"], both_empty))


def tool_result(predicted: Column, gold: Column) -> dict[str, Column]:
    """success, precision, recall, f1 of a result call: a null prediction is a call that failed, and scores 0.0 like a null gold."""
    common, p, g = set_sizes(predicted, gold)
    known = predicted.isNotNull() & gold.isNotNull()
    scores = {"precision": precision(common, p), "recall": recall(common, g), "f1": f1(common, p, g)}
    return {"success": F.when(predicted.isNotNull(), 1.0).otherwise(0.0)} | {name: F.when(known, score).otherwise(0.0) for name, score in scores.items()}


def long_sizes(items: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Sizes from long rows (key, item, predicted, gold flags), which may repeat; one shuffle on (key, item), partial sums on key.

    With `parts` (`order.parts_of`), rows are dealt to so many tasks by key and bucket of items, and a sum per bucket to so many by key: a
    task's share does not grow with the table, and a key with any number of items is summed in many tasks.
    """
    of = [key]
    if parts is not None:
        of = [key, "_bucket"]
        bucket = F.pmod(F.xxhash64("item"), F.lit(parts))
        items = items.repartition(parts, key, bucket).withColumn("_bucket", bucket)  # worked out on both sides, so that it need not travel
    flags = items.groupBy(*of, "item").agg(F.max(F.col("predicted").cast("int")).alias("p"), F.max(F.col("gold").cast("int")).alias("g"))
    sums = flags.groupBy(*of).agg(F.sum(F.col("p") * F.col("g")).alias("n_common"), F.sum("p").alias("n_predicted"), F.sum("g").alias("n_gold"))
    if parts is None:
        return sums
    return sums.repartition(parts, key).groupBy(key).agg(*[F.sum(n).alias(n) for n in sums.columns[2:]])


LEVELS = ("file", "module", "entity")


def multilevel(predicted: dict[str, Column], gold: dict[str, Column], weights: dict[str, float] | None = None) -> tuple[Column, dict[str, Column]]:
    """Weighted sum (not normalised) of the strict F1 at three levels, and its parts."""
    parts = {f"{level}_reward": set_f1(predicted[level], gold[level]) for level in LEVELS}
    total = sum((F.lit((weights or {}).get(level, 1.0)) * parts[f"{level}_reward"] for level in LEVELS), F.lit(0.0))
    return total, {"multilevel_localization_f1_reward": total} | parts


def gold_levels(file_changes: Column) -> dict[str, Column]:
    """Sets of files, modules and entities of ARRAY<STRUCT<file, changes>>; a missing column counts as no gold."""
    changes = F.coalesce(file_changes, F.array().cast("array<struct<file:string,changes:struct<edited_modules:array<string>,edited_entities:array<string>>>>"))
    none = F.array().cast("array<string>")
    return {
        "file": F.transform(changes, lambda c: c["file"]),
        "module": F.flatten(F.transform(changes, lambda c: F.coalesce(c["changes"]["edited_modules"], none))),
        "entity": F.flatten(F.transform(changes, lambda c: F.coalesce(c["changes"]["edited_entities"], none))),
    }


def file_score(predicted: Column, target: Column, weight: float = 1.0) -> tuple[Column, dict[str, Column]]:
    """Strict F1 of files against the distinct files of `target`; the weight is on the score, not on the part."""
    part = set_f1(predicted, F.transform(target, lambda t: t["file"]))
    return F.lit(weight) * part, {"file_level_score": part}
