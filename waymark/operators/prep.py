"""Task-set preparation: prompts, splits, first-N selections; every order is an explicit one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.diff import patch_map, targets_column
from .order import placed


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def with_prompt(instances: DataFrame) -> DataFrame:
    return instances.withColumn("prompt", F.array(message("user", F.col("problem_statement"))))


def with_evaluation_row(instances: DataFrame, system: str, max_tokens: int, max_tool_calls: int) -> DataFrame:
    """prompt (system, user), info (repo, instance_id, limits), answer (the parsed patch as a JSON object by path)."""
    info = F.struct("repo", "instance_id", F.lit(max_tokens).alias("max_tokens"), F.lit(max_tool_calls).alias("max_tool_calls"))
    prompt = F.array(message("system", F.lit(system)), message("user", F.col("problem_statement")))
    return instances.select(prompt.alias("prompt"), info.alias("info"), F.to_json(patch_map(F.col("patch"))).alias("answer"))


def answer_files(answer: Column) -> Column:
    """The paths of such an answer, as a set to score against; none if it is not JSON."""
    return F.coalesce(F.json_object_keys(answer), F.array().cast("array<string>"))


def by_hash(id_col: str, seed: int) -> list[Column]:
    """A total order that looks random and is the same every time."""
    return [F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)]


def shuffled(df: DataFrame, id_col: str, seed: int | None = None) -> DataFrame:
    return df.orderBy(F.rand()) if seed is None else df.orderBy(*by_hash(id_col, seed))


def hash_ranked(df: DataFrame, id_col: str, seed: int, name: str = "_rank") -> DataFrame:
    """df with ranks from 1 in the order of `by_hash`: counts per range of the hash first, so that no task sees all rows."""
    order = by_hash(id_col, seed)
    dealt = df.withColumn("_range", F.shiftright(order[0], 52))  # 4096 ranges, in the hash's order
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = dealt.withColumn("_local", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return local.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_local")).drop("_range", "_local", "_before")  # 4096 rows at most


def tail_split(df: DataFrame, order: list[Column], n_validation: int = 100) -> DataFrame:
    """df with `split`: exactly the last n rows are validation, the rest train (none if there are no more than n).

    A top-k finds the key of the n-th row from the end. If more rows share it than are needed, these rows alone are told apart: by a
    fingerprint of all their columns, then, if equal, by a place of their own.
    """
    if not n_validation:
        return df.withColumn("split", F.lit("train"))
    names = [f"_k{i}" for i in range(len(order))]
    held = df.select(F.struct(*[c.alias(n) for c, n in zip(order, names, strict=True)]).alias("_key")).orderBy(F.desc("_key")).limit(n_validation)
    cut = held.agg(F.min("_key").alias("_from"), F.count("*").alias("_held"))  # one row of n
    keyed = df.withColumn("_key", F.struct(*[c.alias(n) for c, n in zip(order, names, strict=True)])).crossJoin(F.broadcast(cut))
    after, tied = F.col("_key") > F.col("_from"), F.col("_key").eqNullSafe(F.col("_from"))
    split = lambda is_held: F.when(is_held, "validation").otherwise("train").alias("split")
    n_after, n_tied, n_held = keyed.agg(F.count_if(after), F.count_if(tied), F.coalesce(F.max("_held"), F.lit(0))).first()
    if n_after + n_tied == n_held:
        return keyed.select(*df.columns, split(after | tied))
    hashable = [c for c, kind in df.dtypes if "map<" not in kind]
    ties = placed(keyed.where(tied).select(*df.columns), F.xxhash64(*hashable) if hashable else F.lit(0), name="_tie")
    return keyed.where(~tied).select(*df.columns, split(after)).unionByName(ties.select(*df.columns, split(F.col("_tie") < n_held - n_after)))


def ratio_split(df: DataFrame, id_col: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """df with `split`: exactly ceil(share * n) rows are test, chosen by hash."""
    counted = hash_ranked(df, id_col, seed).crossJoin(F.broadcast(df.agg(F.count("*").alias("_n"))))  # one row
    return counted.withColumn("split", F.when(F.col("_rank") <= F.ceil(F.col("_n") * test_share), "test").otherwise("train")).drop("_rank", "_n")


def select_mode(train: DataFrame, test: DataFrame, mode: str) -> DataFrame | tuple[DataFrame, DataFrame]:
    """train, test, full (both), or for any other mode the pair."""
    match mode:
        case "train":
            return train
        case "test":
            return test
        case "full":
            return train.unionByName(test)
        case _:
            return train, test


def by_id(df: DataFrame, id_col: str, value) -> DataFrame:
    return df.where(F.col(id_col) == value).limit(1)


def by_ordinal(df: DataFrame, order: list[Column], ordinal: int) -> DataFrame:
    """The row of an ordinal from 0 in an order; an error if there is none."""
    if ordinal < 0 or ordinal >= df.count():
        raise IndexError(f"no row {ordinal}")
    return df.orderBy(*order).offset(ordinal).limit(1)


def first_n_keys(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """All rows of the n keys that appear first."""
    first = df.groupBy(key).agg(F.min(order).alias("_first")).orderBy("_first").limit(n).select(key)
    return df.join(first, key, "left_semi")


def build_task_set(instances: DataFrame) -> DataFrame:
    return with_prompt(targets_column(instances))
