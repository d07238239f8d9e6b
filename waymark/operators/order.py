"""Places, running sums and carried values over whole tables: counted part by part, so that no task sees all rows or a whole key.

Rows are dealt to parts by range of an order, sorted in them and numbered; what lies before a part is a running sum over the parts'
totals, a row per part. Numbered rows are written to the shared scratch folder, so places stay the same however often they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..sources import written

#: Rows that a task takes of a table that is dealt by key.
TASK_ROWS = 1 << 19
#: Rows of a key whose carried values one task looks at.
RANGE_ROWS = 1 << 16


def parts_of(table: DataFrame, times: int = 1) -> int:
    """Parts for what a table's rows become (`times` rows each), so that a task's share does not grow with the table; Parquet counts from its footers."""
    return max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() * times // TASK_ROWS))


def _before(name: str, over) -> Column:
    return F.coalesce(F.sum(name).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def placed(df: DataFrame, *order: Column | str, name: str = "_place", count: Column | None = None, running: str = "_running") -> DataFrame:
    """df with its rows' places (from 0) in an order; with `count`, also the sum of that number over all rows before, as `running`.

    Ties are broken by where the rows lay before: equal rows have places of their own and may be dealt to several parts.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    named = [f"_o{i}" for i in range(len(keys))]
    rows = df.select("*", *[k.alias(n) for k, n in zip(keys, named, strict=True)], F.monotonically_increasing_id().alias("_lay"))
    rows = rows.repartitionByRange(parts, *named, "_lay").sortWithinPartitions(*named, "_lay").drop(*named, "_lay")
    own = [] if count is None else [F.coalesce(count, F.lit(0)).cast("long").alias("_count")]
    rows = written(rows.select("*", *own, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "placed")
    sums = [] if count is None else [F.sum("_count").alias("_sum")]
    over = Window.orderBy("_part")  # a row per part
    totals = rows.groupBy("_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), *sums)
    totals = totals.select("_part", "_first", _before("_n", over).alias("_rows_before"), *([] if count is None else [_before("_sum", over).alias("_sum_before")]))
    out = rows.join(F.broadcast(totals), "_part").withColumn(name, F.col("_at") - F.col("_first") + F.col("_rows_before"))  # a row per part
    if count is not None:
        local = _before("_count", Window.partitionBy("_part").orderBy("_at"))
        out = out.withColumn(running, F.col("_sum_before") + local).drop("_sum_before", "_count")
    return out.drop("_part", "_at", "_first", "_rows_before")


def zipped(left: DataFrame, right: DataFrame, left_order: list[Column | str], right_order: list[Column | str], name: str = "_place") -> DataFrame:
    """The n-th row of one table beside the n-th row of another, each in its own order; ValueError if they differ in length.

    Columns that both have are taken from the left.
    """
    a, b = placed(left, *left_order, name=name), placed(right, *right_order, name=name)
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"tables of {n} and {m} rows can't be zipped")
    return a.join(b.drop(*[c for c in b.columns if c in left.columns and c != name]), name)


def carried(rows: DataFrame, key: str, pos: str, marks: dict[str, Column], range_rows: int = RANGE_ROWS, parts: int | None = None) -> DataFrame:
    """rows with the last mark at or before each row of its key, in order of `pos`; a mark is null where it says nothing.

    To carry a null forward (a reset), wrap values in a struct: a struct that holds a null is a mark. `pos` is a number from 0
    or 1 that a key has once; a key is cut into ranges of it, and what a range ends with is carried to the ranges after it by a window over
    ranges, so that a key of any length costs a task `range_rows` rows. With `parts`, the ranges are dealt to so many tasks (`parts_of`).
    """
    names = {m: f"_mark_{i}" for i, m in enumerate(marks)}
    of = ["_key", "_null", "_range"]  # a key that may be null, as two columns: equal ones meet where they were dealt to
    known = F.coalesce(F.col(key), F.lit(0)) if isinstance(rows.schema[key].dataType, NumericType) else F.coalesce(F.col(key).cast("string"), F.lit(""))
    cut = rows.select("*", *[c.alias(names[m]) for m, c in marks.items()], known.alias("_key"), F.isnull(key).alias("_null"), F.floor(F.col(pos) / range_rows).alias("_range"))
    cut = cut if parts is None else cut.repartition(parts, *of)
    within = Window.partitionBy(*of).orderBy(pos)
    local = cut.select(*[c for c in cut.columns if c not in names.values()], *[F.last(names[m], ignorenulls=True).over(within).alias(m) for m in marks])
    ends = cut.groupBy(*of).agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col(pos))).alias(n) for n in names.values()])
    earlier = Window.partitionBy("_key", "_null").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*of, *[F.last(n, ignorenulls=True).over(earlier).alias(n) for n in names.values()])
    met = local.join(ends.where(F.col("_range") > 0), of, "left")
    return met.select(*rows.columns, *[F.coalesce(m, n).alias(m) for m, n in names.items()])
