"""Consecutive numbers over groups of any size, without collecting a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lavra.session import materialize


def number_rows(df: DataFrame, by: list[str], order: list[str], name: str = "n") -> DataFrame:
    """row_number() over (partition by `by` order by `order`), from 1.

    Rows are range-partitioned by group and order, numbered inside each range, and shifted by the counts of the ranges
    before: only (range, group) counts meet in one place, never the rows of a group. `order` must be unique in a group.
    """
    parts = df.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id())
    ranged = materialize(parts, "ranged")
    inside = Window.partitionBy("__range", *by).orderBy(*order)
    counted = ranged.groupBy("__range", *by).agg(F.count("*").alias("__rows"))
    before = counted.withColumn("__before", F.coalesce(F.sum("__rows").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__rows")
    local = ranged.withColumn("__local", F.row_number().over(inside))
    same = [F.col("l.__range") == F.col("b.__range"), *[F.col(f"l.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]]
    return local.alias("l").join(before.alias("b"), same).select(*[F.col(f"l.{c}") for c in df.columns], (F.col("__local") + F.col("__before")).alias(name))
