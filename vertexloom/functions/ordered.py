"""Positions and running sums over large ordered groups, without one task per group.

A window over (group order by key) puts a whole group into one task. Here rows are range-partitioned by group and key, each
slice is numbered on its own, and the slices' totals (a row per slice and group) are summed up to give each slice its start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.session import cut_lineage


def running(df: DataFrame, group: list[str], order: list[str], value: str | None = None, slices: int | None = None) -> DataFrame:
    """Adds ``pos`` (from 0 within the group) and, with ``value``, ``cum`` (its inclusive running sum; nulls count 0).

    ``group`` + ``order`` should identify rows; ties get any order. Group columns may be null (null is a group).
    """
    if not group and not value:
        return _numbered(df, order, slices)
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = df.repartitionByRange(n, *group, *order).withColumn("_slice", F.spark_partition_id())
    sliced = cut_lineage(sliced)  # a retried task must not deal the slices anew
    own = F.coalesce(F.col(value), F.lit(0)) if value else F.lit(0)
    totals = sliced.groupBy(*group, "_slice").agg(F.count("*").alias("_n"), F.sum(own).alias("_s"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)),
        F.col("_slice").alias("_at"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"),
    )
    inside = Window.partitionBy(*group, "_slice").orderBy(*order)
    numbered = sliced.withColumn("_pos", F.row_number().over(inside) - 1)
    if value:
        numbered = numbered.withColumn("_cum", F.sum(own).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    on = F.col("_slice") == F.col("_at")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = numbered.join(starts, on)
    out = [*df.columns, (F.col("_pos") + F.col("_n0")).cast("long").alias("pos")]
    if value:
        out.append((F.col("_cum") + F.col("_s0")).alias("cum"))
    return joined.select(*out)


def _numbered(df: DataFrame, order: list[str], slices: int | None) -> DataFrame:
    """``running`` over the whole table, without values: slices are sorted as they are dealt, rows are numbered where they lie,
    and the slices' sizes (a row each) are broadcast, so rows are shuffled once."""
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = cut_lineage(df.repartitionByRange(n, *order).sortWithinPartitions(*order)).withColumn("_i", F.monotonically_increasing_id())
    sliced = sliced.withColumns({"_slice": F.shiftright("_i", 33), "_row": F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = sliced.groupBy("_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("_slice").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    joined = sliced.join(F.broadcast(starts), F.col("_slice") == F.col("_at"))
    return joined.select(*df.columns, (F.col("_row") + F.col("_n0")).cast("long").alias("pos"))


def next_in_order(df: DataFrame, column: str, order: list[str], slices: int | None = None) -> DataFrame:
    """Adds ``next``: ``column`` of the following row in the total order (a global lead), by positions and an equi-join."""
    at = running(df, [], order, slices=slices)
    after = at.select((F.col("pos") - 1).alias("pos"), F.col(column).alias("next"))
    return at.join(after, "pos", "left")
