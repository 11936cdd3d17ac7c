"""Run logs as tables: extraction per iteration and comparison of two runs.

Lines come as (line_no, line). The iteration marker is filled forward over the lines after it, in slices of line numbers: the
last marker inside the slice, or else the last one of the slices before, of which there is a row each. Positions inside an
iteration, which may have a line per vertex, come from sliced running counts. No window holds a whole log or iteration.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.functions.ordered import running

#: The two log formats.
_NUMBER = r"([0-9]+\.[0-9]+(?:[eE][-+]?[0-9]+)?)"
OWN_MARK, OWN_LINE = r"Iteration: ([0-9]+)", rf"Vertex ([0-9]+): {_NUMBER}/{_NUMBER}"
OTHER_MARK, OTHER_LINE = r"\[Leader\] Iteration ([0-9]+) complete", rf"([0-9]+)\s+{_NUMBER}\s+{_NUMBER}"


def extract(lines: DataFrame, mark: str = OWN_MARK, line: str = OWN_LINE, run: str | None = None) -> DataFrame:
    """(iteration, line_no, vertex, rank, residual) at 4 decimals; lines before the first marker are of iteration 0.

    A format's marks and lines may stand anywhere in a line of the log, parted by any blanks."""
    by = [run] if run else []
    found = lines.select(*by, "line_no", F.regexp_extract("line", mark, 1).alias("i"), F.regexp_extract("line", line, 1).alias("v"), F.regexp_extract("line", line, 2).alias("x"), F.regexp_extract("line", line, 3).alias("y")).where("i <> '' or v <> ''")
    # forward fill by slices: last marker inside the slice, else the last one of earlier slices
    size = 100_000
    sliced = found.withColumn("_slice", F.floor(F.col("line_no") / size)).withColumn("i", F.nullif("i", F.lit("")).cast("long"))
    inside = Window.partitionBy(*by, "_slice").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    ends = sliced.groupBy(*by, "_slice").agg(F.max_by("i", F.when(F.col("i").isNotNull(), F.col("line_no"))).alias("_end"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(*by, "_slice", F.last("_end", ignorenulls=True).over(before).alias("_start"))
    filled = sliced.withColumn("_here", F.last("i", ignorenulls=True).over(inside)).join(starts, [*by, "_slice"])
    return filled.where("v <> ''").select(*by, F.coalesce("_here", "_start", F.lit(0)).cast("long").alias("iteration"), "line_no", F.col("v").cast("long").alias("vertex"), F.round(F.col("x").cast("double"), 4).alias("rank"), F.round(F.col("y").cast("double"), 4).alias("residual"))


def compare(a: DataFrame, b: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """(iteration, vertex, r1, r2, diff, status): what differs between two extractions, paired by place over the whole log.

    'diff': the residuals of one vertex in one iteration differ by more than the tolerance, at 4 decimals. 'mismatch': the
    pair is of different iterations or vertices, or one log has no line there; iteration and vertex are the first log's,
    or else the second's.
    """
    rows = lambda df: running(df.select("iteration", "line_no", "vertex", "residual"), [], ["line_no"])
    side = lambda df, k: rows(df).select(F.col("iteration").alias(f"i{k}"), F.col("pos").alias(f"place{k}"), F.col("vertex").alias(f"v{k}"), F.col("residual").alias(f"r{k}"))
    pairs = side(a, 1).join(side(b, 2), F.expr("place1 = place2"), "full")
    same = F.expr("i1 <=> i2 and v1 <=> v2 and place1 is not null and place2 is not null")
    gap = F.round(F.abs(F.col("r1") - F.col("r2")), 4)
    kept = pairs.where(~same | (gap > tolerance))
    first = lambda k: F.when(F.col("place1").isNotNull(), F.col(f"{k}1")).otherwise(F.col(f"{k}2"))
    return kept.select(first("i").alias("iteration"), first("v").alias("vertex"), "r1", "r2", F.when(same, gap).alias("diff"), F.when(same, "diff").otherwise("mismatch").alias("status"))
