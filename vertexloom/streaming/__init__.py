"""Streams: a run's log can be followed while it grows; per-line extraction is stateless and runs on any stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.operators.logs import OWN_LINE


def follow_log(lines: DataFrame, line: str = OWN_LINE) -> DataFrame:
    """(vertex, rank, residual) from a stream (or table) of text lines in column ``value``."""
    part = lambda k: F.regexp_extract("value", line, k)
    return lines.where(part(1) != "").select(part(1).cast("long").alias("vertex"), part(2).cast("double").alias("rank"), part(3).cast("double").alias("residual"))
