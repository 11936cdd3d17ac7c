"""Message volume of a run, as a model: what a bitmap-and-packed-values wire format would move."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bytes_moved(rounds: DataFrame, slots: int, value_bytes: int = 8) -> DataFrame:
    """Adds ``bytes`` to rows of rounds: 8-byte bitmap words over ``slots`` plus one value for each active row."""
    words = -(-slots // 64) * 8
    return rounds.withColumn("bytes", (F.lit(words) + F.col("active") * value_bytes).cast("long"))


def run_stats(rounds: DataFrame, slots: int, replication: DataFrame, value_bytes: int = 8) -> DataFrame:
    """One row for a run: iterations, messages, bytes (by the model above), and the partitioning's replication factor."""
    whole = bytes_moved(rounds, slots, value_bytes).agg(
        F.count("*").alias("iterations"), F.coalesce(F.sum("messages"), F.lit(0)).cast("long").alias("messages"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes")
    )
    return whole.crossJoin(replication.select("replication_factor"))


def joined_text(values: DataFrame, column: str, order: list[str]) -> DataFrame:
    """One row: the column's values joined by blanks in order (a formatter for small arrays)."""
    ordered = F.sort_array(F.collect_list(F.struct(*order, F.col(column).cast("string").alias("_v"))))
    return values.agg(F.array_join(F.transform(ordered, lambda x: x["_v"]), " ").alias("text"))
