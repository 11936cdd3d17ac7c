"""Where a round's traversal happens: ship the frontier to the edges by broadcast, or by a co-partitioned join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A frontier is broadcast only if its rows fit in this many bytes (counted before the join, 8 bytes a field + header).
BROADCAST_BYTES = 8 << 20
ROW_BYTES = 40


@dataclass(frozen=True)
class Decision:
    strategy: str
    reason: str


def choose_join(active: int, vertices: int) -> Decision:
    """'broadcast' for a frontier whose counted size is under BROADCAST_BYTES and under a twentieth of the vertices."""
    if active * ROW_BYTES <= BROADCAST_BYTES and active * 20 <= vertices:
        return Decision("broadcast", "small frontier")
    return Decision("shuffle", "frontier over the size bound or a twentieth of the vertices")


def frontier_cost(state: DataFrame, degrees: DataFrame) -> DataFrame:
    """One row: frontier size, summed out-degree, and their sum (the in-network aggregation cost)."""
    hit = state.where("active").join(degrees, "id")
    return hit.agg(F.count("*").alias("frontier"), F.coalesce(F.sum("degree"), F.lit(0)).cast("long").alias("out_edges")).withColumn("cost", F.col("frontier") + F.col("out_edges"))


def offload_decision(state: DataFrame, coverage: DataFrame, mirrors: DataFrame) -> DataFrame:
    """One row: frontier, threshold (V/20), uncovered, most and mean frontier vertices of the mirrors that hold any, decision.

    Traversal stays next to the edges ('offload') if the frontier is empty or above the threshold, if a frontier vertex
    has an out-neighbour homed elsewhere, or if the fullest mirror is below the integer mean of those touched (which
    can't be; kept because it is part of the rule). Otherwise 'local'.
    """
    active = state.where("active").select("id")
    sizes = state.agg(F.count("*").alias("v"), F.count_if("active").alias("frontier"))
    bad = active.join(coverage, "id").agg(F.count_if(~F.col("covered")).alias("uncovered"))
    touched = active.join(mirrors, "id").groupBy("mirror").agg(F.count("*").alias("n"))
    spread = touched.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.floor(F.sum("n") / F.nullif(F.count("*"), F.lit(0))), F.lit(0)).cast("long").alias("mean"))
    one = sizes.crossJoin(bad).crossJoin(spread).withColumn("threshold", F.floor(F.col("v") / 20).cast("long"))
    offload = (F.col("frontier") == 0) | (F.col("frontier") > F.col("threshold")) | (F.col("uncovered") > 0) | (F.col("most") < F.col("mean"))
    return one.select("frontier", "threshold", "uncovered", "most", "mean", F.when(offload, "offload").otherwise("local").alias("decision"))
