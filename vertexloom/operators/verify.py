"""Checks of results against the graph, and summaries of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ends(edges: DataFrame, state: DataFrame, column: str) -> DataFrame:
    end = lambda e: state.select(F.col("id").alias(e), F.col(column).alias(f"{e}_value"))
    return edges.select("src", "dst").join(end("src"), "src").join(end("dst"), "dst")


def distance_errors(edges: DataFrame, state: DataFrame) -> DataFrame:
    """One row: edges from a reached vertex whose end is further than one step on."""
    bad = F.col("dst_value").isNull() | (F.col("dst_value") > F.col("src_value") + 1)
    return _ends(edges, state.select("id", "dist"), "dist").where("src_value is not null").agg(F.count_if(bad).alias("errors"))


def component_errors(edges: DataFrame, state: DataFrame) -> DataFrame:
    """One row: edges whose ends have different labels."""
    return _ends(edges, state.select("id", "label"), "label").agg(F.count_if(F.col("src_value") != F.col("dst_value")).alias("errors"))


def distance_summary(state: DataFrame) -> DataFrame:
    return state.agg(F.count("dist").alias("visited"), F.max("dist").alias("max_dist"))


def top_ranks(state: DataFrame, k: int = 20, one_per_rank: bool = False) -> DataFrame:
    """The k largest ranks (a top-k report); ``one_per_rank`` keeps the largest id of equal ranks."""
    rows = state.groupBy("rank").agg(F.max("id").alias("id")) if one_per_rank else state.select("id", "rank")
    return rows.select("id", "rank").orderBy(F.desc("rank"), "id").limit(k)
