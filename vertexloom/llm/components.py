"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vertexloom.session import shared_path


def _fixed(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Distinct edges as a written table, and a fingerprint of the set."""
    seen, path = Observation(), shared_path(edges.sparkSession, "links")
    code = F.xxhash64("u", "v")
    edges.distinct().observe(seen, F.count("*").alias("n"), F.sum(F.shiftright(code, 20)).alias("s"), F.bit_xor(code).alias("x")).write.parquet(path)
    got = seen.get
    return edges.sparkSession.read.schema("u long, v long").parquet(path), (got["n"], got["s"], got["x"])


def connected_components(links: DataFrame, limit: int = 100) -> DataFrame:
    """(node, root): the smallest node reachable over links (u, v), for every node that has a link.

    Each round hangs every node's larger neighbours on its smallest neighbour (large star), then its smaller ones (small
    star), both as a min aggregation (combined before the shuffle) and a join back; no neighbourhood is collected. Rounds
    grow with the logarithm of the component's size. Tables are written to the shared folder after each round.
    Null ends and self-links are ignored; an empty table gives an empty one.
    """
    edges = links.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).where("u <> v")
    edges, mark = _fixed(edges)
    if not mark[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(limit):
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v")
        edges, now = _fixed(small)
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = now
    raise RuntimeError("components didn't settle")
