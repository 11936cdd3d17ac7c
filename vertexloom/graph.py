"""The graph: a vertex table (id) and an edge table (src, dst, optional weight)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """Immutable directed multigraph.

    ``vertices`` lists every id, isolated ones included; ``edges`` may hold repeats and self-loops.
    Edges with a null end are not edges and are dropped by ``from_edges``.
    """

    vertices: DataFrame
    edges: DataFrame

    @staticmethod
    def from_edges(edges: DataFrame, vertices: DataFrame | None = None, n: int | None = None) -> Graph:
        """Vertices: the given table, or 0..n-1, or the distinct ends of the edges."""
        edges = edges.select(
            F.col("src").cast("long").alias("src"),
            F.col("dst").cast("long").alias("dst"),
            *([F.col("weight").cast("long").alias("weight")] if "weight" in edges.columns else []),
        ).where("src is not null and dst is not null")
        if vertices is None:
            if n is not None:
                vertices = edges.sparkSession.range(n)
            else:
                vertices = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        return Graph(vertices.select(F.col("id").cast("long").alias("id")), edges)

    def reverse(self) -> Graph:
        swap = {"src": "dst", "dst": "src"}
        return Graph(self.vertices, self.edges.select(*(F.col(swap.get(c, c)).alias(c) for c in self.edges.columns)))

    def symmetrize(self) -> Graph:
        """Both directions of every edge, each pair once, without weights."""
        pair = self.edges.select("src", "dst")
        both = pair.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e"))
        return Graph(self.vertices, both.select("e.src", "e.dst").distinct())

    def out_degrees(self) -> DataFrame:
        """(id, degree): out-edges with multiplicity and self-loops; 0 for sinks."""
        counts = self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
        return self.vertices.join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    def counts(self) -> DataFrame:
        """One row: vertices, edges."""
        return self.vertices.agg(F.count("*").alias("vertices")).crossJoin(self.edges.agg(F.count("*").alias("edges")))

    def adjacency(self) -> DataFrame:
        """(id, neighbours): sorted out-neighbours with multiplicity, sinks left out."""
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))
