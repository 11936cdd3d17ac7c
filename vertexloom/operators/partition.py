"""Vertex partitioners: assignment(id, master, mirror)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.graph import Graph


def naive(vertices: DataFrame, masters: int, mirrors: int) -> DataFrame:
    """Both by id modulo; a projection, without a shuffle."""
    return vertices.select("id", F.pmod("id", F.lit(masters)).cast("int").alias("master"), F.pmod("id", F.lit(mirrors)).cast("int").alias("mirror"))


def from_file(vertices: DataFrame, parts: DataFrame, masters: int, mirrors: int) -> DataFrame:
    """Mirror from a partition table (id, part), master by id modulo; with one mirror it is ``naive``.

    Raises if a vertex has no part or a part outside 0..mirrors-1.
    """
    if mirrors == 1:
        return naive(vertices, masters, 1)
    joined = vertices.join(parts, "id", "left")
    bad = joined.where(F.col("part").isNull() | (F.col("part") < 0) | (F.col("part") >= mirrors)).limit(1).count()
    if bad:
        raise ValueError("the partition file leaves out a vertex or names a part that isn't there")
    return joined.select("id", F.pmod("id", F.lit(masters)).cast("int").alias("master"), F.col("part").cast("int").alias("mirror"))


def sizes(assignment: DataFrame) -> DataFrame:
    """(kind, part, vertices) of masters and mirrors in one pass."""
    both = assignment.select(F.explode(F.array(F.struct(F.lit("master").alias("kind"), F.col("master").alias("part")), F.struct(F.lit("mirror").alias("kind"), F.col("mirror").alias("part")))).alias("p"))
    return both.groupBy("p.kind", "p.part").agg(F.count("*").alias("vertices"))


def edge_counts(graph: Graph, assignment: DataFrame) -> DataFrame:
    """(mirror, edges): summed out-degree per mirror."""
    return graph.out_degrees().join(assignment, "id").groupBy("mirror").agg(F.sum("degree").cast("long").alias("edges"))


def k_way(graph: Graph, parts: int, rounds: int = 8, slack: float = 1.1) -> DataFrame:
    """(id, part): balanced k-way labels by capacity-limited label propagation (an extension; contract: balance).

    Starts from contiguous id blocks. In a round a vertex asks for its neighbours' most common part if that is better than
    its own; a part admits askers, best gain first, up to ``slack`` times the mean size. Requests are ranked by
    ``functions.ordered.running``, so a part isn't one task.
    """
    from vertexloom.functions.ordered import running
    from vertexloom.session import cut_lineage

    n = graph.vertices.count()
    cap = max(1, int(slack * n / parts))
    pairs = graph.symmetrize().edges.persist()
    at = cut_lineage(running(graph.vertices, [], ["id"]).select("id", F.floor(F.col("pos") * parts / max(n, 1)).cast("int").alias("part")))
    for _ in range(rounds):
        votes = pairs.join(at.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "part").agg(F.count("*").alias("n"))
        best = votes.groupBy("id").agg(F.max(F.struct("n", (-F.col("part")).alias("minus"))).alias("b")).select("id", F.col("b.n").alias("n"), (-F.col("b.minus")).alias("to"))
        own = votes.withColumnsRenamed({"n": "had"})
        asks = best.join(at, "id").join(own, ["id", "part"], "left").withColumn("gain", F.col("n") - F.coalesce("had", F.lit(0))).where((F.col("to") != F.col("part")) & (F.col("gain") > 0)).select("id", "to", (-F.col("gain")).alias("loss"))
        room = at.groupBy(F.col("part").alias("to")).agg((F.lit(cap) - F.count("*")).alias("room"))
        moved = running(asks, ["to"], ["loss", "id"]).join(room, "to").where("pos < room").select("id", "to")
        new = cut_lineage(at.join(moved, "id", "left").select("id", F.coalesce("to", "part").alias("part"), F.col("to").isNotNull().alias("moved")))
        at = new.select("id", "part")
        if not new.where("moved").limit(1).count():
            break
    pairs.unpersist()
    return at
