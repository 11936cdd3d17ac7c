"""Relations that a partitioned graph has: local ids, offsets, mirrors, cuts, coverage, translation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.ordered import running
from vertexloom.graph import Graph


def local_ids(assignment: DataFrame, side: str = "master") -> DataFrame:
    """(id, part, lid): dense position by ascending id inside its master or mirror."""
    return running(assignment.select("id", F.col(side).alias("part")), ["part"], ["id"]).select("id", "part", F.col("pos").alias("lid"))


def csr_offsets(graph: Graph, assignment: DataFrame) -> DataFrame:
    """(id, mirror, lid, degree, end_offset): each mirror's CSR end offsets in order of id."""
    rows = graph.out_degrees().join(assignment.select("id", "mirror"), "id")
    return running(rows, ["mirror"], ["id"], "degree").select("id", "mirror", F.col("pos").alias("lid"), "degree", F.col("cum").cast("long").alias("end_offset"))


def placed_edges(graph: Graph, assignment: DataFrame) -> DataFrame:
    """Edges with both ends' masters and mirrors."""
    at = lambda end: assignment.select(F.col("id").alias(end), F.col("master").alias(f"{end}_master"), F.col("mirror").alias(f"{end}_mirror"))
    return graph.edges.select("src", "dst").join(at("src"), "src").join(at("dst"), "dst")


def cross_mirrors(graph: Graph, assignment: DataFrame) -> DataFrame:
    """(mirror, id): vertices referenced from a mirror that isn't their home, each once."""
    return placed_edges(graph, assignment).where("src_mirror <> dst_mirror").select(F.col("src_mirror").alias("mirror"), F.col("dst").alias("id")).distinct()


def cut_edges(graph: Graph, assignment: DataFrame) -> DataFrame:
    """One row: edges whose ends are homed on different mirrors."""
    return placed_edges(graph, assignment).agg(F.count_if(F.col("src_mirror") != F.col("dst_mirror")).alias("cut_edges"))


def replication_factor(graph: Graph, assignment: DataFrame, distinct: bool = False) -> DataFrame:
    """One row: (x + V) / V with x the cut edges, or the distinct cross mirrors."""
    x = cross_mirrors(graph, assignment).agg(F.count("*").alias("x")) if distinct else cut_edges(graph, assignment).select(F.col("cut_edges").alias("x"))
    both = x.crossJoin(graph.vertices.agg(F.count("*").alias("v")))
    return both.select(((F.col("x") + F.col("v")) / F.nullif("v", F.lit(0))).cast("double").alias("replication_factor"))


def coverage(graph: Graph, assignment: DataFrame) -> DataFrame:
    """(id, covered): whether all out-neighbours share the vertex's master; true without any."""
    hit = placed_edges(graph, assignment).groupBy(F.col("src").alias("id")).agg(F.bool_and(F.col("src_master") == F.col("dst_master")).alias("c"))
    return graph.vertices.join(hit, "id", "left").select("id", F.coalesce("c", F.lit(True)).alias("covered"))


def all_covered(frontier: DataFrame, covered: DataFrame) -> DataFrame:
    """One row: whether every frontier vertex is covered."""
    return frontier.select("id").join(covered, "id").agg(F.coalesce(F.bool_and("covered"), F.lit(True)).alias("all_covered"))


def _slots(graph: Graph, assignment: DataFrame) -> DataFrame:
    """(master, mirror, is_cross, id): homed vertices and cross mirrors by owner and peer."""
    homed = assignment.select("master", "mirror", F.lit(0).alias("is_cross"), "id")
    crossed = cross_mirrors(graph, assignment).join(assignment.select("id", "master"), "id").select("master", "mirror", F.lit(1).alias("is_cross"), "id")
    return homed.unionByName(crossed)


def translation_sizes(graph: Graph, assignment: DataFrame) -> DataFrame:
    return _slots(graph, assignment).groupBy("master", "mirror").agg(F.count("*").alias("slots"))


def translation_table(graph: Graph, assignment: DataFrame) -> DataFrame:
    """(master, mirror, slot, id): homed vertices ascending, then cross mirrors ascending."""
    return running(_slots(graph, assignment), ["master", "mirror"], ["is_cross", "id"]).select("master", "mirror", F.col("pos").alias("slot"), "id")


def local_edges(graph: Graph, assignment: DataFrame) -> DataFrame:
    """(mirror, src, dst, dst_is_ghost): each mirror's own edges; ghosts are destinations homed elsewhere."""
    return placed_edges(graph, assignment).select(F.col("src_mirror").alias("mirror"), "src", "dst", (F.col("src_mirror") != F.col("dst_mirror")).alias("dst_is_ghost"))


def local_csr(graph: Graph, assignment: DataFrame) -> DataFrame:
    """(mirror, src_lid, dst_lid, dst_is_ghost): each mirror's edges in local ids: its own vertices by id from 0, then its ghosts,
    the destinations homed elsewhere, by id."""
    own = assignment.select("mirror", F.lit(0).alias("ghost"), "id")
    slots = own.unionByName(cross_mirrors(graph, assignment).select("mirror", F.lit(1).alias("ghost"), "id"))
    lids = running(slots, ["mirror"], ["ghost", "id"]).select("mirror", "id", "ghost", F.col("pos").alias("lid"))
    src = lids.where("ghost = 0").select(F.col("id").alias("src"), F.col("mirror"), F.col("lid").alias("src_lid"))
    dst = lids.select(F.col("id").alias("dst"), "mirror", F.col("lid").alias("dst_lid"), (F.col("ghost") == 1).alias("dst_is_ghost"))
    return graph.edges.select("src", "dst").join(src, "src").join(dst, ["mirror", "dst"]).select("mirror", "src_lid", "dst_lid", "dst_is_ghost")


def lookup(vertices: DataFrame, assignment: DataFrame, graph: Graph) -> DataFrame:
    """(id, master, mirror, degree) of the asked vertices."""
    return vertices.select("id").join(assignment, "id").join(graph.out_degrees(), "id")
