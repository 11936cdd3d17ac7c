"""Matrix Market and partition files, read and written by Spark's own text sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions.ordered import running
from vertexloom.graph import Graph


def read_mtx(spark: SparkSession, path: str) -> Graph:
    """A coordinate Matrix Market file: 1-based ids; a 'symmetric' header implies the mirrored edges; 'pattern' has no weights.

    Only the first lines (header, comments, sizes) are taken to the driver; entries are parsed in parallel.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = spark.read.text(path).select(F.trim("value").alias("value"), place.alias("place")).where("value <> ''")
    head = lines.where(F.lower(F.col("value")).startswith("%%matrixmarket")).select("value", "place.file").first()
    if head is None:
        raise ValueError("no Matrix Market header")
    symmetric = "symmetric" in head["value"].lower()
    rows = lines.where(~F.col("value").startswith("%"))
    # parts are not read in order; the size line is the first row that isn't a comment, in the file with the header
    size = rows.where(F.col("place.file") == head["file"]).agg(F.min(F.struct("place", "value")).alias("m")).first()["m"]
    if size is None:
        raise ValueError("no size line")
    shape = [int(x) for x in size["value"].split()[:3]]
    part = F.split("value", r"\s+")
    where = size["place"]
    entries = rows.where(~((F.col("place.file") == where["file"]) & (F.col("place.block") == where["block"]) & (F.col("place.at") == where["at"])))
    entries = entries.select((part[0].cast("long") - 1).alias("src"), (part[1].cast("long") - 1).alias("dst"), F.try_element_at(part, F.lit(3)).try_cast("double").cast("long").alias("weight"))
    if symmetric:
        turned = entries.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        entries = entries.unionByName(turned)
    return Graph(spark.range(max(shape[0], shape[1])), entries)


def write_mtx(graph: Graph, path: str) -> None:
    """A folder of text parts that ``read_mtx`` reads: part order keeps the header first."""
    n = graph.counts().first()
    spark = graph.edges.sparkSession
    weighted = "weight" in graph.edges.columns
    kind = "integer" if weighted else "pattern"
    head = spark.createDataFrame([(f"%%MatrixMarket matrix coordinate {kind} general\n{n['vertices']} {n['vertices']} {n['edges']}",)], "value string").coalesce(1)
    cols = [(F.col("src") + 1).cast("string"), (F.col("dst") + 1).cast("string")] + ([F.coalesce(F.col("weight"), F.lit(1)).cast("string")] if weighted else [])
    head.unionByName(graph.edges.select(F.concat_ws(" ", *cols).alias("value"))).write.mode("overwrite").text(path)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """(id, part): line i is the part of vertex i. Raises on an unreadable path. Lines count in order of file, block
    and line."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    placed = running(lines, [], ["file", "block", "at"])
    return placed.select(F.col("pos").alias("id"), F.trim("value").cast("int").alias("part"))


def write_parts(assignment: DataFrame, path: str, column: str = "mirror") -> None:
    """One part a line in order of id, as range-sorted text parts in one folder (part order is line order)."""
    ordered = running(assignment.select("id", column), [], ["id"])
    ordered.sort("pos").select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)
