"""Binary CSR graphs (.gr): little-endian u64 {version 1, edge-data size, V, E}, V u64 end offsets, E u32 destinations
(padded to 8 bytes), E u32 edge data."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions.ordered import running
from vertexloom.graph import Graph
from vertexloom.session import written

#: Bytes of a record, at most.
RECORD = 1 << 12


def _record_bytes(size: int) -> int:
    """The largest length up to RECORD that cuts a file of ``size`` bytes into equal records of whole words."""
    words = size // 4
    return 4 * max((k for k in range(1, min(RECORD // 4, words) + 1) if words % k == 0), default=1)


def _file_size(spark: SparkSession, path: str) -> int:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).getLen()


def read_gr(spark: SparkSession, path: str) -> Graph:
    """Reads a .gr file of any size in parallel: fixed-size records are split by Hadoop's input format, so no task and no
    row holds the file. Records are numbered by one counting pass and decoded by vectors; sources come from the end offsets.

    A file whose size has no large divisor falls back to short records, which takes longer.
    """
    size = _file_size(spark, path)
    if size % 4:
        raise ValueError("not a binary graph: it isn't made of 32-bit words")
    length = _record_bytes(size)
    records = spark.createDataFrame(spark.sparkContext.binaryRecords(path, length).zipWithIndex(), "b binary, i long")

    def decode(batches):
        for pdf in batches:
            if len(pdf):
                w = np.frombuffer(b"".join(pdf["b"]), dtype="<u4").astype(np.int64)
                yield pd.DataFrame({"i": np.repeat(pdf["i"].to_numpy() * (length // 4), length // 4) + np.tile(np.arange(length // 4), len(pdf)), "w": w})

    words = written(records.mapInPandas(decode, "i long, w long"), "words")
    head = [r["w"] for r in words.where("i < 8").orderBy("i").collect()]
    if len(head) < 8:
        raise ValueError("not a binary graph: the header is cut short")
    version, data, n_v, n_e = (head[k] | head[k + 1] << 32 for k in (0, 2, 4, 6))
    if version != 1 or data not in (0, 4):
        raise ValueError(f"version {version} with {data}-byte edge data isn't supported")
    at = 8 + 2 * n_v
    ends = words.where((F.col("i") >= 8) & (F.col("i") < at)).groupBy(F.floor((F.col("i") - 8) / 2).alias("id")).agg(F.sum(F.when(F.col("i") % 2 == 0, F.col("w")).otherwise(F.shiftleft("w", 32))).alias("end"))
    before = ends.select((F.col("id") + 1).alias("id"), F.col("end").alias("start"))
    spans = ends.join(before, "id", "left").select("id", F.coalesce("start", F.lit(0)).alias("start"), "end").where("end > start")
    src = spans.select(F.col("id").alias("src"), F.explode(F.sequence("start", F.col("end") - 1)).alias("e"))
    dst = words.where((F.col("i") >= at) & (F.col("i") < at + n_e)).select((F.col("i") - at).alias("e"), F.col("w").alias("dst"))
    edges = src.join(dst, "e")
    if data:
        first = at + n_e + n_e % 2
        edges = edges.join(words.where((F.col("i") >= first) & (F.col("i") < first + n_e)).select((F.col("i") - first).alias("e"), F.col("w").alias("weight")), "e")
    else:
        edges = edges.withColumn("weight", F.lit(None).cast("long"))
    return Graph(spark.range(n_v), edges.select("src", "dst", "weight"))


def _chunks(df: DataFrame, column: str, kind: str):
    """The column's values in order of pos as byte chunks, one per partition batch, streamed to the driver."""

    def pack(it):
        for pdf in it:
            yield pd.DataFrame({"first": [int(pdf["pos"].iloc[0])] if len(pdf) else [], "b": [pdf[column].to_numpy().astype(kind).tobytes()] if len(pdf) else []})

    packed = df.select("pos", column).sort("pos").mapInPandas(pack, "first long, b binary")
    for row in packed.toLocalIterator():
        yield bytes(row["b"])


def write_gr(graph: Graph, path: str) -> None:
    """One .gr file through Hadoop's file system (any store); chunks stream through the driver in order, a batch at a time."""
    spark = graph.edges.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    n = graph.counts().first()
    if n["vertices"] >= 2**32:
        raise ValueError("ids don't fit the format's 32 bits")
    weight = F.coalesce(F.col("weight"), F.lit(1)) if "weight" in graph.edges.columns else F.lit(1)
    degrees = running(graph.out_degrees(), [], ["id"], "degree")
    edges = running(graph.edges.select("src", "dst", weight.alias("weight")), [], ["src", "dst", "weight"]).persist()
    try:
        out.write(bytearray(struct.pack("<4Q", 1, 4, n["vertices"], n["edges"])))
        for b in _chunks(degrees, "cum", "<u8"):
            out.write(bytearray(b))
        for column in ("dst", "weight"):
            for b in _chunks(edges, column, "<u4"):
                out.write(bytearray(b))
            if n["edges"] % 2:
                out.write(bytearray(4))
    finally:
        out.close()
        edges.unpersist()


__all__ = ["read_gr", "write_gr"]
