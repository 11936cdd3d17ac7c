"""python -m vertexloom.partition_cli --input GRAPH --nparts N [--output PATH]: balanced k-way parts, one a line in order of id."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vertexloom import sources
from vertexloom.operators import partition, topology


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vertexloom-partition")
    p.add_argument("--input", required=True, help=".gr, .sgr or .mtx path")
    p.add_argument("-n", "--nparts", type=int, required=True, help="number of parts")
    p.add_argument("-t", "--threads", default="*", help="local threads, where no cluster is configured")
    p.add_argument("-p", "--ptype", choices=("kway",), default="kway", help="the one kind of partition there is")
    p.add_argument("--rounds", type=int, default=8, help="rounds of refinement")
    p.add_argument("--slack", type=float, default=1.1, help="largest part, as a multiple of the mean")
    p.add_argument("--output", default="-", help="folder of text parts that the main command reads with -p; - prints the sizes")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.getActiveSession() or SparkSession.builder.appName("vertexloom-partition").config("spark.master", f"local[{a.threads}]").getOrCreate()
    graph = (sources.read_mtx if a.input.endswith(".mtx") else sources.read_gr)(spark, a.input)
    parts = partition.k_way(graph, a.nparts, a.rounds, a.slack)
    placed = parts.select("id", F.col("part").alias("master"), F.col("part").alias("mirror"))
    print("Cut edges:", topology.cut_edges(graph, placed).first()[0])
    if a.output == "-":
        parts.groupBy("part").agg(F.count("*").alias("vertices")).orderBy("part").show(a.nparts)
    else:
        sources.write_parts(placed, a.output)


if __name__ == "__main__":
    main()
