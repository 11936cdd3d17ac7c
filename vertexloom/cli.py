"""python -m vertexloom.cli -g GRAPH -a pr|sssp|cc: runs an algorithm on a graph file and writes (id, value)."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vertexloom import algorithms, sources
from vertexloom.operators import metrics, partition, topology


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vertexloom")
    p.add_argument("-g", "--graph", required=True, help=".gr, .sgr or .mtx path")
    p.add_argument("-a", "--algorithm", choices=("pr", "sssp", "cc"), default="pr")
    p.add_argument("-c", "--masters", type=int, default=1, help="master partitions")
    p.add_argument("-m", "--mirrors", type=int, default=1, help="mirror partitions")
    p.add_argument("-t", "--threads", default="*", help="local threads, where no cluster is configured")
    p.add_argument("-p", "--partitions", help="partition file for mirrors")
    p.add_argument("--source", type=int, default=0)
    p.add_argument("--max-iter", type=int, default=1000)
    p.add_argument("--tolerance", type=float, default=algorithms.programs.TOLERANCE)
    p.add_argument("--stats", help="folder for Parquet tables of the run: rounds and totals")
    p.add_argument("-o", "--output", help="folder for Parquet; by default the first rows are shown")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    builder = SparkSession.builder.appName("vertexloom")
    spark = SparkSession.getActiveSession() or builder.config("spark.master", f"local[{a.threads}]").getOrCreate()
    graph = (sources.read_mtx if a.graph.endswith(".mtx") else sources.read_gr)(spark, a.graph)
    if a.partitions and a.mirrors > 1:
        placed = partition.from_file(graph.vertices, sources.read_parts(spark, a.partitions), a.masters, a.mirrors)
    else:
        placed = partition.naive(graph.vertices, a.masters, a.mirrors)
    replication = topology.replication_factor(graph, placed)
    if a.algorithm == "pr":
        run, value = algorithms.pagerank(graph, a.max_iter, tolerance=a.tolerance), "rank"
    elif a.algorithm == "sssp":
        run, value = algorithms.shortest_paths(graph, a.source, max_iter=a.max_iter), "dist"
    else:
        run, value = algorithms.components(graph, max_iter=a.max_iter), "label"
    out = run.state.select("id", F.col(value))
    slots = graph.vertices.count()
    rounds = metrics.bytes_moved(run.stats_frame(), slots)
    total = metrics.run_stats(run.stats_frame(), slots, replication)
    row = total.first()
    print(f"Iterations: {run.iterations}\nTotalBytesMoved: {row['bytes']}\nMessages: {row['messages']}\nReplication Factor: {row['replication_factor']}")
    if a.stats:
        rounds.write.mode("overwrite").parquet(f"{a.stats}/rounds")
        total.write.mode("overwrite").parquet(f"{a.stats}/run")
    if a.output:
        out.write.mode("overwrite").parquet(a.output)
    else:
        out.orderBy("id").show()


if __name__ == "__main__":
    main()
