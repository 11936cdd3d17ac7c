"""Sources round trip, partition checks, logs, and every registered query against its SQL at the smallest size."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import oracle_check
from vertexloom import Graph, catalogue, sources
from vertexloom.functions.ordered import next_in_order, running
from vertexloom.operators import logs, partition


@pytest.mark.parametrize("name", ["edges_sparse", "out_degree_session", "csr_offsets", "translation_table", "offload_decision", "log_extract", "log_extract_other", "log_diff", "log_diff_unequal", "run_stats", "bytes_moved_model", "local_csr", "partition_k_way", "pagerank_single_precision", "gr_roundtrip", "parts_roundtrip", "sssp_broadcast_path", "sssp_shuffle_path", "pagerank_top20", "cc_sparse", "frontier_sizes_cc"])
def test_against_sql(spark, sf_dir, name):
    said, ok = oracle_check.compare(spark, sf_dir, name, oracle_check.connect(sf_dir))
    assert ok, said


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 20 and rows[0]["id"] == 15
    assert set(catalogue.ORACLE) <= set(catalogue.QUERIES)


def test_running_null_groups_and_empty(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, None), ("a", 1, 2), ("a", 3, 4), ("a", 2, 1)], "g string, k int, v int")
    got = {(r["g"], r["k"]): (r["pos"], r["cum"]) for r in running(df, ["g"], ["k"], "v").collect()}
    assert got == {(None, 1): (0, 5), (None, 2): (1, 5), ("a", 1): (0, 2), ("a", 2): (1, 3), ("a", 3): (2, 7)}
    assert running(df.where("false"), ["g"], ["k"], "v").count() == 0
    after = {r["k"]: r["next"] for r in next_in_order(df.where("g = 'a'"), "v", ["k"]).collect()}
    assert after == {1: 1, 2: 4, 3: None}


def test_sources(spark, tmp_path):
    g = Graph.from_edges(spark.createDataFrame([(0, 1, 7), (1, 2, 8), (2, 2, 9)], "src long, dst long, weight long"), n=5)
    sources.write_gr(g, f"{tmp_path}/g.gr")
    back = sources.read_gr(spark, f"{tmp_path}/g.gr")
    assert sorted(map(tuple, back.edges.collect())) == [(0, 1, 7), (1, 2, 8), (2, 2, 9)]
    assert back.vertices.count() == 5
    (tmp_path / "s.mtx").write_text("%%MatrixMarket matrix coordinate pattern symmetric\n% note\n3 3 2\n2 1\n3 3\n")
    assert sorted(map(tuple, sources.read_mtx(spark, f"{tmp_path}/s.mtx").edges.select("src", "dst").collect())) == [(0, 1), (1, 0), (2, 2)]
    sources.write_parts(partition.naive(g.vertices, 2, 2), f"{tmp_path}/parts")
    assert sorted(map(tuple, sources.read_parts(spark, f"{tmp_path}/parts").collect())) == [(0, 0), (1, 1), (2, 0), (3, 1), (4, 0)]
    short = spark.createDataFrame([(0, 1)], "id long, part int")
    with pytest.raises(ValueError):
        partition.from_file(g.vertices, short, 2, 2)


def test_log_mismatch(spark):
    mine = [(1, "[Proc 0] Iteration: 0, WCC: 2"), (2, "Vertex 1: 0.5/0.1"), (3, "Vertex 2: 0.5/0.2")]
    other = [(1, "[Proc 0] Iteration: 0, WCC: 2"), (2, "Vertex 1: 0.5/0.2"), (3, "Vertex 9: 0.5/0.2")]
    side = lambda rows: logs.extract(spark.createDataFrame(rows, "line_no long, line string"))
    got = {(r["vertex"], r["status"]) for r in logs.compare(side(mine), side(other)).collect()}
    assert got == {(1, "diff"), (2, "mismatch")}
    longer = [*mine, (4, "Vertex 3: 0.5/0.0210")]
    assert [tuple(r) for r in logs.compare(side(longer), side(mine)).collect()] == [(0, 3, 0.021, None, None, "mismatch")]
    assert [r["status"] for r in logs.compare(side(mine), side(longer)).collect()] == ["mismatch"]
    near = [*mine, (4, "Vertex 3: 0.5/0.0200")]
    assert logs.compare(side(longer), side(near)).count() == 0  # exactly the tolerance
    assert side([(1, "Vertex 7: 1.0/2.5e-05")]).first()["iteration"] == 0
    assert logs.compare(side([(1, "x")]), side([(1, "x")])).count() == 0


def test_other_format(spark):
    rows = [(1, "12:00 7\t0.5 0.25"), (2, "[Leader] Iteration 3 complete"), (3, " 7 0.5  0.25"), (4, "8 0.5 0.25"), (5, "8 0.5")]
    got = logs.extract(spark.createDataFrame(rows, "line_no long, line string"), logs.OTHER_MARK, logs.OTHER_LINE)
    assert sorted((r["line_no"], r["iteration"], r["vertex"], r["residual"]) for r in got.collect()) == [(1, 0, 7, 0.25), (3, 3, 7, 0.25), (4, 3, 8, 0.25)]


def test_offload_rule(spark):
    from vertexloom.plans import placement

    def decide(active, covered=True, n=100):
        state = spark.range(n).select("id", F.col("id").isin(active).alias("active"))
        cover = spark.range(n).select("id", F.lit(covered).alias("covered"))
        return tuple(placement.offload_decision(state, cover, spark.range(n).select("id", (F.col("id") % 3).alias("mirror"))).first())

    assert decide([]) == (0, 5, 0, 0, 0, "offload")
    assert decide([0, 3, 1]) == (3, 5, 0, 2, 1, "local")
    assert decide([0, 3, 1], covered=False)[-1] == "offload"
    assert decide(list(range(6)))[-1] == "offload"


def test_storage(spark, tmp_path):
    """A run leaves one state behind; intermediate tables can be released; a cluster needs a shared folder."""
    import os
    from types import SimpleNamespace
    from urllib.parse import urlparse

    from vertexloom import algorithms, session

    g = Graph.from_edges(spark.range(30).select(F.col("id").alias("src"), ((F.col("id") + 1) % 30).alias("dst")), n=30)
    spark.sparkContext._jvm.System.gc()
    folder = urlparse(spark.sparkContext.getCheckpointDir()).path
    before = len(os.listdir(folder))
    run = algorithms.shortest_paths(g)
    assert run.iterations == 30 and run.state.count() == 30 and len(os.listdir(folder)) - before <= 4
    kept = session.written(spark.range(5).toDF("x"), "kept")
    path = session._PATHS[-1]
    session.delete(spark, path)
    with pytest.raises(Exception):
        kept.count()
    session._PATHS.remove(path)
    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        session.shared_dir(far)


def test_partition_command(spark, tmp_path, capsys):
    from vertexloom import partition_cli

    g = Graph.from_edges(spark.range(40).select(F.col("id").alias("src"), ((F.col("id") + 1) % 40).alias("dst")), n=40)
    sources.write_gr(g, f"{tmp_path}/g.gr")
    partition_cli.main(["--input", f"{tmp_path}/g.gr", "-n", "4", "--output", f"{tmp_path}/parts"])
    rows = sources.read_parts(spark, f"{tmp_path}/parts").collect()
    assert sorted(r["id"] for r in rows) == list(range(40)) and {r["part"] for r in rows} == {0, 1, 2, 3}
    assert "Cut edges:" in capsys.readouterr().out


def test_user_program(spark):
    """A program of one's own: the largest weight on any path of at most two steps, with in-degrees as a check of sums."""
    from vertexloom import VertexProgram, run_vertex_program

    g = Graph.from_edges(spark.createDataFrame([(0, 1, 5), (1, 2, 7), (0, 2, 1)], "src long, dst long, weight long"), n=3)
    count = VertexProgram(
        init={"seen": F.lit(0).cast("long"), "active": F.col("degree") > 0}, message=F.col("weight"), combine="sum",
        apply=lambda m: {"seen": F.col("seen") + F.coalesce(m, F.lit(0)), "active": F.lit(False)},
    )
    run = run_vertex_program(g, count)
    assert {r["id"]: r["seen"] for r in run.state.collect()} == {0: 0, 1: 5, 2: 8} and run.iterations == 1
    assert [(s["active"], s["messages"]) for s in run.stats] == [(2, 3)]


def test_k_way_balance(spark):
    g = Graph.from_edges(spark.range(40).select(F.col("id").alias("src"), ((F.col("id") + 1) % 40).alias("dst")), n=40)
    sizes = [r["count"] for r in partition.k_way(g, 4, rounds=2).groupBy("part").count().collect()]
    assert sum(sizes) == 40 and max(sizes) <= 22


def test_cli(spark, tmp_path, capsys):
    from vertexloom import cli

    sources.write_gr(Graph.from_edges(spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long"), n=4), f"{tmp_path}/g.gr")
    cli.main(["-g", f"{tmp_path}/g.gr", "-a", "sssp", "-c", "2", "-m", "2", "-o", f"{tmp_path}/out", "--stats", f"{tmp_path}/stats"])
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == [(0, 0), (1, 1), (2, 2), (3, None)]
    said = capsys.readouterr().out
    assert "Iterations: 3" in said and "TotalBytesMoved: 48" in said and "Replication Factor: 1.5" in said
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/stats/run").select("iterations", "messages", "bytes").collect()] == [(3, 2, 48)]
    assert spark.read.parquet(f"{tmp_path}/stats/rounds").count() == 3
    with pytest.raises(SystemExit):
        cli.main(["-a", "pr"])


def test_follow_log(spark):
    from vertexloom.streaming import follow_log

    lines = spark.createDataFrame([("Vertex 3: 0.5/0.25",), ("noise",)], "value string")
    assert list(map(tuple, follow_log(lines).collect())) == [(3, 0.5, 0.25)]
