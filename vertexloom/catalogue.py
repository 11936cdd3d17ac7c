"""The registered queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom import algorithms as alg
from vertexloom import sources
from vertexloom.fixtures import GRAPHS, SQL, VERTICES
from vertexloom.functions.ordered import running
from vertexloom.graph import Graph
from vertexloom.operators import logs, metrics, partition, topology, verify
from vertexloom.plans import placement
from vertexloom.session import shared_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Added before rounding: many ranks are short decimals that lie on a rounding tie, and engines break ties apart.
NUDGE = 1.234567e-9
PARTS = 3


def _near(column: str) -> F.Column:
    return F.round(F.col(column) + NUDGE, 6)


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def _with(graph: str, body: str, *more: str) -> str:
    """SQL with e(s, d), vt(id), deg(id, g) and asg(id, master, mirror) of a graph, and whatever more names."""
    ctes = [
        f"e as materialized (select s::bigint s, d::bigint d from ({SQL[graph]}))",
        f"vt as materialized ({VERTICES[graph]})",
        "deg as materialized (select vt.id, coalesce(c, 0)::bigint g from vt left join (select s, count(*) c from e group by s) on s = vt.id)",
        f"asg as materialized (select id, (id % {PARTS})::int master, (id % {PARTS})::int mirror from vt)",
        "pe as materialized (select s, d, a.master sm, a.mirror sr, b.master dm, b.mirror dr from e join asg a on a.id = s join asg b on b.id = d)",
        *more,
    ]
    return f"with recursive {', '.join(ctes)} {body}"


def _assigned(g: Graph) -> DataFrame:
    return partition.naive(g.vertices, PARTS, PARTS)


def _on(graph: str, make: Callable[[Graph], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(GRAPHS[graph](spark, sf_dir))


# --- edges, counts, degrees -------------------------------------------------------------------------------------------
for _g in ("hop", "trade", "session", "sparse"):
    _add(f"edges_{_g}", _on(_g, lambda g: g.edges.select("src", "dst")), _with(_g, "select s src, d dst from e"))
_add("graph_counts", _on("hop", Graph.counts), _with("hop", "select (select count(*) from vt) vertices, (select count(*) from e) edges"))
for _g in ("hop", "session"):
    _add(f"out_degree_{_g}", _on(_g, Graph.out_degrees), _with(_g, "select id, g degree from deg"))
_add(
    "max_frontier_degree",
    _on("hop", lambda g: g.out_degrees().where("degree > 0").agg(F.max("degree").alias("max_degree"), F.sum("degree").alias("total_degree"), F.floor(F.sum("degree") / 20).cast("long").alias("threshold"))),
    _with("hop", "select max(g) max_degree, sum(g)::bigint total_degree, (sum(g) // 20)::bigint threshold from deg where g > 0"),
)
_add("adjacency_sorted", _on("hop", lambda g: g.adjacency().select("id", F.concat_ws(" ", F.col("neighbours").cast("array<string>")).alias("neighbours"))), _with("hop", "select s id, string_agg(d::varchar, ' ' order by d) neighbours from e group by s"))
_add("adjacency_scan", _on("session", lambda g: g.adjacency().select("id", F.explode("neighbours").alias("dst"))), _with("session", "select s id, d dst from e"))
_add("symmetrize_sparse", _on("sparse", lambda g: g.symmetrize().edges), _with("sparse", "select s src, d dst from e union select d, s from e"))
_add("reverse_hop", _on("hop", lambda g: g.reverse().edges), _with("hop", "select d src, s dst from e"))

# --- partitions and derived relations ---------------------------------------------------------------------------------
_add("partition_naive", _on("hop", _assigned), _with("hop", "select id, master, mirror from asg"))
_add("partition_sizes", _on("hop", lambda g: partition.sizes(_assigned(g))), _with("hop", "select 'master' kind, master part, count(*) vertices from asg group by 2 union all select 'mirror', mirror, count(*) from asg group by 2"))
_add("partition_edges", _on("hop", lambda g: partition.edge_counts(g, _assigned(g))), _with("hop", "select mirror, sum(g)::bigint edges from deg join asg using (id) group by 1"))


def _file_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = GRAPHS["hop"](spark, sf_dir)
    path = shared_path(spark, "parts")
    own = g.vertices.select("id", F.pmod(F.floor(F.col("id") / 10), F.lit(4)).cast("int").alias("mirror"))
    sources.write_parts(own, path)
    return partition.from_file(g.vertices, sources.read_parts(spark, path), PARTS, 4)


_add("partition_file", _file_assigned, _with("hop", f"select id, (id % {PARTS})::int master, ((id // 10) % 4)::int mirror from vt"))


def _k_way(g: Graph) -> DataFrame:
    """Whether every vertex has a part, the largest part keeps the slack, and no more edges are cut than by id modulo."""
    parts = partition.k_way(g, PARTS)
    sizes = parts.where(f"part between 0 and {PARTS - 1}").groupBy("part").agg(F.count("*").alias("n")).agg(F.sum("n").alias("placed"), F.max("n").alias("most"))
    cut = topology.cut_edges(g, parts.select("id", F.col("part").alias("master"), F.col("part").alias("mirror")))
    naive = topology.cut_edges(g, _assigned(g)).withColumnRenamed("cut_edges", "naive")
    one = sizes.crossJoin(cut).crossJoin(naive).crossJoin(g.vertices.agg(F.count("*").alias("v"), F.countDistinct("id").alias("ids")))
    return one.select(F.expr("placed = v and ids = v").alias("all_placed"), (F.col("most") <= F.greatest(F.lit(1), F.floor(F.col("v") * 1.1 / PARTS))).alias("within_slack"), F.expr("cut_edges <= naive").alias("no_worse_than_naive"), F.col("v").cast("long").alias("vertices"))


_add("partition_k_way", _on("sparse", _k_way), _with("sparse", "select true all_placed, true within_slack, true no_worse_than_naive, count(*) vertices from vt"))
_add("local_ids", _on("hop", lambda g: topology.local_ids(_assigned(g))), _with("hop", "select id, master part, row_number() over (partition by master order by id) - 1 lid from asg"))
_add(
    "csr_offsets",
    _on("session", lambda g: topology.csr_offsets(g, _assigned(g))),
    _with("session", "select id, mirror, row_number() over w - 1 lid, g degree, (sum(g) over (partition by mirror order by id rows unbounded preceding))::bigint end_offset from deg join asg using (id) window w as (partition by mirror order by id)"),
)
_add("cross_mirrors", _on("hop", lambda g: topology.cross_mirrors(g, _assigned(g))), _with("hop", "select distinct sr mirror, d id from pe where sr <> dr"))
_add("cut_edges", _on("hop", lambda g: topology.cut_edges(g, _assigned(g))), _with("hop", "select count(*) filter (where sr <> dr) cut_edges from pe"))
_add("replication_factor", _on("hop", lambda g: topology.replication_factor(g, _assigned(g))), _with("hop", "select ((select count(*) from pe where sr <> dr) + count(*))::double / count(*) replication_factor from vt"))
_add("replication_factor_distinct", _on("hop", lambda g: topology.replication_factor(g, _assigned(g), distinct=True)), _with("hop", "select ((select count(*) from (select distinct sr, d from pe where sr <> dr)) + count(*))::double / count(*) replication_factor from vt"))
_COVER = "cov as materialized (select id, coalesce(c, true) covered from vt left join (select s, bool_and(sm = dm) c from pe group by s) on s = id)"
_add("coverage_intended", _on("sparse", lambda g: topology.coverage(g, _assigned(g))), _with("sparse", "select id, covered from cov", _COVER))
_add("coverage_check", _on("sparse", lambda g: topology.all_covered(g.vertices, topology.coverage(g, _assigned(g)))), _with("sparse", "select bool_and(covered) all_covered from cov", _COVER))
_SLOTS = "sl as materialized (select master, mirror, 0 x, id from asg union all select a.master, c.sr, 1, c.d from (select distinct sr, d from pe where sr <> dr) c join asg a on a.id = c.d)"
_add("translation_sizes", _on("hop", lambda g: topology.translation_sizes(g, _assigned(g))), _with("hop", "select master, mirror, count(*) slots from sl group by 1, 2", _SLOTS))
_add("translation_table", _on("hop", lambda g: topology.translation_table(g, _assigned(g))), _with("hop", "select master, mirror, row_number() over (partition by master, mirror order by x, id) - 1 slot, id from sl", _SLOTS))
_add("local_edges", _on("hop", lambda g: topology.local_edges(g, _assigned(g))), _with("hop", "select sr mirror, s src, d dst, sr <> dr dst_is_ghost from pe"))
_GHOSTS = """sl as materialized (select mirror, 0 ghost, id from asg union all select sr, 1, d from (select distinct sr, d from pe where sr <> dr)),
  lids as materialized (select mirror, ghost, id, row_number() over (partition by mirror order by ghost, id) - 1 lid from sl)"""
_add("local_csr", _on("hop", lambda g: topology.local_csr(g, _assigned(g))), _with("hop", "select sr mirror, a.lid src_lid, b.lid dst_lid, b.ghost = 1 dst_is_ghost from pe join lids a on a.mirror = sr and a.id = s and a.ghost = 0 join lids b on b.mirror = sr and b.id = d", _GHOSTS))
_add("vertex_lookup", _on("hop", lambda g: topology.lookup(g.vertices, _assigned(g), g)), _with("hop", "select id, master, mirror, g degree from asg join deg using (id)"))

# --- PageRank ---------------------------------------------------------------------------------------------------------


def _pr(limit: int) -> tuple[str, str]:
    return (
        "st0 as materialized (select id v, g, case when g > 0 then 0.15::double else 0::double end rank, 0::double res, case when g > 0 then 0.85::double * 0.15::double / g else 0::double end delta, g > 0 fr, 0 it from deg)",
        f"""st as (select * from st0 union all
          select v, g, rank + case when f then r else 0 end, case when f then 0 else r end, case when f and g > 0 then 0.85::double * r / g else 0 end, f, it + 1
          from (select st.v, st.g, st.rank, st.it, st.res + coalesce(m.m, 0) r, st.res + coalesce(m.m, 0) > 1e-6 f
                from st left join (select e.d, sum(p.delta) m from st p join e on p.v = e.s where p.fr group by e.d) m on m.d = st.v
                where exists (select 1 from st x where x.fr) and st.it < {limit})),
        fin as materialized (select * from st qualify it = max(it) over ())""",
    )


_R = f"round(rank + {NUDGE}, 6)"


def _ranks(graph: str, limit: int, make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(alg.pagerank(GRAPHS[graph](spark, sf_dir), max_iter=limit).state)


_add("pagerank_hop_10", _ranks("hop", 10, lambda s: s.select("id", _near("rank").alias("rank"))), _with("hop", f"select v id, {_R} rank from fin", *_pr(10)))
_add("pagerank_trade", _ranks("trade", 1000, lambda s: s.select("id", _near("rank").alias("rank"))), _with("trade", f"select v id, {_R} rank from fin", *_pr(1000)))
_add("pagerank_residuals_10", _ranks("hop", 10, lambda s: s.select("id", _near("residual").alias("residual"), "active")), _with("hop", f"select v id, round(res + {NUDGE}, 6) residual, fr active from fin", *_pr(10)))
_add("pagerank_top20", _ranks("hop", 10, lambda s: verify.top_ranks(s.select("id", _near("rank").alias("rank")))), _with("hop", f"select v id, {_R} rank from fin order by 2 desc, 1 limit 20", *_pr(10)))
_add("pagerank_top20_distinct", _ranks("trade", 1000, lambda s: verify.top_ranks(s.select("id", _near("rank").alias("rank")), one_per_rank=True)), _with("trade", f"select max(v) id, {_R} rank from fin group by 2 order by 2 desc, 1 limit 20", *_pr(1000)))

_F32 = (
    "st0 as materialized (select id v, g, (case when g > 0 then 0.15::double else 0::double end)::float rank, 0::float res, (case when g > 0 then 0.85::double * 0.15::double / g else 0::double end)::float delta, g > 0 fr, 0 it from deg)",
    """st as (select * from st0 union all
      select v, g, case when f then rank + r else rank end, case when f then 0::float else r end, (case when f and g > 0 then 0.85::double * r / g else 0::double end)::float, f, it + 1
      from (select st.v, st.g, st.rank, st.it, (st.res + coalesce(m.m, 0::double))::float r, (st.res + coalesce(m.m, 0::double))::float::double > 1e-6::double f
            from st left join (select e.d, sum(p.delta::double) m from st p join e on p.v = e.s where p.fr group by e.d) m on m.d = st.v
            where exists (select 1 from st x where x.fr) and st.it < 1000)),
    fin as materialized (select * from st qualify it = max(it) over ())""",
)
_add(
    "pagerank_single_precision",
    lambda spark, sf_dir: alg.pagerank(GRAPHS["trade"](spark, sf_dir), precision="float").state.select("id", F.round(F.col("rank").cast("double") + NUDGE, 5).alias("rank")),
    _with("trade", f"select v id, round(rank::double + {NUDGE}, 5) rank from fin", *_F32),
)

# --- distances --------------------------------------------------------------------------------------------------------
_DIST = """b(v, dist) using key (v) as (select 0::bigint, 0::bigint union (select e.d, min(b.dist + 1) from b join e on b.v = e.s
    left join recurring.b r on r.v = e.d where r.dist is null or r.dist > b.dist + 1 group by e.d)),
    ds as materialized (select id, dist from vt left join b on v = id)"""


def _dist(graph: str, make: Callable[[Graph, DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = GRAPHS[graph](spark, sf_dir)
        return make(g, alg.shortest_paths(g).state)

    return run


for _g in ("hop", "sparse"):
    _add(f"sssp_{_g}", _dist(_g, lambda g, s: s.select("id", "dist")), _with(_g, "select id, dist from ds", _DIST))
for _path in ("broadcast", "shuffle"):  # both ways of a round's traversal
    _add(f"sssp_{_path}_path", (lambda how: lambda spark, sf_dir: alg.shortest_paths(GRAPHS["hop"](spark, sf_dir), join=how).state.select("id", "dist"))(_path), _with("hop", "select id, dist from ds", _DIST))
_add("sssp_level_histogram", _dist("hop", lambda g, s: s.where("dist is not null").groupBy("dist").agg(F.count("*").alias("vertices"))), _with("hop", "select dist, count(*) vertices from ds where dist is not null group by 1", _DIST))
_add("sssp_stats", _dist("hop", lambda g, s: verify.distance_summary(s)), _with("hop", "select count(dist) visited, max(dist) max_dist from ds", _DIST))
_add("sssp_verify", _dist("hop", lambda g, s: verify.distance_errors(g.edges, s)), _with("hop", "select count(*) filter (where b.dist is null or b.dist > a.dist + 1) errors from e join ds a on a.id = s join ds b on b.id = d where a.dist is not null", _DIST))

# --- components and labels --------------------------------------------------------------------------------------------


def _lab(direction: str, pick: str, worse: str) -> str:
    pairs = "select s, d from e union select d, s from e" if direction == "both" else "select s, d from e"
    return f"""sy as materialized ({pairs}), b(v, l) using key (v) as (select id, id from vt union (select sy.d, {pick}(b.l) from b join sy on b.v = sy.s
    join recurring.b r on r.v = sy.d where r.l {worse} b.l group by sy.d))"""


def _label(graph: str, how: Callable[[Graph], DataFrame], make: Callable[[Graph, DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = GRAPHS[graph](spark, sf_dir)
        return make(g, how(g))

    return run


_cc = lambda g: alg.components(g).state
_add("cc_sparse", _label("sparse", _cc, lambda g, s: s.select("id", F.col("label").alias("component"))), _with("sparse", "select v id, l component from b", _lab("both", "min", ">")))
_add("cc_directed_sparse", _label("sparse", lambda g: alg.components(g, symmetrize=False).state, lambda g, s: s.select("id", F.col("label").alias("component"))), _with("sparse", "select v id, l component from b", _lab("one", "min", ">")))
_add("cc_component_sizes", _label("sparse", _cc, lambda g, s: s.groupBy(F.col("label").alias("component")).agg(F.count("*").alias("vertices"))), _with("sparse", "select l component, count(*) vertices from b group by 1", _lab("both", "min", ">")))
_add("cc_verify", _label("sparse", _cc, lambda g, s: verify.component_errors(g.symmetrize().edges, s)), _with("sparse", "select count(*) filter (where x.l <> y.l) errors from sy join b x on x.v = s join b y on y.v = d", _lab("both", "min", ">")))
_add("max_label_sparse", _label("sparse", lambda g: alg.max_label(g).state, lambda g, s: s.select("id", "label")), _with("sparse", "select v id, l \"label\" from b", _lab("one", "max", "<")))

# --- rounds, message volume, placement --------------------------------------------------------------------------------
_add(
    "frontier_sizes_sssp",
    lambda spark, sf_dir: alg.shortest_paths(GRAPHS["hop"](spark, sf_dir)).stats_frame().select("iteration", "active"),
    _with("hop", "select dist iteration, count(*) active from ds where dist is not null group by 1", _DIST),
)
_add(
    "frontier_sizes_cc",
    lambda spark, sf_dir: alg.components(GRAPHS["sparse"](spark, sf_dir)).stats_frame().select("iteration", "active"),
    _with(
        "sparse", "select it as iteration, count(*) filter (where fr) active from st group by 1 having count(*) filter (where fr) > 0",
        "sy as materialized (select s, d from e union select d, s from e)",
        """st as (select id v, id l, true fr, 0::bigint it from vt union all
          select v, case when f then m else l end, f, it + 1 from (select st.v, st.l, st.it, m.m, coalesce(m.m < st.l, false) f
            from st left join (select sy.d, min(p.l) m from st p join sy on p.v = sy.s where p.fr group by sy.d) m on m.d = st.v where exists (select 1 from st x where x.fr)))""",
    ),
)


def _volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = GRAPHS["hop"](spark, sf_dir)
    return metrics.bytes_moved(alg.shortest_paths(g).stats_frame(), g.vertices.count()).select("iteration", "active", "messages", "bytes")


def _run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = GRAPHS["hop"](spark, sf_dir)
    return metrics.run_stats(alg.shortest_paths(g).stats_frame(), g.vertices.count(), topology.replication_factor(g, _assigned(g)))


_ROUNDS = "rd as materialized (select dist, count(*) active, sum(g)::bigint messages, ((select count(*) from vt) + 63) // 64 * 8 + count(*) * 8 bytes from ds join deg using (id) where dist is not null group by 1)"
_add(
    "run_stats",
    _run_stats,
    _with("hop", "select count(*) iterations, sum(messages)::bigint messages, sum(bytes)::bigint bytes, (select ((select count(*) from pe where sr <> dr) + count(*))::double / count(*) from vt) replication_factor from rd", _DIST, _ROUNDS),
)
_add("bytes_moved_model", _volume, _with("hop", "select dist iteration, active, messages, bytes::bigint bytes from rd", _DIST, _ROUNDS))


def _offload(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = GRAPHS["sparse"](spark, sf_dir)
    asg = _assigned(g)
    state = alg.shortest_paths(g).state.select("id", F.col("dist").isNotNull().alias("active"))
    return placement.offload_decision(state, topology.coverage(g, asg), asg.select("id", "mirror"))


_add(
    "offload_decision",
    _offload,
    _with(
        "sparse",
        """select f frontier, t threshold, u uncovered, most, mean::bigint mean, case when f = 0 or f > t or u > 0 or most < mean then 'offload' else 'local' end decision from (
          select (select count(*) from fr) f, ((select count(*) from vt) // 20)::bigint t, (select count(*) from fr join cov using (id) where not covered) u,
          (select coalesce(max(n), 0) from tn) most, (select coalesce(sum(n) // nullif(count(*), 0), 0) from tn) mean)""",
        _DIST, _COVER,
        "fr as materialized (select id from ds where dist is not null)",
        "tn as materialized (select mirror, count(*) n from fr join asg using (id) group by 1)",
    ),
)


def _cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = GRAPHS["sparse"](spark, sf_dir)
    state = alg.shortest_paths(g).state.select("id", F.col("dist").isNotNull().alias("active"))
    return placement.frontier_cost(state, g.out_degrees())


_add("frontier_cost", _cost, _with("sparse", "select count(*) frontier, coalesce(sum(g), 0)::bigint out_edges, (count(*) + coalesce(sum(g), 0))::bigint as cost from ds join deg using (id) where dist is not null", _DIST))

# --- logs -------------------------------------------------------------------------------------------------------------


def _log(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    """A drawn run log from the orders table: a marker every 50 lines, then vertex lines; the first lines stand before any marker."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    line = F.concat(F.lit("Vertex "), F.col("o_custkey"), F.lit(": "), F.floor(F.col("o_totalprice")).cast("long"), F.lit(".5/0.02"), F.pmod(F.col("o_orderkey") * shift, F.lit(7)), F.lit("0"))
    mark = F.concat(F.lit("[Proc 0] Iteration: "), F.floor(F.col("o_orderkey") / 50).cast("long"), F.lit(", WCC: 1"))
    return o.select((F.col("o_orderkey") + 1).alias("line_no"), F.when(F.col("o_orderkey") % 50 == 25, mark).otherwise(line).alias("line"))


def _other_log(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    """The same run as the other system logs it: any blanks, and a clock before a line; the log ends 30 keys early, and every
    eleventh line is of another vertex."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    last = o.agg((F.max("o_orderkey") - 30).alias("last"))
    vertex = F.col("o_custkey") + (F.col("o_orderkey") % 11 == 0).cast("int")
    line = F.concat(F.lit("12:00\t"), vertex, F.lit(" \t"), F.floor(F.col("o_totalprice")).cast("long"), F.lit(".5  0.02"), F.pmod(F.col("o_orderkey") * shift, F.lit(7)), F.lit("0 "))
    mark = F.concat(F.lit("12:00 [Leader] Iteration "), F.floor(F.col("o_orderkey") / 50).cast("long"), F.lit(" complete"))
    return o.join(F.broadcast(last), F.col("o_orderkey") <= F.col("last")).select((F.col("o_orderkey") + 1).alias("line_no"), F.when(F.col("o_orderkey") % 50 == 25, mark).otherwise(line).alias("line"))


def _read_other(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    return logs.extract(_other_log(spark, sf_dir, shift), logs.OTHER_MARK, logs.OTHER_LINE)


_COLUMNS = ("line_no", "iteration", "vertex", "rank", "residual")
_add("log_extract", lambda spark, sf_dir: logs.extract(_log(spark, sf_dir, 1)).select(*_COLUMNS))
_add("log_extract_other", lambda spark, sf_dir: _read_other(spark, sf_dir, 2).select(*_COLUMNS))
_add("log_diff", lambda spark, sf_dir: logs.compare(logs.extract(_log(spark, sf_dir, 1)), logs.extract(_log(spark, sf_dir, 2))))
_add("log_diff_unequal", lambda spark, sf_dir: logs.compare(logs.extract(_log(spark, sf_dir, 1)), _read_other(spark, sf_dir, 2)))
_RAW = """lg as materialized (select o_orderkey + 1 line_no, o_orderkey k, o_custkey c, floor(o_totalprice) p, (select max(o_orderkey) - 30 from orders) z from orders),
  fl as materialized (select *, coalesce(last_value(case when k % 50 = 25 then k // 50 end ignore nulls) over (order by line_no), 0) i from lg),
  la as materialized (select line_no, i, c v, p, (k % 7) m, row_number() over (order by line_no) pl from fl where k % 50 <> 25),
  lb as materialized (select line_no, i, c v, p, (k * 2 % 7) m, row_number() over (order by line_no) pl from fl where k % 50 <> 25),
  lo as materialized (select line_no, i, c + (k % 11 = 0)::int v, p, (k * 2 % 7) m, row_number() over (order by line_no) pl from fl where k % 50 <> 25 and k <= z)"""


def _read_sql(log: str) -> str:
    return f"with {_RAW} select line_no, i as iteration, v::bigint vertex, round(p + 0.5, 4)::double rank, ('0.02' || m || '0')::double residual from {log}"


def _diff_sql(a: str, b: str) -> str:
    return f"""with {_RAW}, x as (select a.i i1, b.i i2, a.v v1, b.v v2, a.m m1, b.m m2, a.pl p1, b.pl p2, coalesce(a.i = b.i and a.v = b.v, false) same from {a} a full join {b} b on a.pl = b.pl)
      select case when p1 is null then i2 else i1 end as iteration, (case when p1 is null then v2 else v1 end)::bigint vertex, ('0.02' || m1 || '0')::double r1, ('0.02' || m2 || '0')::double r2,
        case when same then round(abs(m1 - m2) / 1000.0, 4)::double end diff, case when same then 'diff' else 'mismatch' end status from x where not same or abs(m1 - m2) > 1"""


ORACLE["log_extract"], ORACLE["log_extract_other"] = _read_sql("la"), _read_sql("lo")
ORACLE["log_diff"], ORACLE["log_diff_unequal"] = _diff_sql("la", "lb"), _diff_sql("la", "lo")


# --- sources and sinks ------------------------------------------------------------------------------------------------
def _mtx(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "mtx")
    sources.write_mtx(GRAPHS["hop"](spark, sf_dir), path)
    return sources.read_mtx(spark, path).edges.select("src", "dst")


def _gr(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "gr")
    sources.write_gr(GRAPHS["session"](spark, sf_dir), path)
    return sources.read_gr(spark, path).edges.select("src", "dst")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "parts")
    sources.write_parts(_assigned(GRAPHS["hop"](spark, sf_dir)), path)
    return sources.read_parts(spark, path)


_add("mtx_roundtrip", _mtx, _with("hop", "select s src, d dst from e"))
_add("gr_roundtrip", _gr, _with("session", "select s src, d dst from e"))
_add("parts_roundtrip", _parts, _with("hop", "select id, mirror part from asg"))
_add("joined_text", _on("hop", lambda g: metrics.joined_text(_assigned(g).groupBy("mirror").agg(F.count("*").alias("n")), "n", ["mirror"])), _with("hop", "select string_agg(n::varchar, ' ' order by mirror) as \"text\" from (select mirror, count(*) n from asg group by 1)"))
_add("running_positions", _on("hop", lambda g: running(g.edges, [], ["src", "dst"]).select("src", "dst", "pos")), _with("hop", "select s src, d dst, row_number() over (order by s, d) - 1 pos from e"))
