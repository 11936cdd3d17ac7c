"""The superstep engine: a driver loop in which every round is one Catalyst plan.

A round reads the checkpointed state once on each side of one exchange:

    state (hash id) --filter active--> join edges (hash src, cached) --> partial agg --exchange dst--> final agg
    state (hash id) --left join on id (already co-partitioned)--> apply --> reliable checkpoint

Only pre-aggregated messages cross the network. The count of active rows comes from an Observation on the rows being
checkpointed, so the test for convergence costs no job.

Out-edges of hubs (more than ``hub_degree`` of them) are kept apart and spread by both ends, so that a vertex with a third
of all edges isn't one task. The hubs' states are broadcast to them if, counted, they fit; else each hub's state goes to as many
salts as its edges are dealt to, by shuffle.

A round's checkpoint replaces the one before, which is deleted: storage holds two states, however many rounds there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from vertexloom.graph import Graph
from vertexloom.plans.placement import BROADCAST_BYTES, ROW_BYTES, choose_join
from vertexloom.session import cut_lineage, drop_checkpoint, settings

MAX_ROUNDS = 1000
EDGES_PER_PARTITION = 500_000
MAX_PARTITIONS = 20_000


@dataclass(frozen=True)
class VertexProgram:
    """A vertex program in Column expressions, evaluated inside generated code.

    ``init``: state columns (over id and degree), among them a boolean ``active``.
    ``message``: value that an active vertex sends along each out-edge (over state columns and weight).
    ``combine``: sum, min or max.
    ``apply``: from the combined message (null: none came) to the new state columns.
    """

    init: dict[str, Column]
    message: Column
    combine: str
    apply: Callable[[Column], dict[str, Column]]


@dataclass
class Result:
    """Final state, rounds run (the last, empty one included), and a row per round."""

    state: DataFrame
    iterations: int
    stats: list[dict] = field(default_factory=list)

    def stats_frame(self) -> DataFrame:
        return self.state.sparkSession.createDataFrame(
            [(s["iteration"], s["active"], s["messages"], s["strategy"]) for s in self.stats], "iteration long, active long, messages long, strategy string"
        )


COMBINE = {"sum": F.sum, "min": F.min, "max": F.max}


def run_vertex_program(
    graph: Graph, program: VertexProgram, max_iter: int = MAX_ROUNDS, partitions: int | None = None, hub_degree: int | None = None, join: str = "auto", hub_bytes: int = BROADCAST_BYTES
) -> Result:
    """Runs rounds until no vertex is active or ``max_iter`` rounds are done.

    ``partitions``: of state and edges; by default one per EDGES_PER_PARTITION edges.
    ``hub_degree``: out-degree from which a vertex's edges are spread; by default four partitions' worth of edges.
    ``hub_bytes``: up to this size the hubs' states are broadcast.
    ``join``: 'auto' (by the frontier's counted size), 'broadcast' (still size-checked) or 'shuffle'.
    """
    spark = graph.edges.sparkSession
    names = list(program.init)
    with settings(spark, spark__sql__adaptive__enabled="false"):
        degrees = cut_lineage(graph.out_degrees())
        sizes = degrees.agg(F.count("*").alias("v"), F.sum("degree").alias("e"), F.max("degree").alias("most")).first()
        n_v, n_e, most = sizes["v"], sizes["e"] or 0, sizes["most"] or 0
        n = partitions or max(1, min(MAX_PARTITIONS, math.ceil(max(n_v, n_e) / EDGES_PER_PARTITION)))
        hub = hub_degree or 4 * max(EDGES_PER_PARTITION, n_e // n)
        with settings(spark, spark__sql__shuffle__partitions=str(n)):
            carried = ["dst", *(["weight"] if "weight" in graph.edges.columns else [])]
            hubs = degrees.where(F.col("degree") > hub).select(F.col("id").alias("src")) if most > hub else None
            n_hubs = hubs.count() if hubs is not None else 0
            few = n_hubs * ROW_BYTES <= hub_bytes
            salts = 1 if few else max(2, min(n, math.ceil(most / EDGES_PER_PARTITION)))
            plain = graph.edges.select("src", *carried)
            spread = None
            if n_hubs:
                near = F.broadcast(hubs) if few else hubs
                spread = plain.join(near, "src", "left_semi")
                if few:
                    spread = spread.repartition(n, "src", "dst").persist()
                else:
                    spread = spread.withColumn("salt", F.pmod(F.xxhash64("dst"), F.lit(salts)).cast("int")).repartition(n, "src", "salt").persist()
                plain = plain.join(near, "src", "left_anti")
            plain = plain.repartition(n, "src").persist()

            def fixed(df: DataFrame) -> tuple[DataFrame, int, int]:
                seen = Observation()
                df = cut_lineage(df.observe(seen, F.count_if("active").alias("active"), F.sum(F.when(F.col("active"), F.col("degree"))).alias("messages")))
                got = seen.get
                return df, int(got["active"]), int(got["messages"] or 0)

            state, active, messages = fixed(degrees.select("id", "degree", *(c.alias(k) for k, c in program.init.items())).repartition(n, "id"))
            rounds, stats, strategy = 0, [], "shuffle"
            while rounds < max_iter:
                if join != "shuffle":
                    strategy = choose_join(active, n_v).strategy if join == "auto" else ("broadcast" if active * ROW_BYTES <= BROADCAST_BYTES else "shuffle")
                front = state.where("active").withColumnRenamed("id", "src")
                near = F.broadcast(front) if strategy == "broadcast" else front
                sent = plain.join(near, "src").select(F.col("dst").alias("id"), program.message.alias("m"))
                if spread is not None:
                    big, on = front.where(F.col("degree") > hub), ["src"]
                    if few:
                        big = F.broadcast(big)
                    else:
                        big, on = big.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["src", "salt"]
                    sent = sent.unionByName(spread.join(big, on).select(F.col("dst").alias("id"), program.message.alias("m")))
                msg = sent.groupBy("id").agg(COMBINE[program.combine]("m").alias("m"))
                new = program.apply(F.col("m"))
                before, (state, now, then) = state, fixed(state.join(msg, "id", "left").select("id", "degree", *(new.get(k, F.col(k)).alias(k) for k in names)))
                drop_checkpoint(before)
                stats.append({"iteration": rounds, "active": active, "messages": messages, "strategy": strategy})
                rounds, active, messages = rounds + 1, now, then
                if not active:
                    break
            plain.unpersist()
            if spread is not None:
                spread.unpersist()
    return Result(state, rounds, stats)
