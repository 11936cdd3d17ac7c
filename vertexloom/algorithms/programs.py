"""The vertex programs: residual PageRank, hop distances, connected components, largest reaching label."""

from __future__ import annotations

from pyspark.sql import functions as F

from vertexloom.graph import Graph
from vertexloom.plans.superstep import MAX_ROUNDS, Result, VertexProgram, run_vertex_program

DAMPING = 0.85
TOLERANCE = 1e-6


def pagerank(graph: Graph, max_iter: int = MAX_ROUNDS, damping: float = DAMPING, tolerance: float = TOLERANCE, precision: str = "double", **how) -> Result:
    """Push/residual PageRank: state (rank, residual, delta, active).

    Ranks are not normalised: a vertex with out-edges starts at 1 - damping, a sink at 0, and mass that reaches a sink
    stays there. A residual up to ``tolerance`` is kept and pushed once later receipts lift it over. ``precision`` 'float'
    keeps the state in single precision.
    """
    deg = F.col("degree")
    kind = lambda c: c.cast(precision)
    out = deg > 0
    zero = F.lit(0.0)

    def apply(m):
        r = kind(F.col("residual") + F.coalesce(m, zero))
        hot = r > tolerance
        return {
            "rank": kind(F.when(hot, F.col("rank") + r).otherwise(F.col("rank"))),
            "residual": kind(F.when(hot, zero).otherwise(r)),
            "delta": kind(F.when(hot & out, F.lit(damping) * r / deg).otherwise(zero)),
            "active": hot,
        }

    program = VertexProgram(
        init={
            "rank": kind(F.when(out, F.lit(1 - damping)).otherwise(zero)),
            "residual": kind(zero),
            "delta": kind(F.when(out, F.lit(damping * (1 - damping)) / deg).otherwise(zero)),
            "active": out,
        },
        message=F.col("delta"),
        combine="sum",
        apply=apply,
    )
    return run_vertex_program(graph, program, max_iter, **how)


def shortest_paths(graph: Graph, source: int = 0, weighted: bool = False, max_iter: int = MAX_ROUNDS, **how) -> Result:
    """Distances from ``source``: state (dist, active); null where it isn't reached. Each edge counts 1 unless ``weighted``."""
    start = F.col("id") == source
    step = F.coalesce(F.col("weight"), F.lit(1)) if weighted else F.lit(1)
    better = lambda m: F.coalesce((m < F.col("dist")) | (m.isNotNull() & F.col("dist").isNull()), F.lit(False))
    program = VertexProgram(
        init={"dist": F.when(start, F.lit(0)).cast("long"), "active": start},
        message=F.col("dist") + step,
        combine="min",
        apply=lambda m: {"dist": F.when(better(m), m).otherwise(F.col("dist")), "active": better(m)},
    )
    return run_vertex_program(graph, program, max_iter, **how)


def _labels(graph: Graph, combine: str, max_iter: int, how: dict) -> Result:
    gains = (lambda m: m < F.col("label")) if combine == "min" else (lambda m: m > F.col("label"))
    took = lambda m: F.coalesce(gains(m), F.lit(False))
    program = VertexProgram(
        init={"label": F.col("id"), "active": F.lit(True)},
        message=F.col("label"),
        combine=combine,
        apply=lambda m: {"label": F.when(took(m), m).otherwise(F.col("label")), "active": took(m)},
    )
    return run_vertex_program(graph, program, max_iter, **how)


def components(graph: Graph, symmetrize: bool = True, max_iter: int = MAX_ROUNDS, **how) -> Result:
    """Smallest id that can reach each vertex: state (label, active). Symmetrised, that is its connected component."""
    return _labels(graph.symmetrize() if symmetrize else graph, "min", max_iter, how)


def max_label(graph: Graph, max_iter: int = MAX_ROUNDS, **how) -> Result:
    """Largest id that can reach each vertex: state (label, active)."""
    return _labels(graph, "max", max_iter, how)
