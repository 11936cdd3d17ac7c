"""vertexloom: frontier-driven graph analytics as ordinary Spark plans."""

from vertexloom.graph import Graph
from vertexloom.plans.superstep import Result, VertexProgram, run_vertex_program

__all__ = ["Graph", "Result", "VertexProgram", "run_vertex_program"]
