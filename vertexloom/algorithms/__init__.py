from vertexloom.algorithms.programs import components, max_label, pagerank, shortest_paths

__all__ = ["components", "max_label", "pagerank", "shortest_paths"]
