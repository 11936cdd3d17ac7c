from vertexloom.sources.binary import read_gr, write_gr
from vertexloom.sources.text import read_mtx, read_parts, write_mtx, write_parts

__all__ = ["read_gr", "read_mtx", "read_parts", "write_gr", "write_mtx", "write_parts"]
