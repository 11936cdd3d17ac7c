"""Names for helper columns."""

from __future__ import annotations


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores after those that a column has already, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out
