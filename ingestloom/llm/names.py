"""Column names that no table of a user has."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(columns: Iterable[str], *wanted: str) -> list[str]:
    """``wanted`` names, each lengthened until it differs from all ``columns`` and from each other, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
