"""Column names that clash with none of a table's own."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column."""
    held = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        out.append(name)
    return out
