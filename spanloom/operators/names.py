"""Column names: working names that clash with none of a table's, and names as expressions take them."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """The names wanted, each made longer until no column of df has it (names are compared without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column's name as F.col takes it, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"
