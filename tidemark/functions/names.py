"""Names for helper columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_name(df: DataFrame, name: str) -> str:
    """A column name that a table does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}_{k}" for k in range(len(taken) + 1))) if n.lower() not in taken)
