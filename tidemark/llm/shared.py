"""What the corpus operators share: scratch tables, free column names, joins of frequent keys."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import Tables as Scratch
from tidemark.session import workers_can_import

__all__ = ["Scratch", "free_name", "join_spread", "tidied", "workers_can_import"]


def tidied(run):
    """A task's function whose worker gives memory that is free back to the machine when the task ends; Spark uses workers again, for other operators as well."""

    def runs(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
            ctypes.CDLL(None).malloc_trim(0)

    return runs


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    return next(c for c in (name, *(f"{name}_{k}" for k in range(len(taken) + 1))) if c.lower() not in taken)


def join_spread(rows: DataFrame, table: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Left join with a table that has ``keys`` once each and, in ``size``, how many of ``rows`` have them.

    Keys with a thousandth of all sizes or more, of which there are a thousand at most, are
    broadcast, so their rows stay where they are; the others are shuffled. Keys are not null.
    """
    least = table.agg(F.greatest(F.lit(2), F.ceil(F.sum(size) / 1000)).alias("least")).collect()[0].least or 2
    hot = F.broadcast(table.where(F.col(size) >= least).drop(size))
    cold = table.where(F.col(size) < least).drop(size)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(keys), keys, "left_anti").join(cold, keys, "left"))
