"""Sizes counted before a step: of tables that may be broadcast, and of tasks that sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a dimension table (providers, models) up to which it is broadcast.
SMALL_ROWS = 100_000


def small(table: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``table``, marked for a broadcast if it has ``rows`` rows at most; else Spark chooses another join."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


#: Rows that a task sorts, about.
TASK_ROWS = 100_000


def tasks_of(rows: DataFrame, each: int = TASK_ROWS) -> int:
    """Tasks that ``rows`` fill with ``each`` rows."""
    return max(1, -(-rows.count() // each))


#: Bytes of texts in a task that hands them to Python, about.
TASK_BYTES = 16 << 20


def tasks_of_bytes(rows: DataFrame, column: str, each: int = TASK_BYTES) -> int:
    """Tasks that ``column`` fills with ``each`` bytes, TASK_ROWS rows a task at most."""
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()
    return max(1, -(-n // TASK_ROWS), -(-size // each))


def spread(rows: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """``rows`` by their keys over as many tasks; a shuffle by keys alone is merged to so many bytes a task, whatever they hold unpacked."""
    return rows.repartition(tasks, *keys)
