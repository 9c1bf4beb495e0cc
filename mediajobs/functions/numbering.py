"""Places of rows in the order of a key, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut
from .sizes import small

#: Rows of a slice, about.
SLICE_ROWS = 16384


def sliced(rows: DataFrame, keys: list[str], order: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``rows`` sorted by ``keys`` and ``order`` over slices of about ``slice_rows`` rows, from a checkpoint; _at is a row's slice and place.

    Splits are those of a sample of the rows, so far values don't matter, and ties
    (of one value, or of nulls) fall into as many slices as they fill.
    """
    n = max(1, -(-rows.count() // slice_rows))
    columns = [*keys, order, "_tie"]
    marked = rows.withColumn("_tie", F.monotonically_increasing_id())
    return cut(marked.repartitionByRange(n, *columns).sortWithinPartitions(*columns).drop("_tie").withColumn("_at", F.monotonically_increasing_id()))


def numbered(rows: DataFrame, keys: list[str], order: str, name: str = "place", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... in the order of ``order`` within ``keys``.

    Counts of groups within slices give where each slice's part of a group starts;
    within a slice a row's place is known from the sort. Nulls in ``order`` come
    first, nulls in ``keys`` are a group; ties are in any order.
    """
    placed, part = sliced(rows, keys, order, slice_rows), F.shiftright("_at", 33)
    groups = [f"_g_{k}" for k in keys]
    counts = placed.groupBy(*[F.col(k).alias(g) for k, g in zip(keys, groups, strict=True)], part.alias("_slice")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(W.partitionBy(*groups).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    # a row for each slice and group; beyond the size of a broadcast the join's keys have a slice's rows at most
    starts = small(cut(counts.select(*groups, "_slice", F.col("_first") - F.coalesce(before, F.lit(0)) - 1)).toDF(*groups, "_slice", "_zero"))
    same = [F.col(k).eqNullSafe(F.col(g)) for k, g in zip(keys, groups, strict=True)]
    return placed.join(starts, [*same, part == F.col("_slice")]).select(*rows.columns, (F.col("_at") - F.col("_zero")).cast("int").alias(name))
