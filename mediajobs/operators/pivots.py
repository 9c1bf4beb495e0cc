"""Exact vector search with a stored pivot table.

1. Pivots are the means of clusters of a bounded sample. Every item is stored once
   with its nearest pivot (its cell) and its distance from it; beside these rows a
   small table holds, for each cell and each pivot, the least and greatest distance
   of the cell's items from the pivot.
2. By the triangle inequality, no item of a cell can be nearer to a query than the
   gap between the query's distance from a pivot and the cell's range, whichever
   pivot gives the widest gap. A query first visits its nearest cells until they
   hold k items; the k-th distance found is its limit. Then it visits those other
   cells whose bound doesn't exceed the limit, and no others.
3. Within a cell, items are read in the order of their distance from the pivot. A
   query skips every run of them whose distances differ from its own by more than
   its limit, which falls as nearer items are found.

Results are those of ``search.knn``, for any table: bounds allow for rounding, and
decide only what isn't compared. A cell with many items, or that many queries visit,
is cut into units of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions.shared import cut
from .search import TOP_K, Nearest, answered, sides, units, usable, validate_dimensions, vectors_of

#: Items that pivots are fitted on at most, items of a cell, about, and pivots at most.
SAMPLE, CELL, MOST_PIVOTS = 8192, 64, 256
#: Items and queries of a unit, and items compared at a time.
UNIT, QUERY_BLOCK, RUN = 16384, 4096, 256
#: Room for rounding, as a share of the distances compared.
ROUND = 1e-9
SEED = 11


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows from pivots, to within ROUND of the numbers that go in."""
    out = np.empty((len(x), len(pivots)))
    for j, p in enumerate(pivots):
        out[:, j] = np.sqrt(((x - p) ** 2).sum(1))
    return out


def clustered(x: np.ndarray, parts: int, seed: int = SEED, rounds: int = 8) -> np.ndarray:
    """Means of ``parts`` clusters of rows."""
    r = np.random.default_rng(seed)
    means = x[r.choice(len(x), parts, replace=False)]
    norms = (x**2).sum(1)
    for _ in range(rounds):
        d = norms[:, None] - 2 * x @ means.T + (means**2).sum(1)
        label = d.argmin(1)
        n = np.bincount(label, minlength=parts)
        sums = np.zeros_like(means)
        np.add.at(sums, label, x)
        means = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], means)
        # an empty cluster takes the row that is farthest from its mean
        far = np.argsort(-d[np.arange(len(x)), label], kind="stable")
        means[n == 0] = x[far[: int((n == 0).sum())]]
    return means


@dataclass
class PivotTable:
    """``items``: cell, r and the items' columns; ``pivots``: a row each; ``low``, ``high``: ranges of cells (rows) from pivots."""

    items: DataFrame
    vector: str
    item_id: str
    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _placed(pivots: np.ndarray, at: int):
    """Rows with the nearest pivot and the distance from it; ``at``: which column is the vector."""

    def run(batches):
        for b in batches:
            cells, r = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            v = vectors_of(b.column(at))
            for lo in range(0, len(v), 1024):
                if {len(x) for x in v[lo : lo + 1024]} != {pivots.shape[1]}:
                    raise ValueError(f"vectors of sizes {sorted({len(x) for x in v} | {pivots.shape[1]})}")
                d = distances(np.stack(v[lo : lo + 1024]).astype(np.float64), pivots)
                cells[lo : lo + 1024] = d.argmin(1)
                r[lo : lo + 1024] = d.min(1)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(r), *b.columns], ["cell", "r", *b.schema.names])

    return run


def _ranges(pivots: np.ndarray):
    """Rows (cell, vector) to the least and greatest distance from each pivot of each cell seen."""

    def run(batches):
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        for b in batches:
            cells, v = b.column(0).to_numpy(), vectors_of(b.column(1))
            for lo in range(0, len(v), 1024):
                d, own = distances(np.stack(v[lo : lo + 1024]).astype(np.float64), pivots), cells[lo : lo + 1024]
                for c in np.unique(own).tolist():
                    rows = d[own == c]
                    low[c] = np.minimum(low.get(c, np.inf), rows.min(0))
                    high[c] = np.maximum(high.get(c, 0.0), rows.max(0))
        for c in low:
            n = len(pivots)
            yield pa.RecordBatch.from_arrays([pa.array([c] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(low[c]), pa.array(high[c])], ["cell", "pivot", "low", "high"])

    return run


def pivots_of(items: DataFrame, vector: str, sample: int = SAMPLE, cell: int = CELL, most: int = MOST_PIVOTS) -> np.ndarray:
    """Pivots for the usable vectors of ``items``: means of clusters of the vectors with the smallest hashes."""
    rows = items.where(usable(F.col(vector))).select(F.col(vector).cast("array<double>").alias("v"))
    n, marks = rows.count(), 1 << 30
    mark = F.pmod(F.xxhash64("v"), F.lit(marks))
    share = marks if n <= sample else int(marks * min(1.0, 1.1 * sample / n + 64 / n))
    drawn = rows.select("v").where(mark < share).distinct().limit(2 * sample).collect()
    if len({len(r.v) for r in drawn}) > 1:
        raise ValueError(f"vectors of sizes {sorted({len(r.v) for r in drawn})}")
    x = np.array(sorted(r.v for r in drawn), np.float64)
    return clustered(x, max(1, min(most, n // cell, len(x) // 4))) if len(x) else np.zeros((0, 0))


def write_pivot_table(items: DataFrame, path: str, vector: str, item_id: str = "media_id", columns: list[str] | None = None, sample: int = SAMPLE, cell: int = CELL, most: int = MOST_PIVOTS) -> None:
    """The pivot table of ``items`` at ``path``, with the items' ``columns`` (those of filters and results).

    Items without a usable vector aren't stored. Files are sorted by cell and distance.
    """
    pivots = pivots_of(items, vector, sample, cell, most)
    spark = items.sparkSession
    kept = items.where(usable(F.col(vector))).select(item_id, vector, *[c for c in columns or [] if c not in (item_id, vector)])
    schema = StructType([StructField("cell", IntegerType()), StructField("r", DoubleType()), *kept.schema.fields])
    placed = kept.mapInArrow(_placed(pivots, 1), schema)
    # cells of any size are dealt by ranges of distance, too
    placed.repartitionByRange("cell", "r").sortWithinPartitions("cell", "r").write.parquet(f"{path}/items")
    stored = spark.read.schema(schema).parquet(f"{path}/items")
    ranges = stored.select("cell", vector).mapInArrow(_ranges(pivots), "cell int, pivot int, low double, high double")
    ranges.groupBy("cell", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).write.parquet(f"{path}/ranges")
    rows = [(i, p.tolist(), vector, item_id) for i, p in enumerate(pivots)] or [(None, None, vector, item_id)]
    spark.createDataFrame(rows, "pivot int, v array<double>, vector string, item_id string").coalesce(1).write.parquet(f"{path}/pivots")


def read_pivot_table(spark: SparkSession, path: str) -> PivotTable:
    """The table at ``path``; what the driver holds is bounded by the square of MOST_PIVOTS."""
    rows = sorted(spark.read.parquet(f"{path}/pivots").collect(), key=lambda r: r.pivot or 0)
    pivots = np.array([r.v for r in rows if r.v is not None])
    low, high = np.full((len(pivots), len(pivots)), np.inf), np.full((len(pivots), len(pivots)), -np.inf)
    for r in spark.read.parquet(f"{path}/ranges").collect():
        low[r.cell, r.pivot], high[r.cell, r.pivot] = r.low, r.high
    return PivotTable(spark.read.parquet(f"{path}/items"), rows[0].vector, rows[0].item_id, pivots, low, high)


def pivot_table(items: DataFrame, vector: str, path: str, item_id: str = "media_id", columns: list[str] | None = None, **options) -> PivotTable:
    """The pivot table of ``items``, written to ``path`` and read again."""
    write_pivot_table(items, path, vector, item_id, columns, **options)
    return read_pivot_table(items.sparkSession, path)


class Bounds:
    """What the ranges of cells tell about queries."""

    def __init__(self, table: PivotTable, held: np.ndarray):
        self.pivots, self.low, self.high, self.held = table.pivots, table.low, table.high, held

    def of(self, v: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Distances of queries from pivots; bounds of their distances from the items of each cell (infinite if it has none)."""
        if {len(x) for x in v} != {self.pivots.shape[1]}:
            raise ValueError(f"query vectors of sizes {sorted({len(x) for x in v})} for {self.pivots.shape[1]}")
        d = distances(np.stack(v), self.pivots)
        least = np.zeros_like(d)
        for c in range(len(self.pivots)):
            gap = np.maximum(d - self.high[c], self.low[c] - d) - ROUND * (d + self.high[c])
            # what overflows is no bound
            least[:, c] = np.where(gap > 0, gap, 0.0).max(1) if self.held[c] else np.inf
        return d, least

    def first(self, least: np.ndarray, d: np.ndarray, k: int) -> list[np.ndarray]:
        """The nearest cells of each query that together hold k items, or all that hold any."""
        order = np.lexsort((d, least), axis=1)
        n = self.held[order]
        before = np.cumsum(n, axis=1) - n
        return [o[(b < k) & (m > 0)] for o, b, m in zip(order, before, n, strict=True)]


def _visits(bounds: Bounds, k: int, first: bool):
    """Queries (q, i, v, carried, limit) to a row for each cell visited: the first ones, or the further ones within the limit.

    Comes with the cell, the distance from its pivot, and the limit as a distance.
    """

    def run(batches):
        for b in batches:
            v = vectors_of(b.column("v"))
            limits = np.sqrt(b.column("limit").to_numpy(zero_copy_only=False).astype(np.float64)) * (1 + ROUND)
            at, cells, r = [], [], []
            for lo in range(0, len(v), 512):
                d, least = bounds.of(v[lo : lo + 512])
                for i, own in enumerate(bounds.first(least, d, k)):
                    if not first:
                        within = np.flatnonzero(least[i] <= limits[lo + i])
                        own = within[np.isin(within, own, invert=True) & np.isfinite(least[i][within])]
                    at.append(np.full(len(own), lo + i))
                    cells.append(own)
                    r.append(d[i][own])
            if at:
                out = b.take(pa.array(np.concatenate(at)))
                added = [pa.array(np.concatenate(cells), pa.int32()), pa.array(np.concatenate(r)), pa.array(limits[np.concatenate(at)])]
                kept = [c for c in out.schema.names if c != "limit"]
                yield pa.RecordBatch.from_arrays([*added, *(out.column(c) for c in kept)], ["cell", "r", "limit", *kept])

    return run


class CellSearch(Nearest):
    """The nearest items of a cell; ``r``: the queries' distances from its pivot; ``limits``: how far they need to look."""

    def __init__(self, ids: list, vectors: list[np.ndarray], r: list[float], limits: list[float], k: int):
        super().__init__(ids, vectors, k)
        self.r, self.far, self.compared = np.array(r), np.array(limits), 0

    def see_ring(self, ids: list, x: np.ndarray, r: np.ndarray, carried: pa.Array | None) -> None:
        """Items in the order of their distances ``r`` from the pivot."""
        far = np.minimum(self.far, np.sqrt(self.limit))
        room = ROUND * (self.r + r[-1] + np.where(np.isfinite(far), far, 0.0))
        of = np.flatnonzero(~((r[0] - self.r > far + room) | (self.r - r[-1] > far + room)))
        if len(of):
            self.compared += len(of) * len(ids)
            self.see(ids, x, carried, of)


def _search_cells(k: int, compared):
    """Rows sorted by unit (cell, piece, block), kind and distance from the pivot: a unit's queries (kind 0), then its items."""

    def run(batches):
        name, asked, nearest, types = None, ([], [], [], []), None, None
        for (*own, kind), b in units(batches, 4):
            types = [b.column(i).type for i in (6, 7, 9) if i < b.num_columns]
            if own != name:
                if nearest:
                    if compared is not None:
                        compared.add(nearest.compared)
                    yield nearest.rows(types)
                name, asked, nearest = own, ([], [], [], []), None
            vectors, r = vectors_of(b.column(8)), b.column(4).to_numpy()
            if kind == 0:
                for held, more in zip(asked, (b.column(6).to_pylist(), vectors, r.tolist(), b.column(5).to_pylist()), strict=True):
                    held.extend(more)
            elif asked[0]:
                nearest = nearest or CellSearch(*asked, k)
                ids = b.column(7).to_pylist()
                for at in range(0, len(ids), RUN):
                    part = slice(at, at + RUN)
                    nearest.see_ring(ids[part], np.stack(vectors[part]), r[part], b.column(9)[part] if b.num_columns > 9 else None)
        if nearest:
            if compared is not None:
                compared.add(nearest.compared)
            yield nearest.rows(types)

    return run


def _counts(rows: DataFrame, cells: int) -> np.ndarray:
    """Rows of each cell; at most MOST_PIVOTS of them."""
    out = np.zeros(cells, np.int64)
    for cell, n in rows.groupBy("cell").count().collect():
        out[cell] = n
    return out


def _cut(counts: np.ndarray, most: int):
    """Column: into how many pieces of ``most`` rows a row's cell is cut."""
    return F.expr(f"get(array({', '.join(str(-(-int(n) // most)) for n in counts)}), cell)")


def knn_pruned(
    queries: DataFrame, table: PivotTable, k: int = TOP_K, query_id: str = "query_id", filter_expr: str | None = None, prefilter: bool = True, size: int | None = None,
    carry: list[str] | None = None, unit: int = UNIT, query_block: int = QUERY_BLOCK, compared=None,
) -> DataFrame:
    """What ``search.knn`` gives for the items of ``table``: query_id, rank, item_id, distance, and the columns ``carry``.

    ``filter_expr`` may use the columns that the table holds. ``compared``: an
    accumulator that counts the pairs of queries and items compared.
    """
    carry = list(carry or [])
    after = filter_expr and not prefilter
    items = table.items
    items = items.withColumn("_passes", F.expr(filter_expr)) if after else items.where(F.expr(filter_expr)) if filter_expr else items
    if size is not None:
        queries, items = validate_dimensions(queries, "query_vector", size), validate_dimensions(items, table.vector, size)
    carried = [*carry, "_passes"] if after else carry
    left, right = sides(queries, items, table.vector, query_id, table.item_id, carried, ("cell", "r"))
    right = right.select("cell", "r", F.lit(None).cast("double").alias("limit"), *right.columns[2:])
    routed = StructType([StructField(f.name, f.dataType) for f in right.schema])  # all may be null
    result = StructType([routed["q"], routed["i"], StructField("distance", DoubleType()), *routed.fields[6:]])
    held = _counts(items, len(table.pivots))
    if not held.any():
        return answered(queries.sparkSession.createDataFrame([], result), k, query_id, table.item_id, carry)
    bounds = Bounds(table, held)

    def searched(visits):
        pieces, blocks = _cut(held, unit), _cut(_counts(visits, len(held)), query_block)
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        own = lambda n, *key: F.pmod(F.xxhash64(*key), n.cast("long")).cast("int")
        # a cell that no query visits has no block
        asked = visits.select("cell", every(pieces).alias("piece"), own(blocks, "q").alias("block"), F.lit(0).alias("kind"), *visits.columns[1:])
        seen = right.where(blocks > 0).select("cell", own(pieces, "i", "v").alias("piece"), every(blocks).alias("block"), F.lit(1).alias("kind"), *right.columns[1:])
        keys = ["cell", "piece", "block"]
        rows = asked.union(seen).repartition(*keys).sortWithinPartitions(*keys, "kind", "r")
        return rows.mapInArrow(_search_cells(k, compared), result)

    # read again for the limits
    best = cut(searched(left.withColumn("limit", F.lit(float("inf"))).mapInArrow(_visits(bounds, k, True), routed)))
    limits = best.groupBy("q").agg(F.get(F.array_sort(F.collect_list("distance")), F.lit(k - 1)).alias("limit"))
    again = left.join(limits.withColumnRenamed("q", "_q"), F.col("q").eqNullSafe(F.col("_q")), "left").drop("_q").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
    more = searched(again.mapInArrow(_visits(bounds, k, False), routed))
    out = answered(best.union(more), k, query_id, table.item_id, carried)
    return out.where("_passes").drop("_passes") if after else out
