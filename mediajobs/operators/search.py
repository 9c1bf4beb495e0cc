"""Exact vector search over media tables, and its filters.

Distance is squared L2 in double; ties go to the smaller id. Vectors that are
null, empty, or hold null or non-finite values are left out on both sides.
Ids keep their type. All other vectors of a search must have one size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.shared import cut
from .models import embed_table, hash_encoder

#: Queries held by a task at a time, and items that a task compares with them at least (where cores lack work) and at most.
QUERY_BLOCK, LEAST_PART, MOST_PART = 4096, 16384, 1 << 21
#: Bytes of query vectors that the built-in form broadcasts at most.
BROADCAST_BYTES = 1 << 20
TOP_K = 10


def validate_dimensions(rows: DataFrame, column: str, size: int, mode: str = "fail"):
    """Non-null vectors must have ``size`` values: ``rows``, failing otherwise; or (valid, quarantine) for mode="quarantine"."""
    good = F.col(column).isNull() | (F.size(column) == size)
    if mode == "quarantine":
        return rows.where(good), rows.where(~good)
    text = F.concat(F.lit(f"{column} has "), F.size(column).cast("string"), F.lit(f" values, expected {size}"))
    return rows.withColumn(column, F.when(good, F.col(column)).otherwise(F.raise_error(text).cast(rows.schema[column].dataType)))


def squared_l2(a: Column, b: Column) -> Column:
    gap = lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))
    return F.aggregate(F.zip_with(a, b, gap), F.lit(0.0), lambda s, x: s + x)


def usable(vector: Column) -> Column:
    """Whether a vector takes part in a search."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(good & (F.size(vector) > 0), F.lit(False))


def _ranked(pairs: DataFrame, query_id: str, item_id: str, k: int) -> DataFrame:
    order = W.partitionBy(query_id).orderBy("distance", item_id)
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Nearest:
    """The ``k`` nearest items so far of each query of a block."""

    def __init__(self, ids: list, vectors: list[np.ndarray], k: int):
        if len({len(v) for v in vectors}) > 1:
            raise ValueError(f"query vectors of sizes {sorted({len(v) for v in vectors})}")
        self.ids, self.q, self.k = ids, np.stack(vectors), k
        self.norms = (self.q**2).sum(1)
        self.best: list[list[tuple]] = [[] for _ in ids]  # (distance, id is null, id, what the item carries)
        self.limit = np.full(len(ids), np.inf)

    def see(self, ids: list, x: np.ndarray, carried: pa.Array | None = None, of: np.ndarray | None = None) -> None:
        """Compare items with all queries, or those numbered ``of``."""
        if x.shape[1] != self.q.shape[1]:
            raise ValueError(f"vectors of {x.shape[1]} values for queries of {self.q.shape[1]}")
        norms = (x**2).sum(1)
        of = np.arange(len(self.q)) if of is None else of
        for at in range(0, len(of), 512):
            rows = of[at : at + 512]
            both = self.norms[rows, None] + norms[None, :]
            # a product finds what may be near enough (its rounding error is allowed for), differences decide
            near = both - 2 * (self.q[rows] @ x.T) - 1e-9 * both
            limit = self.limit[rows]
            if near.shape[1] > self.k:
                limit = np.minimum(limit, np.partition(near + 2e-9 * both, self.k - 1, axis=1)[:, self.k - 1])
            row, column = np.nonzero(near <= limit[:, None])
            gaps = (x[column] - self.q[rows[row]]) ** 2
            d = np.zeros(len(row))
            for j in range(gaps.shape[1]):  # summed in order, as SQL does
                d += gaps[:, j]
            edges = np.searchsorted(row, np.arange(near.shape[0] + 1))
            for i, query in enumerate(rows.tolist()):
                lo, hi = edges[i], edges[i + 1]
                if lo < hi:
                    found = [(v, ids[c] is None, ids[c], carried and carried[c]) for v, c in zip(d[lo:hi].tolist(), column[lo:hi].tolist(), strict=True)]
                    best = sorted(self.best[query] + found, key=lambda f: f[:2] if f[1] else f[:3])[: self.k]
                    self.best[query] = best
                    if len(best) == self.k:
                        self.limit[query] = best[-1][0]

    def rows(self, types: list) -> pa.RecordBatch:
        """q, i, distance and what items carry (if anything) of the best; ``types``: of q, i and that."""
        flat = [(q, i, d, more) for q, best in zip(self.ids, self.best, strict=True) for d, _, i, more in best]
        columns = list(zip(*flat, strict=True)) or [(), (), (), ()]
        out = [pa.array(columns[0], types[0]), pa.array(columns[1], types[1]), pa.array(columns[2], pa.float64())]
        if len(types) > 2:
            out.append(pa.array([c and c.as_py() for c in columns[3]], types[2]))
        return pa.RecordBatch.from_arrays(out, ["q", "i", "distance", "carried"][: len(out)])


def vectors_of(column: pa.Array) -> list[np.ndarray]:
    ends = np.cumsum(np.append(0, column.value_lengths().to_numpy(zero_copy_only=False)))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return [flat[lo:hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]


def units(batches, width: int):
    """Runs of rows of Arrow batches whose first ``width`` columns (integers) agree: (values, rows)."""
    for b in batches:
        keys = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(width)], 1)
        edges = np.append(0, np.append(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(keys)))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if lo < hi:
                yield keys[lo].tolist(), b.slice(lo, hi - lo)


def sides(queries: DataFrame, items: DataFrame, vector: str, query_id: str, item_id: str, carry: list[str], first: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """Both sides of a search as q, i, v and, if asked for, carried; rows that take part only. Items have their columns ``first`` before these."""
    types = queries.schema[query_id].dataType, items.schema[item_id].dataType
    right = items.where(usable(F.col(vector))).select(*first, F.lit(None).cast(types[0]).alias("q"), F.col(item_id).alias("i"), F.col(vector).cast("array<double>").alias("v"), *([F.struct(*carry).alias("carried")] if carry else []))
    left = queries.where(usable(F.col("query_vector"))).select(F.col(query_id).alias("q"), F.lit(None).cast(types[1]).alias("i"), F.col("query_vector").cast("array<double>").alias("v"), *([F.lit(None).cast(right.schema["carried"].dataType).alias("carried")] if carry else []))
    return left, right


def answered(best: DataFrame, k: int, query_id: str, item_id: str, carry: list[str]) -> DataFrame:
    """query_id, rank, item_id, distance and what is carried, of the ``k`` best rows (q, i, distance) of each query."""
    out = _ranked(best.select(F.col("q").alias(query_id), F.col("i").alias(item_id), "distance", *(["carried"] if carry else [])), query_id, item_id, k)
    return out.select(query_id, "rank", item_id, "distance", *[F.col(f"carried.{c}").alias(c) for c in carry])


def knn(
    queries: DataFrame, items: DataFrame, vector: str, k: int = TOP_K, query_id: str = "query_id", item_id: str = "media_id",
    filter_expr: str | None = None, prefilter: bool = True, size: int | None = None, carry: list[str] | None = None,
) -> DataFrame:
    """The ``k`` nearest ``items`` of each query: query_id, rank, item_id, distance, and the items' columns ``carry``.

    ``queries``: query_id, query_vector. Blocks of queries meet parts of the items
    in a grid; a task holds one block and streams one part, and returns its own k
    best of each query. ``size`` is checked on both sides; without it, vectors of
    different sizes are an error when they meet. ``filter_expr`` holds before
    ranking, or of what was ranked (``prefilter`` false: fewer than k may remain).
    Items are rows: of a repeated id, each row has a rank of its own.
    """
    carry = list(carry or [])
    if size is not None:
        queries, items = validate_dimensions(queries, "query_vector", size), validate_dimensions(items, vector, size)
    after = filter_expr and not prefilter
    found = items.withColumn("_passes", F.expr(filter_expr)) if after else items.where(F.expr(filter_expr)) if filter_expr else items
    left, right = sides(queries, found, vector, query_id, item_id, [*carry, "_passes"] if after else carry)
    n, blocks = right.count(), max(1, -(-left.count() // QUERY_BLOCK))
    busy = -(-2 * items.sparkSession.sparkContext.defaultParallelism // blocks)
    parts = max(1, -(-n // MOST_PART), min(-(-n // LEAST_PART), busy))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    side = lambda rows, kind, part, block: rows.select(part.alias("part"), block.alias("block"), F.lit(kind).alias("kind"), *rows.columns)
    rows = side(left, 0, every(parts), F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")).union(
        side(right, 1, F.pmod(F.xxhash64("i", "v"), F.lit(parts)).cast("int"), every(blocks))
    )
    schema = StructType([StructField(c, right.schema[c].dataType if c != "distance" else DoubleType()) for c in ("q", "i", "distance", *right.columns[3:])])

    def run(batches):
        name, asked, nearest, types = None, ([], []), None, None
        for (part, block, kind), b in units(batches, 3):
            types = [b.column(i).type for i in (3, 4, 6) if i < b.num_columns]
            if (part, block) != name:
                if nearest:
                    yield nearest.rows(types)
                name, asked, nearest = (part, block), ([], []), None
            vectors = vectors_of(b.column(5))
            if kind == 0:
                asked[0].extend(b.column(3).to_pylist())
                asked[1].extend(vectors)
            elif asked[0]:
                nearest = nearest or Nearest(*asked, k)
                seen(nearest, b.column(4).to_pylist(), vectors, b.column(6) if b.num_columns > 6 else None)
        if nearest:
            yield nearest.rows(types)

    best = rows.repartition("part", "block").sortWithinPartitions("part", "block", "kind").mapInArrow(run, schema)
    out = answered(best, k, query_id, item_id, [*carry, "_passes"] if after else carry)
    return out.where("_passes").drop("_passes") if after else out


def seen(nearest: Nearest, ids: list, vectors: list[np.ndarray], carried: pa.Array | None) -> None:
    sizes = {len(v) for v in vectors}
    if len(sizes) > 1:
        raise ValueError(f"vectors of sizes {sorted(sizes)}")
    for at in range(0, len(ids), 4096):
        part = slice(at, at + 4096)
        nearest.see(ids[part], np.stack(vectors[part]), carried[part] if carried is not None else None)


def knn_builtin(queries: DataFrame, items: DataFrame, vector: str, k: int = TOP_K, query_id: str = "query_id", item_id: str = "media_id") -> DataFrame:
    """The same by built-in expressions, for query vectors of few bytes, which are broadcast; more go to ``knn``."""
    asked = queries.where(usable(F.col("query_vector")))
    if (asked.agg(F.sum(F.size("query_vector") * 8)).first()[0] or 0) > BROADCAST_BYTES:
        return knn(queries, items, vector, k, query_id, item_id)
    pairs = items.where(usable(F.col(vector))).join(F.broadcast(asked))
    same = F.size(vector) == F.size("query_vector")
    distance = F.when(same, squared_l2(F.col(vector), F.col("query_vector"))).otherwise(F.raise_error(F.lit("vectors of different sizes")).cast("double"))
    return _ranked(pairs.select(query_id, item_id, distance.alias("distance")), query_id, item_id, k).select(query_id, "rank", item_id, "distance")


def validate_search(queries: DataFrame) -> DataFrame:
    """``queries`` (mode, query_text, query_image) with error_code 400 where what the mode needs is missing."""
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    ok = ((F.col("mode") == "text") & has("query_text")) | ((F.col("mode") == "image") & has("query_image"))
    return queries.withColumn("error_code", F.when(~F.coalesce(ok, F.lit(False)), F.lit(400)))


def _search(queries, media, source, vector, k, encoder, pivots, options):
    asked = queries.where(F.col(source).isNotNull() & (F.col(source) != "")).select("query_id", F.col(source).alias("input"))
    # searches count their sides first; a checkpoint, so that queries are encoded once
    vectors = cut(embed_table(asked, encoder).select("query_id", F.col("vector").alias("query_vector")))
    carry = [c for c in media.columns if c not in ("media_id", "multimodal_vector", "dino_vector")]
    if pivots is None:
        found = knn(vectors, media, vector, k, carry=carry, **options)
    else:
        from .pivots import knn_pruned

        found = knn_pruned(vectors, pivots, k, carry=carry, **options)
    return found.select("media_id", "query_id", "rank", "distance", *carry)


def search_by_text(queries: DataFrame, media: DataFrame, k: int = TOP_K, encoder: Callable = hash_encoder, pivots=None, **options) -> DataFrame:
    """Nearest media of text queries by the multimodal vector; no vectors in the output.

    ``pivots``: the media's pivot table of that vector, to compare fewer of them.
    ``options``: those of ``knn`` (filter, size).
    """
    return _search(queries, media, "query_text", "multimodal_vector", k, encoder, pivots, options)


def search_by_image(queries: DataFrame, media: DataFrame, k: int = TOP_K, encoder: Callable = hash_encoder, pivots=None, **options) -> DataFrame:
    """Nearest media of image queries by the visual vector."""
    return _search(queries, media, "query_image", "dino_vector", k, encoder, pivots, options)
