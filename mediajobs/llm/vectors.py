"""Exact top-k search with a vector-approximation file (operator 3).

Components become integers floor(SCALE * x); the score is their inner product.

1. Points. Rows with the same integer vector are one point, known by a 128-bit
   digest. A point keeps its k + 1 smallest rows (by id): no query needs more of
   them, as it skips itself only. Thousands of copies are searched once.
2. Approximation. Points are cut into blocks where they lie; a block holds one
   byte per component (one of CELLS cells between the least and the greatest
   value of the block) and the widest gap between a component and its cell's
   middle. The file of blocks is written once, to the checkpoint folder.
3. Scan. Blocks of cells meet blocks of query points in a grid. A product with
   the cells gives every pair a score from below and from above (rounding is
   part of the gap); pairs that k + 1 others of the unit surely beat are left
   out. Then the (k + 1)-th lower bound over all units leaves out more.
4. Exact vectors are joined to what remains, in two steps: first to each query's
   k + 1 pairs with the highest bounds, then to those whose bound is not below
   the (k + 1)-th score found. Nothing is dropped but by certain bounds.
5. The best points are replaced by their rows, and each query takes its list
   without its own row.

Scores are longs: one beyond -(2**63 - 1) .. 2**63 - 1 among the k best is an
error, as in SQL; elsewhere integers of any width are compared.

Ties go to the smaller id. Vectors that are null, empty, or hold null or
non-finite components take no part; all other values do. Vectors are compared
with those of the same length only. Repeated ids are rows of their own: each is
searched for on its own and skips itself only. Rows with null ids take no part.
Fewer than k candidates give fewer rows; an empty table none. Very long vectors
are one block each. Other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

SCALE = 256
CELLS = 256
K = 5
LONGEST = 2**63 - 1
#: Query points of a block, and points that a unit of the scan has at least (where cores lack work) and about at most.
QUERY_BLOCK, LEAST_UNIT, MOST_UNIT = 8192, 16384, 1 << 22
#: Bytes of a block's cells, about.
BLOCK_BYTES = 1 << 15
#: Rows of one hot query point that are answered in one piece.
ROWS = 8192


def finite(vector: Column) -> Column:
    """Whether a vector takes part."""
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(math.inf)))
    return F.coalesce(good, F.lit(False)) & (F.size(vector) > 0)


def floored(v: np.ndarray) -> np.ndarray:
    """floor(SCALE * v) / SCALE, exactly: values beyond 2**53 are integers, and a power of two only shifts."""
    return np.where(np.abs(v) < 2.0**53, np.floor(np.where(np.abs(v) < 2.0**53, v, 0.0) * SCALE) / SCALE, v) + 0.0


def _floored(batches):
    """Rows (vec_id, is_query, x) with the length, bytes and digest of the integer vector over SCALE."""
    for b in batches:
        x = b.column(2)
        ends = np.cumsum(np.append(0, x.value_lengths().to_numpy(zero_copy_only=False))).tolist()
        flat = floored(x.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
        y = [flat[lo:hi].tobytes() for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
        digest = [hashlib.blake2b(v, digest_size=16).digest() for v in y]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([len(v) // 8 for v in y], pa.int32()), pa.array(digest, pa.binary()), pa.array(y, pa.binary())],
            ["vec_id", "is_query", "dim", "digest", "y"],
        )


def encoded(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells (uint8) of vectors (rows), and the block's grid: lowest value, width of a cell, widest gap to a cell's middle."""
    with np.errstate(over="ignore", invalid="ignore"):
        low = y.min(0)
        width = np.nan_to_num((y.max(0) - low) / CELLS, posinf=2.0**1023)
        code = np.clip(np.floor((y - low) / np.where(width > 0, width, 1.0)), 0, CELLS - 1)
        code = np.nan_to_num(code).astype(np.uint8)
        gap = np.nan_to_num(np.abs(y - (low + (code + 0.5) * width)), nan=np.inf, posinf=np.inf).max(0)
    return code, np.stack([low, width, gap])


SCAN = "dim int, kind int, point long, points binary, data binary, grid binary"


def _cells(batches):
    """Points (point, dim, y, least) to blocks of their cells; ``points`` holds their numbers and then their smallest ids."""
    for b in batches:
        dims = b.column(1).to_numpy()
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            step = max(1, BLOCK_BYTES // dim)
            for lo in range(0, len(at), step):
                part = b.take(pa.array(at[lo : lo + step]))
                y = np.stack([np.frombuffer(v.as_buffer(), np.float64) for v in part.column(2)])
                code, grid = encoded(y)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim], pa.int32()), pa.array([1], pa.int32()), pa.array([None], pa.int64()), pa.array([part.column(0).to_numpy().tobytes() + part.column(3).to_numpy().tobytes()]), pa.array([code.tobytes()]), pa.array([grid.tobytes()])],
                    ["dim", "kind", "point", "points", "data", "grid"],
                )


def bounds(q: np.ndarray, code: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Middles of the scores of queries (rows) with a block's points (columns), and each query's gap around them."""
    low, width, gap = grid
    dim = len(low)
    with np.errstate(over="ignore", invalid="ignore"):
        step = q * width
        # each query's steps over their greatest one, so that single precision holds them
        most = np.maximum(np.abs(step).max(1, keepdims=True), np.finfo(np.float64).tiny)
        middle = ((step / most).astype(np.float32) @ code.astype(np.float32).T).astype(np.float64) * most + (q @ (low + width / 2))[:, None]
        # the product is in single precision, the rest in double: both roundings, twice
        single = np.abs(step).sum(1) * (CELLS * (dim + 4) * 2.0**-23)
        double = np.abs(q) @ (np.abs(low) + CELLS * width) * ((dim + 8) * 2.0**-50)
        around = np.nan_to_num(np.abs(q) @ gap + single + double, nan=np.inf, posinf=np.inf)
    # what overflows may be anything
    around = np.where(np.isfinite(middle).all(1), around, np.inf)
    return np.nan_to_num(middle, nan=0.0, posinf=0.0, neginf=0.0), around


class Unit:
    """Pairs of one unit of the scan that may be among the ``k`` best of their query."""

    def __init__(self, points: list[int], vectors: list[bytes], k: int):
        self.points, self.k = np.array(points, np.int64), k
        self.q = np.stack([np.frombuffer(v, np.float64) for v in vectors])
        self.lower = np.full((len(points), k), -np.inf)  # the k highest lower bounds
        self.found: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def see(self, points: np.ndarray, ids: np.ndarray, code: np.ndarray, grid: np.ndarray) -> None:
        for at in range(0, len(self.q), 1024):
            rows = slice(at, at + 1024)
            middle, around = bounds(self.q[rows], code, grid)
            best = np.partition(middle, max(0, middle.shape[1] - self.k), axis=1)[:, -self.k :] - around[:, None]
            self.lower[rows] = np.sort(np.hstack([self.lower[rows], best]), axis=1)[:, -self.k :]
            row, column = np.nonzero(middle >= (self.lower[rows, 0] - around)[:, None])
            m, a = middle[row, column], around[row]
            self.found.append((row + at, points[column], m + a, m - a, ids[column]))
            self.held += len(row)
        if self.held > 1 << 20:
            self.narrow()

    def narrow(self) -> None:
        found = [np.concatenate(x) for x in zip(*self.found, strict=True)]
        row, _, upper, lower, ids = found
        limit = self.lower[row, 0]
        keep = upper >= limit
        # scores known to be the limit itself: the smallest ids stand for all
        tied = np.flatnonzero((upper == lower) & (upper == limit))
        tied = tied[np.lexsort((ids[tied], row[tied]))]
        place = np.arange(len(tied)) - np.searchsorted(row[tied], row[tied])
        keep[tied[place >= self.k]] = False
        self.found = [tuple(x[keep] for x in found)]
        # what stays is needed; wait for as much again
        self.held = min(int(keep.sum()), 1 << 19)

    def pairs(self) -> pa.RecordBatch | None:
        if not self.found:
            return None
        self.narrow()
        row, point, upper, lower, _ = self.found[0]
        return pa.RecordBatch.from_arrays(
            [pa.array(self.points[row]), pa.array(point), pa.array(upper), pa.array(lower)], ["q", "point", "upper", "lower"]
        )


def _scan(k: int):
    """Rows sorted by unit (dim, g, b) and kind: a unit's queries (kind 0), then its blocks of cells."""

    def run(batches):
        name, unit, asked = None, None, ([], [])
        for b in batches:
            names = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
            kinds = b.column(3).to_pylist()
            for i, own in enumerate(names):
                if own != name:
                    if unit and (out := unit.pairs()):
                        yield out
                    name, unit, asked = own, None, ([], [])
                if kinds[i] == 0:
                    asked[0].append(b.column(4)[i].as_py())
                    asked[1].append(b.column(6)[i].as_py())
                elif asked[0]:
                    unit = unit or Unit(*asked, k)
                    code = np.frombuffer(b.column(6)[i].as_buffer(), np.uint8).reshape(-1, own[0])
                    grid = np.frombuffer(b.column(7)[i].as_buffer(), np.float64).reshape(3, own[0])
                    points, ids = np.frombuffer(b.column(5)[i].as_buffer(), np.int64).reshape(2, -1)
                    unit.see(points, ids, code, grid)
        if unit and (out := unit.pairs()):
            yield out

    return run


def wide_integers(y: np.ndarray) -> list[int]:
    return [int(v) * SCALE if abs(v) >= 2.0**53 else int(v * SCALE) for v in y.tolist()]


def inner(a: np.ndarray, b: np.ndarray) -> int:
    """Exact inner product of two integer vectors, given over SCALE."""
    most = [max(1.0, float(np.abs(v).max())) for v in (a, b)]
    if most[0] < 2.0**53 and most[1] < 2.0**53 and most[0] * most[1] * SCALE * SCALE * len(a) < 2.0**62:
        return int((a * SCALE).astype(np.int64) @ (b * SCALE).astype(np.int64))
    return sum(map(int.__mul__, wide_integers(a), wide_integers(b)))


def _at_most(score: int) -> float:
    """A float over SCALE * SCALE that is no greater than the score."""
    try:
        return math.nextafter(float(score), -math.inf) / SCALE / SCALE
    except OverflowError:
        return math.nextafter(math.inf, 0) if score > 0 else -math.inf


def _beyond(score: int) -> bytes | None:
    """Null for scores that fit; else bytes in the order of scores (components are below 2**1032)."""
    return None if abs(score) <= LONGEST else (score + (1 << 2111)).to_bytes(264, "big")


SCORED = "q long, point long, least long, digest binary, score long, side int, beyond binary, floor double"


def _scores(batches):
    for b in batches:
        left, right = ([np.frombuffer(v.as_buffer(), np.float64) for v in b.column(i)] for i in (4, 5))
        scores = [inner(x, y) for x, y in zip(left, right, strict=True)]
        tails = [_beyond(n) for n in scores]
        # of scores cut to the same long, those that fit come between those above and those below
        sides = [0 if t is None else 1 if n > 0 else -1 for n, t in zip(scores, tails, strict=True)]
        near = [max(-LONGEST, min(LONGEST, n)) for n in scores]
        yield pa.RecordBatch.from_arrays(
            [*(b.column(i) for i in range(4)), pa.array(near, pa.int64()), pa.array(sides, pa.int32()), pa.array(tails, pa.binary()), pa.array(map(_at_most, scores), pa.float64())],
            ["q", "point", "least", "digest", "score", "side", "beyond", "floor"],
        )


def points_of(vectors: DataFrame, is_query: Column, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows that take part; the k + 1 smallest rows of each distinct vector; the distinct vectors, numbered."""
    x = F.col("embedding").cast("array<double>")
    rows = cut(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), x.alias("x"))
        .where(F.col("vec_id").isNotNull() & finite(F.col("x")))
        .mapInArrow(_floored, "vec_id long, is_query boolean, dim int, digest binary, y binary")
        .withColumn("row", F.monotonically_increasing_id())
    )
    # a limit on row_number is applied before the shuffle, too, so a vector with any share of the rows is no hot group
    place = F.row_number().over(W.partitionBy("digest").orderBy("vec_id", "row"))
    members = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    points = cut(
        members.where("place = 1").select("digest", "dim", "y", F.col("vec_id").alias("least")).withColumn("point", F.monotonically_increasing_id())
    )
    return rows, members.select("digest", "vec_id", "row"), points


def candidates(points: DataFrame, asked: DataFrame, k: int, query_block: int, least_unit: int) -> DataFrame:
    """(q, point, upper, lower): pairs that bounds leave for the k best points of each of ``asked`` (point, dim, y)."""
    cells = cut(points.select("point", "dim", "y", "least").mapInArrow(_cells, SCAN))
    n, n_q = points.count(), asked.count()
    blocks = max(1, -(-n_q // query_block))
    # as many units as keep the cores busy, but no small ones, and none without end
    busy = -(-4 * points.sparkSession.sparkContext.defaultParallelism // blocks)
    groups = max(1, -(-n // MOST_UNIT), min(-(-n // least_unit), busy))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    null = F.lit(None).cast("binary")
    left = asked.select("dim", every(groups).alias("g"), F.pmod(F.xxhash64("point"), F.lit(blocks)).cast("int").alias("b"), F.lit(0).alias("kind"), "point", null.alias("points"), F.col("y").alias("data"), null.alias("grid"))
    right = cells.select("dim", F.pmod(F.xxhash64("points"), F.lit(groups)).cast("int").alias("g"), every(blocks).alias("b"), "kind", "point", "points", "data", "grid")
    pairs = cut(
        left.union(right).repartition("dim", "g", "b").sortWithinPartitions("dim", "g", "b", "kind")
        .mapInArrow(_scan(k), "q long, point long, upper double, lower double")
    )
    return _not_below(pairs, pairs.select("q", F.col("lower").alias("bound")), k)


def _not_below(pairs: DataFrame, bounds: DataFrame, k: int) -> DataFrame:
    """``pairs`` whose upper bound reaches the k-th highest of their query's ``bounds`` (q, bound)."""
    kth = F.row_number().over(W.partitionBy("q").orderBy(F.desc("bound")))
    limit = bounds.withColumn("place", kth).where(F.col("place") <= k).where(F.col("place") == k).select("q", F.col("bound").alias("limit"))
    return pairs.join(limit, "q", "left").where(F.col("limit").isNull() | (F.col("upper") >= F.col("limit"))).drop("limit")


def top_points(points: DataFrame, asked: DataFrame, k: int, query_block: int, least_unit: int) -> DataFrame:
    """SCORED rows that include the k best points of each of ``asked``."""
    near = cut(candidates(points, asked, k, query_block, least_unit))
    queries = asked.select(F.col("point").alias("q"), F.col("y").alias("x"))

    def exact(pairs):
        return (
            pairs.join(points.select("point", "least", "digest", "y"), "point").join(queries, "q")
            .select("q", "point", "least", "digest", "x", "y").mapInArrow(_scores, SCORED)
        )

    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("upper"), "point"))
    first = near.withColumn("place", place).where(F.col("place") <= k).drop("place")
    read = cut(exact(first))
    rest = _not_below(near, read.select("q", F.col("floor").alias("bound")), k).join(read.select("q", "point"), ["q", "point"], "left_anti")
    return read.union(exact(rest))


def top_k(
    vectors: DataFrame, is_query: Column, k: int = K, query_block: int = QUERY_BLOCK, least_unit: int = LEAST_UNIT, rows_at_once: int = ROWS
) -> DataFrame:
    """``vectors``: vec_id, embedding. query_id, rank, vec_id, score for the rows that are queries, against all other rows."""
    rows, members, points = points_of(vectors, is_query, k)
    queries = rows.where("is_query").select("digest", F.col("vec_id").alias("query_id"), F.col("row").alias("own"))
    asked = cut(points.join(queries.select("digest").distinct(), "digest", "left_semi").select("point", "dim", "y"))
    scored = top_points(points, asked, k + 1, query_block, least_unit)
    order = [F.desc("score"), F.desc("side"), F.desc("beyond")]
    best = scored.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy(*order, "least"))).where(F.col("place") <= k + 1)
    of_rows = best.drop("place", "least", "point").join(members, "digest")
    of_rows = of_rows.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy(*order, "vec_id", "row"))).where(F.col("place") <= k + 1)
    entry = F.struct("place", "vec_id", "row", F.when(F.col("beyond").isNull(), F.col("score")).alias("score"))
    lists = of_rows.groupBy("q").agg(F.sort_array(F.collect_list(entry)).alias("found"))  # k + 1 entries
    lists = lists.join(points.select(F.col("point").alias("q"), "digest"), "q").select("digest", "found")
    # a query vector with many rows is answered in pieces; at most 1 of rows_at_once queries has one
    hot = F.broadcast(cut(queries.groupBy("digest").agg(F.ceil(F.count("*") / F.lit(rows_at_once)).cast("int").alias("pieces")).where("pieces > 1")))
    piece = F.pmod(F.xxhash64("own"), F.coalesce("pieces", F.lit(1)).cast("long"))
    queries = queries.join(hot, "digest", "left").withColumn("piece", piece).drop("pieces")
    lists = lists.join(hot, "digest", "left").select("digest", "found", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("pieces", F.lit(1)).cast("long") - 1)).alias("piece"))
    others = F.slice(F.filter("found", lambda x: x["row"] != F.col("own")), 1, k)
    out = queries.join(lists, ["digest", "piece"]).select("query_id", F.posexplode(others).alias("at", "e"))
    score = F.coalesce("e.score", F.raise_error(F.lit("score beyond a long")).cast("long"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("e.vec_id").alias("vec_id"), score.alias("score"))
