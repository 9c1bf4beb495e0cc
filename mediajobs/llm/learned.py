"""Approximate nearest neighbours by learned partitions (operator 13).

1. Points. Rows with the same vector (but for a power of two as factor) are one
   point, known by a 128-bit digest, which keeps its k + 1 smallest rows by id.
2. Graph. A sample of at most SAMPLE points (those of the smallest hashes) is joined
   to its NEIGHBOURS nearest exactly, on the driver. The graph is cut into balanced
   partitions: halves along principal directions first, then points move to the
   partition of most of their neighbours, as long as no partition outgrows SLACK.
3. Classifier. A network with one hidden layer learns, from a point's vector, the
   shares of its neighbours' partitions. An eighth of the sample takes no part in
   this: it tells how many of the most probable partitions a query must visit to
   find TARGET of its neighbours.
4. Index. Every point goes to its most probable partition.
5. Search. Queries meet the points of the partitions that they visit, in units of
   bounded size; a unit gives each query its k + 1 best. A product finds what may be
   among them, exact sums decide.
6. Points are replaced by their rows, and each query leaves out its own row.

The model is fitted on a bounded sample, but every row is indexed, and each query
is compared exactly with all rows of the partitions that it visits. Recall is
measured against brute force in the tests. The number of partitions is bounded by
the sample, so beyond some millions of points partitions grow with the table.

Scores are cosines in double precision. Ties go to the smaller id. Vectors that
are null, empty, zero, or hold null or non-finite components take no part, nor do
rows with null ids. Vectors are compared with those of the same length only; lengths
with fewer than LEAST_SAMPLE sampled points have one partition and are searched
exactly. Repeated ids are rows of their own: each is searched for on its own and
skips itself only. Fewer than k candidates give fewer rows; an empty table none. A
query visits further partitions until these hold k + 1 points. Other columns aren't
looked at.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sizes import small
from .common import cut
from .vectors import finite

K = 5
#: Points that the model is fitted on at most, and of one length at least.
SAMPLE, LEAST_SAMPLE = 8192, 256
NEIGHBOURS = 10
#: Points of a partition, about, and partitions at most.
PART_POINTS, MOST_PARTS = 128, 128
#: Sampled points of a partition over the mean, at most.
SLACK = 1.1
HIDDEN, EPOCHS, BATCH, RATE = 128, 24, 128, 2e-3
#: Share of the neighbours of sampled queries that the visited partitions hold at least.
TARGET = 0.95
#: Points and queries of a unit, and queries with the same vector answered in one piece.
UNIT, QUERY_BLOCK, ROWS = 16384, 4096, 8192
SEED = 5


def _scaled(batches):
    """Rows (vec_id, is_query, x) with the length, digest and bytes of the vector over a power of two."""
    for b in batches:
        ends = np.cumsum(np.append(0, b.column(2).value_lengths().to_numpy(zero_copy_only=False))).tolist()
        flat = b.column(2).flatten().to_numpy(zero_copy_only=False)
        y = []
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            v = flat[lo:hi]
            # exact, and no sum of squares overflows or vanishes
            y.append((np.ldexp(v, -int(np.frexp(np.abs(v).max())[1])) + 0.0).tobytes())
        digest = [hashlib.blake2b(v, digest_size=16).digest() for v in y]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([len(v) // 8 for v in y], pa.int32()), pa.array(digest, pa.binary()), pa.array(y, pa.binary())],
            ["vec_id", "is_query", "dim", "digest", "y"],
        )


def points_of(vectors: DataFrame, is_query: Column, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows that take part; the k + 1 smallest rows of each point; the points, numbered."""
    x = F.col("embedding").cast("array<double>")
    rows = cut(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), x.alias("x"))
        .where(F.col("vec_id").isNotNull() & finite(F.col("x")) & F.exists("x", lambda v: v != 0))
        .mapInArrow(_scaled, "vec_id long, is_query boolean, dim int, digest binary, y binary")
        .withColumn("row", F.monotonically_increasing_id())
    )
    # a limit on row_number is applied before the shuffle, too, so a vector with any share of the rows is no hot group
    place = F.row_number().over(W.partitionBy("digest").orderBy("vec_id", "row"))
    members = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    points = cut(
        members.where("place = 1").select("digest", "dim", "y", F.col("vec_id").alias("least")).withColumn("point", F.monotonically_increasing_id())
    )
    return rows, members.select("digest", "vec_id", "row"), points


def unit_rows(y: list) -> np.ndarray:
    m = np.stack([np.frombuffer(v, np.float64) for v in y])
    return m / np.sqrt((m**2).sum(1, keepdims=True))


def nearest(x: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of ``x`` for the rows numbered ``of``, nearest first."""
    out = np.empty((len(of), k), np.int64)
    for lo in range(0, len(of), 1024):
        own = of[lo : lo + 1024]
        s = x[own] @ x.T
        s[np.arange(len(own)), own] = -np.inf
        best = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out[lo : lo + 1024] = np.take_along_axis(best, np.argsort(-np.take_along_axis(s, best, 1), axis=1, kind="stable"), 1)
    return out


def halved(x: np.ndarray, parts: int) -> np.ndarray:
    """Partitions of equal size by cuts along principal directions."""
    label = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        at, first, n = todo.pop()
        label[at] = first
        if n > 1 and len(at) > 1:
            m = x[at] - x[at].mean(0)
            side = np.linalg.eigh(m.T @ m)[1][:, -1]
            order = at[np.argsort(m @ side, kind="stable")]
            lower = n // 2
            cut_at = len(at) * lower // n
            todo += [(order[:cut_at], first, lower), (order[cut_at:], first + lower, n - lower)]
    return label


def balanced(near: np.ndarray, label: np.ndarray, parts: int, rounds: int = 6) -> np.ndarray:
    """``label`` after moves of points to the partition of most of their neighbours in the graph ``near``, sizes within SLACK."""
    n, k = near.shape
    a = np.concatenate([np.repeat(np.arange(n), k), near.ravel()])
    b = np.concatenate([near.ravel(), np.repeat(np.arange(n), k)])
    order = np.argsort(a, kind="stable")
    b, edges = b[order], np.searchsorted(a[order], np.arange(n + 1))
    label = label.copy()
    held = np.zeros((n, parts), np.int32)
    np.add.at(held, (a, label[np.concatenate([near.ravel(), np.repeat(np.arange(n), k)])]), 1)
    sizes, most = np.bincount(label, minlength=parts), math.ceil(SLACK * n / parts)
    least = math.floor(n / parts / SLACK)
    for _ in range(rounds):
        gain = held.max(1) - held[np.arange(n), label]
        moved = 0
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())].tolist():
            own = label[i]
            open_ = np.where(sizes < most, held[i], -1)
            to = int(open_.argmax())
            if open_[to] > held[i, own] and sizes[own] > least:
                label[i] = to
                sizes[own] -= 1
                sizes[to] += 1
                around = b[edges[i] : edges[i + 1]]
                np.add.at(held, (around, own), -1)
                np.add.at(held, (around, to), 1)
                moved += 1
        if not moved:
            break
    return label


@dataclass
class Router:
    """The classifier of one vector length; ``probes`` partitions are visited at least."""

    layers: list[np.ndarray]
    probes: int = 1
    sizes: np.ndarray | None = None

    @property
    def parts(self) -> int:
        return len(self.layers[3])

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.layers
        return np.maximum(x @ w + b, 0) @ v + c

    def visited(self, x: np.ndarray, k: int) -> list[np.ndarray]:
        """Partitions for each row of ``x``, most probable first; together they hold k points, if all do."""
        order = np.argsort(-self.logits(x), axis=1, kind="stable")
        held = np.cumsum(self.sizes[order], axis=1)
        enough = (held < k).sum(1) + 1
        return [o[: max(self.probes, e)] for o, e in zip(order, enough.tolist(), strict=True)]


def trained(x: np.ndarray, shares: np.ndarray, seed: int) -> list[np.ndarray]:
    """Layers of the network that gives ``shares`` (rows sum to 1) for ``x``, by stochastic gradients (Adam)."""
    r = np.random.default_rng(seed)
    dim, parts = x.shape[1], shares.shape[1]
    layers = [r.normal(0, math.sqrt(2), (dim, HIDDEN)), np.zeros(HIDDEN), r.normal(0, math.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    first, second = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    t = 0
    for epoch in range(EPOCHS):
        order = r.permutation(len(x))
        rate = RATE * (1 - epoch / EPOCHS)
        for lo in range(0, len(x), BATCH):
            at = order[lo : lo + BATCH]
            hidden = np.maximum(x[at] @ layers[0] + layers[1], 0)
            z = hidden @ layers[2] + layers[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - shares[at]) / len(at)
            back = (g @ layers[2].T) * (hidden > 0)
            t += 1
            for i, d in enumerate((x[at].T @ back, back.sum(0), hidden.T @ g, g.sum(0))):
                first[i] += 0.1 * (d - first[i])
                second[i] += 0.001 * (d * d - second[i])
                layers[i] = layers[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return layers


def fitted(x: np.ndarray, n: int, k: int = K, target: float = TARGET, seed: int = SEED) -> Router | None:
    """A router for about ``n`` points of which ``x`` (unit rows, in random order) is a sample; none if one partition will do."""
    taught = len(x) - len(x) // 8
    parts = min(MOST_PARTS, n // PART_POINTS, taught // 16)
    if parts < 2:
        return None
    near = nearest(x[:taught], np.arange(taught), NEIGHBOURS)
    label = balanced(near, halved(x[:taught], parts), parts)
    shares = np.zeros((taught, parts))
    np.add.at(shares, (np.repeat(np.arange(taught), NEIGHBOURS), label[near].ravel()), 1.0)
    shares[np.arange(taught), label] += NEIGHBOURS / 2
    router = Router(trained(x[:taught], shares / shares.sum(1, keepdims=True), seed))
    # neighbours of the points that weren't taught: in which of their most probable partitions are they?
    logits = router.logits(x)
    asked = np.arange(taught, len(x))
    where = logits.argmax(1)[nearest(x, asked, k)]
    rank = (logits[asked][:, None, :] > np.take_along_axis(logits[asked], where, 1)[:, :, None]).sum(2)
    found = np.cumsum(np.bincount(rank.ravel(), minlength=parts)) / rank.size
    router.probes = int(np.searchsorted(found, target - 1e-12)) + 1
    return router


def routers_of(points: DataFrame, k: int, target: float, sample: int) -> dict[int, Router]:
    """Routers by vector length, fitted on the points of the smallest hashes."""
    n, marks = points.count(), 1 << 30
    most = marks if n <= sample else math.ceil(marks * min(1.0, 1.1 * sample / n + 64 / n))
    mark = F.xxhash64("digest")
    drawn = points.where(F.pmod(mark, F.lit(marks)) < most).select(F.pmod(mark, F.lit(marks)).alias("mark"), "digest", "dim", "y").collect()
    drawn = sorted(drawn, key=lambda r: (r.mark, bytes(r.digest)))[:sample]
    by_dim: dict[int, list] = {}
    for r in drawn:
        by_dim.setdefault(r.dim, []).append(r.y)
    fits = {d: fitted(unit_rows(y), n * len(y) // len(drawn), k, target) for d, y in by_dim.items() if len(y) >= LEAST_SAMPLE}
    return {d: r for d, r in fits.items() if r}


def _routed(routers: dict[int, Router], visits: int | None):
    """Rows (point, dim, y, ...) with their partition; with ``visits``, a row for each partition that a query visits to see so many points."""

    def run(batches):
        for b in batches:
            dims = b.column(1).to_numpy()
            at, part = [], []
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                router = routers.get(dim)
                for lo in range(0, len(rows), 1024):
                    own = rows[lo : lo + 1024]
                    if router is None:
                        found = [[0]] * len(own)
                    else:
                        x = unit_rows([b.column(2)[i].as_buffer() for i in own.tolist()])
                        found = router.visited(x, visits) if visits else router.logits(x).argmax(1)[:, None]
                    at.append(np.repeat(own, [len(f) for f in found]))
                    part.append(np.concatenate(found))
            if at:
                out = b.take(pa.array(np.concatenate(at)))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(part), pa.int32())], [*out.schema.names, "part"])

    return run


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine with exactly rounded sums."""
    return math.fsum((a * b).tolist()) / math.sqrt(math.fsum((a * a).tolist()) * math.fsum((b * b).tolist()))


class Best:
    """The ``k`` best points so far of each query of a unit."""

    #: Rounding of a product of unit rows, with room.
    ROUND = 1e-12

    def __init__(self, points: list[int], y: list, k: int):
        self.points, self.k = points, k
        self.y = [np.frombuffer(v, np.float64) for v in y]
        self.q = unit_rows(y)
        self.best: list[list[tuple[float, int, int]]] = [[] for _ in points]  # (-score, least, point)
        self.limit = np.full(len(points), -np.inf)

    def see(self, points: list[int], leasts: list[int], y: list) -> None:
        x = unit_rows(y)
        for at in range(0, len(self.q), 1024):
            s = self.q[at : at + 1024] @ x.T
            limit = self.limit[at : at + 1024]
            if s.shape[1] > self.k:
                limit = np.maximum(limit, np.partition(s, s.shape[1] - self.k, axis=1)[:, -self.k] - self.ROUND)
            found: dict[int, list] = {}
            for i, j in zip(*(v.tolist() for v in np.nonzero(s >= limit[:, None])), strict=True):
                found.setdefault(at + i, []).append((-cosine(self.y[at + i], np.frombuffer(y[j], np.float64)), leasts[j], points[j]))
            for i, more in found.items():
                self.best[i] = sorted(self.best[i] + more)[: self.k]
                if len(self.best[i]) == self.k:
                    self.limit[i] = -self.best[i][-1][0] - self.ROUND

    def rows(self) -> pa.RecordBatch:
        flat = [(q, point, least, -score) for q, best in zip(self.points, self.best, strict=True) for score, least, point in best]
        columns = list(zip(*flat, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.float64())], ["q", "point", "least", "score"])


def _compared(k: int):
    """Rows sorted by unit (dim, part, piece, block) and kind: a unit's queries (kind 0), then its points."""

    def run(batches):
        name, best, asked = None, None, ([], [])
        for b in batches:
            units = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(5)], 1)
            edges = np.append(0, np.append(np.flatnonzero((units[1:] != units[:-1]).any(1)) + 1, len(units)))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if lo == hi:
                    continue
                *own, kind = units[lo].tolist()
                if own != name:
                    if best:
                        yield best.rows()
                    name, best, asked = own, None, ([], [])
                run_of = b.slice(lo, hi - lo)
                y = [v.as_buffer() for v in run_of.column(7)]
                if kind == 0:
                    asked[0].extend(run_of.column(5).to_pylist())
                    asked[1].extend(y)
                elif asked[0]:
                    best = best or Best(*asked, k)
                    points, leasts = run_of.column(5).to_pylist(), run_of.column(6).to_pylist()
                    for at in range(0, len(y), 1024):
                        best.see(points[at : at + 1024], leasts[at : at + 1024], y[at : at + 1024])
        if best:
            yield best.rows()

    return run


ROUTED = "point long, dim int, y binary, least long, part int"


def top_points(points: DataFrame, asked: DataFrame, k: int, target: float = TARGET, sample: int = SAMPLE, unit: int = UNIT, query_block: int = QUERY_BLOCK) -> DataFrame:
    """q, point, least, score: the k best points found for each of ``asked`` (point, dim, y), and others."""
    routers = routers_of(points, k, target, sample)
    index = cut(points.select("point", "dim", "y", "least").mapInArrow(_routed(routers, None), ROUTED))
    sizes = index.groupBy("dim", "part").agg(F.count("*").alias("n"))
    for dim, router in routers.items():
        router.sizes = np.zeros(router.parts, np.int64)
    # at most MOST_PARTS rows for each length that is fitted
    for dim, part, n in sizes.where(F.col("dim").isin(list(routers))).collect():
        routers[dim].sizes[part] = n
    calls = cut(asked.select("point", "dim", "y", F.lit(0).cast("long").alias("least")).mapInArrow(_routed(routers, k), ROUTED))
    # partitions of many points or queries are cut into pieces
    cuts = lambda rows, n, name: rows.groupBy("dim", "part").agg(F.ceil(F.count("*") / F.lit(n)).cast("int").alias(name)).where(F.col(name) > 1)
    large = small(cut(cuts(index, unit, "pieces").join(cuts(calls, query_block, "blocks"), ["dim", "part"], "full").na.fill(1)))

    def side(rows, kind):
        rows = rows.join(large, ["dim", "part"], "left").na.fill(1, ["pieces", "blocks"])
        n, copies = ("blocks", "pieces") if kind == 0 else ("pieces", "blocks")
        own = F.pmod(F.xxhash64("point"), F.col(n).cast("long")).cast("int")
        rows = rows.withColumn("own", own).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(copies) - 1)))
        piece, block = ("copy", "own") if kind == 0 else ("own", "copy")
        return rows.select("dim", "part", F.col(piece).alias("piece"), F.col(block).alias("block"), F.lit(kind).alias("kind"), "point", "least", "y")

    keys = ["dim", "part", "piece", "block"]
    return (
        side(calls, 0).union(side(index, 1)).repartition(*keys).sortWithinPartitions(*keys, "kind")
        .mapInArrow(_compared(k), "q long, point long, least long, score double")
    )


def search(
    vectors: DataFrame, is_query: Column, k: int = K, target: float = TARGET, sample: int = SAMPLE, unit: int = UNIT, query_block: int = QUERY_BLOCK, rows_at_once: int = ROWS
) -> DataFrame:
    """``vectors``: vec_id, embedding. query_id, rank, vec_id, score of the k nearest other rows found for the rows that are queries."""
    rows, members, points = points_of(vectors, is_query, k)
    queries = rows.where("is_query").select("digest", F.col("vec_id").alias("query_id"), F.col("row").alias("own"))
    asked = cut(points.join(queries.select("digest").distinct(), "digest", "left_semi").select("point", "dim", "y"))
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "least"))
    best = top_points(points, asked, k + 1, target, sample, unit, query_block).withColumn("place", place).where(F.col("place") <= k + 1)
    of_rows = best.join(points.select("point", "digest"), "point").join(members, "digest")
    order = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id", "row"))
    of_rows = of_rows.withColumn("place", order).where(F.col("place") <= k + 1)
    lists = of_rows.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "row", "score"))).alias("found"))  # k + 1 entries
    lists = lists.join(points.select(F.col("point").alias("q"), "digest"), "q").select("digest", "found")
    # a query vector with many rows is answered in pieces
    hot = small(cut(queries.groupBy("digest").agg(F.ceil(F.count("*") / F.lit(rows_at_once)).cast("int").alias("pieces")).where("pieces > 1")))
    piece = F.pmod(F.xxhash64("own"), F.coalesce("pieces", F.lit(1)).cast("long"))
    queries = queries.join(hot, "digest", "left").withColumn("piece", piece).drop("pieces")
    lists = lists.join(hot, "digest", "left").select("digest", "found", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("pieces", F.lit(1)).cast("long") - 1)).alias("piece"))
    others = F.slice(F.filter("found", lambda x: x["row"] != F.col("own")), 1, k)
    out = queries.join(lists, ["digest", "piece"]).select("query_id", F.posexplode(others).alias("at", "e"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))
