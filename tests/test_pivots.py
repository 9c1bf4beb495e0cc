import random

import numpy as np
import pytest
from mediajobs.functions.shared import new_path
from mediajobs.operators import pivots, search
from pyspark.sql import functions as F

ITEMS = "media_id long, vector array<double>, label int, note string"


def frame(spark, rows):
    return spark.createDataFrame(rows, ITEMS)


def clusters(n, dim=12, parts=20, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 4, (parts, dim))
    return middle[rng.integers(0, parts, n)] + rng.normal(0, 0.4, (n, dim))


def both(spark, items, queries, k=5, table_options=None, **options):
    """Results of the full and of the pruned search, and the share of pairs that the pruned one compared."""
    table = pivots.pivot_table(items, "vector", new_path(spark, "pivots"), columns=["label", "note"], **(table_options or {}))
    compared = spark.sparkContext.accumulator(0)
    plain = {k: v for k, v in options.items() if k not in ("unit", "query_block")}
    want = sorted(map(tuple, search.knn(queries, items, "vector", k, **plain).collect()), key=str)
    got = sorted(map(tuple, pivots.knn_pruned(queries, table, k, compared=compared, **options).collect()), key=str)
    assert got == want
    return compared.value / max(1, items.count() * queries.count())


def test_clustered_vectors_are_compared_in_few_pairs(spark):
    x = clusters(3000)
    items = frame(spark, [(i, v.tolist(), i % 4, f"n{i}") for i, v in enumerate(x)])
    queries = items.where("media_id % 30 = 0").select(F.col("media_id").alias("query_id"), F.col("vector").alias("query_vector"))
    assert both(spark, items, queries) < 0.2
    # hot cells and queries in small units; filters before and after ranking; columns carried
    both(spark, items, queries, unit=40, query_block=3, filter_expr="label < 2", carry=["note", "label"])
    both(spark, items, queries, filter_expr="label = 3", prefilter=False, carry=["note"])
    both(spark, items, queries, filter_expr="label > 9")


def test_any_vectors(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(3)], 0, "a") for i in range(300)]
    rows += [(400 + i, list(rows[7][1]), 1, f"c{i}") for i in range(40)]  # copies
    rows += [(5, list(rows[5][1]), 1, "again"), (5, [9.0, 9.0, 9.0], 1, "other"), (None, [0.0, 0.0, 0.0], 1, "null")]
    rows += [(600, None, 1, ""), (601, [], 1, ""), (602, [1.0, None, 2.0], 1, ""), (603, [float("nan")] * 3, 1, None), (604, [float("inf")] * 3, 1, None), (605, [1e100, -1e100, 0.0], 1, "far")]
    queries = [("a", list(rows[7][1])), ("b", [0.0, 0.0, 0.0]), ("b", [2.0, 2.0, 2.0]), (None, [1.0, 0.0, 0.0]), ("c", [1e100, 0.0, 0.0]), ("d", None), ("e", [1e9, 1e9, 1e9])]
    queries = spark.createDataFrame(queries, "query_id string, query_vector array<double>")
    for k in (1, 5, 1000):
        both(spark, frame(spark, rows), queries, k, dict(cell=10), carry=[])


def test_one_place_few_items_and_none(spark):
    queries = spark.createDataFrame([(1, [1.0, 1.0])], "query_id long, query_vector array<double>")
    both(spark, frame(spark, [(i, [1.0, 1.0], 0, "") for i in range(500)]), queries)
    both(spark, frame(spark, [(1, [0.5, 1.0], 0, "")]), queries)
    both(spark, frame(spark, []), queries)
    both(spark, frame(spark, [(i, [float(i), 1.0], 0, "") for i in range(200)]), queries.limit(0))


def test_sizes_are_checked(spark):
    queries = spark.createDataFrame([(1, [1.0, 1.0, 1.0])], "query_id long, query_vector array<double>")
    table = pivots.pivot_table(frame(spark, [(1, [1.0, 2.0], 0, "")]), "vector", new_path(spark, "pivots"))
    with pytest.raises(Exception, match="sizes"):
        pivots.knn_pruned(queries, table).collect()
    with pytest.raises(Exception, match="expected 2"):
        pivots.knn_pruned(queries, table, size=2).collect()
    with pytest.raises(Exception, match="sizes"):
        pivots.pivot_table(frame(spark, [(1, [1.0, 2.0], 0, ""), (2, [1.0], 0, "")]), "vector", new_path(spark, "pivots"))


def test_bounds_hold():
    x = clusters(800, 6, 5)
    p = pivots.clustered(x, 12)
    d = pivots.distances(x, p)
    cell = d.argmin(1)
    low, high = (np.stack([f(d[cell == c], 0) for c in range(12)]) for f in (np.min, np.max))
    table = pivots.PivotTable(None, "v", "i", p, low, high)
    q = clusters(40, 6, 5, seed=2)
    _, least = pivots.Bounds(table, np.bincount(cell, minlength=12)).of(list(q))
    exact = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    for c in range(12):
        assert (least[:, c] <= exact[:, cell == c].min(1)).all()
    assert (least > 0).any()


def test_search_with_repeated_media_ids(spark):
    media = spark.createDataFrame([("m1", [1.0, 0.0], "a"), ("m1", [0.0, 1.0], "b"), ("m2", [0.5, 0.5], "c"), ("m1", [1.0, 0.0], "a")], "media_id string, multimodal_vector array<double>, note string")
    queries = spark.createDataFrame([("q", "x")], "query_id string, query_text string")
    encoder = lambda texts: np.array([[1.0, 0.0]] * len(texts))
    want = [("q", 1, "m1", "a", 0.0), ("q", 2, "m1", "a", 0.0), ("q", 3, "m2", "c", 0.5), ("q", 4, "m1", "b", 2.0)]
    table = pivots.pivot_table(media, "multimodal_vector", new_path(spark, "pivots"), columns=["note"])
    for options in ({}, {"pivots": table}):
        got = search.search_by_text(queries, media, 4, encoder, **options).select("query_id", "rank", "media_id", "note", "distance").collect()
        assert sorted(map(tuple, got)) == want
