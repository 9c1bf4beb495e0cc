import math
import random

import numpy as np
import pytest
from mediajobs.llm import vectors
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, score string"
BLOCKS = ((8192, 16384, 8192), (13, 20, 2))


def brute(rows, k):
    """Each row is a candidate of all other rows of its length, and a query if its id is a multiple of 3."""
    ints = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, v, _ in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for own, (q, a) in enumerate(ints):
        if q % 3 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for at, (i, b) in enumerate(ints) if at != own and len(a) == len(b))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def check(spark, rows, k=5):
    df, want = spark.createDataFrame(rows, SCHEMA), brute(rows, k)
    for blocks in BLOCKS:
        got = vectors.top_k(df, F.col("vec_id") % 3 == 0, k, *blocks).collect()
        assert sorted(map(tuple, got)) == want


def test_equals_brute_force(spark):
    r = random.Random(7)
    rows = [(i, [r.choice([-1.5, r.gauss(0, 1), 0.25]) for _ in range(6)], "x") for i in range(150)]
    rows += [(1000 + i, list(rows[3][1]), "x") for i in range(9)]  # equal vectors
    rows += [(2000, None, "x"), (2001, [], "x"), (2004, [1.0, None], "x"), (2007, [math.nan] * 6, "x"), (2010, [math.inf] * 6, None)]
    rows += [(None, [1.0] * 6, "x"), (3000, [1.0, 2.0], "x"), (3003, [0.5, -2.0], "x"), (4002, [3.0] * 9, "x")]
    check(spark, rows)


def test_repeated_ids_are_rows_of_their_own(spark):
    r = random.Random(8)
    rows = [(i % 12, [r.gauss(0, 1) for _ in range(4)], "x") for i in range(40)]
    rows += [(9, list(rows[9][1]), "x"), (9, list(rows[9][1]), "x"), (3, list(rows[9][1]), "x")]
    check(spark, rows)


def test_large_components_take_part(spark):
    r = random.Random(5)
    # up to scores near 2**63
    rows = [(i, [r.gauss(0, 1) * r.choice([1, 1, 1, 5e4, 1e5, 2e6]) for _ in range(6)], "x") for i in range(160)]
    rows += [(500 + i, list(rows[i][1]), "x") for i in range(12)]
    assert any(abs(x) > 1e6 for _, v, _ in rows for x in v)
    check(spark, rows)


def test_many_dimensions_of_large_components(spark):
    r = random.Random(6)
    base = [r.choice([-1, 1]) * 32767.0 for _ in range(512)]
    check(spark, [(i, [x - r.choice([0, 1, 2]) / 256 for x in base], "x") for i in range(40)])


def test_scores_beyond_a_long(spark):
    # far below the k best they only rank last; among them they are an error
    rows = [(0, [1e30, 1.0], "x"), (1, [-3e38, 1.0], "x"), (2, [-2e38, 1.0], "x"), (4, [0.0, 1.0], "x"), (5, [0.0, 2.0], "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = vectors.top_k(df, F.col("vec_id") == 0, 2, 2, 2).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 5, 256 * 512), (0, 2, 4, 256 * 256)]
    with pytest.raises(Exception, match="beyond a long"):
        vectors.top_k(df, F.col("vec_id") == 0, 3).collect()


def test_queries_that_tie_with_all(spark):
    r = random.Random(9)
    rows = [(i, [0.0] * 4 if i in (3, 6, 30) else [r.gauss(0, 1) for _ in range(4)], "x") for i in reversed(range(200))]
    check(spark, rows)
    _, _, points = vectors.points_of(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 3, 5)
    asked = points.where("least = 3").select("point", "dim", "y")
    units = 4
    assert vectors.candidates(points, asked, 6, 8192, 50).count() <= 6 * units


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for scale in (1.0, 1e6, 1e150):
        y = vectors.floored(rng.normal(0, scale, (500, 24)))
        middle, around = vectors.bounds(y[:20], *vectors.encoded(y))
        exact = np.array([[vectors.inner(a, b) / vectors.SCALE**2 for b in y] for a in y[:20]])
        assert (exact <= middle + around[:, None]).all() and (exact >= middle - around[:, None]).all()
        assert (around < 0.2 * np.abs(exact).max()).all()


def test_exact_vectors_are_read_for_few_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 1, 32).tolist(), "x") for i in range(3000)]
    _, _, points = vectors.points_of(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0, 5)
    asked = points.where("least % 100 = 0").select("point", "dim", "y")
    near = vectors.candidates(points, asked, 6, 8192, 16384).count()
    read = vectors.top_points(points, asked, 6, 8192, 16384).count()
    assert 30 * 6 <= read <= near < 30 * 60  # of 30 * 3,000 pairs


def test_empty_table_and_other_columns(spark):
    assert vectors.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0
    clash = spark.createDataFrame([(0, [1.0, 2.0], 1, 2), (1, [2.0, 1.0], 3, 4)], "vec_id long, embedding array<float>, row int, digest int")
    assert [tuple(r) for r in vectors.top_k(clash, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 4 * 65536)]
