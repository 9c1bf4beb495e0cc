import math
import random

import numpy as np
from mediajobs.llm import learned, queries
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, score string"
TABLES = "/root/testdata/sf0.1"


def brute(rows, k, every=3):
    """The k nearest of each query by cosine; rows of its own length, itself left out."""
    good = [
        (i, np.array(v, np.float32).astype(float)) for i, v, _ in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)
    ]
    out = []
    for own, (q, a) in enumerate(good):
        if q % every == 0:
            found = sorted((-learned.cosine(a, b), i) for at, (i, b) in enumerate(good) if at != own and len(a) == len(b))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def near(got, want):
    got = sorted(map(tuple, got))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-13, atol=0)


def test_recall_of_the_query(spark):
    rows = [(r.vec_id, list(r.embedding), "") for r in spark.read.parquet(f"{TABLES}/embeddings.parquet").collect()]
    want = brute(rows, 5, 50)
    got = [tuple(r) for r in queries.op13_learned_partitions(spark, TABLES).collect()]
    assert len(got) == len(want) and len({g[:2] for g in got}) == len(got)
    assert len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)
    exact = {(q, i): s for q, _, i, s in brute(rows, len(rows), 50)}
    assert all(math.isclose(s, exact[q, i], rel_tol=1e-12) for q, _, i, s in got)
    lists = {}
    for q, rank, i, s in sorted(got):
        lists.setdefault(q, []).append((-s, i))
    assert all(found == sorted(found) for found in lists.values())


def test_clusters_need_few_partitions(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(0, 1, (24, 16)) * 3
    x = middle[rng.integers(0, 24, 4000)] + rng.normal(0, 0.3, (4000, 16))
    router = learned.fitted(learned.unit_rows([v.tobytes() for v in x[:2048]]), len(x))
    rows = [(i, v.tolist(), "") for i, v in enumerate(x)]
    assert router.parts >= 16 and router.probes <= router.parts // 3
    got = learned.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, sample=2048, unit=50, query_block=7).collect()
    want = brute(rows, 5, 50)
    assert len({(r.query_id, r.vec_id) for r in got} & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)


def test_all_partitions_equal_brute_force(spark):
    r = random.Random(7)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)], "x") for i in range(700)]
    rows += [(1000 + i, [x * (2, 3, -1)[i % 3] for x in rows[3][1]], "x") for i in range(30)]  # the same direction
    rows += [(1100 + i, list(rows[6][1]), "x") for i in range(12)] + [(9, list(rows[9][1]), "x"), (9, list(rows[12][1]), "x")]
    rows += [(2000, None, "x"), (2001, [], "x"), (2004, [1.0, None], "x"), (2007, [math.nan] * 6, "x"), (2010, [math.inf] * 6, None), (2013, [0.0] * 6, "x")]
    rows += [(None, [1.0] * 6, "x"), (3000, [1.0, 2.0], "x"), (3003, [0.5, -2.0], "x"), (4002, [3.0] * 9, "x"), (4005, [1e30, 1e-30] * 3, ""), (4008, [1e-38] * 6, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    for unit, block in ((16384, 4096), (40, 9)):
        near(learned.search(df, F.col("vec_id") % 3 == 0, target=1.0 + 1e-9, unit=unit, query_block=block, rows_at_once=5).collect(), brute(rows, 5))


def test_every_query_gets_its_rows(spark):
    # most points in one direction: partitions are far from equal in the whole table
    r = np.random.default_rng(1)
    rows = [(i, (r.normal(0, 1, 4) + (0 if i % 9 == 0 else 30)).tolist(), "") for i in range(1500)]
    got = learned.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 3 == 0, target=0.3, sample=600)
    assert got.count() == 5 * 500


def test_balanced_partitions():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (1200, 8)) + np.where(np.arange(1200) < 900, 4, -4)[:, None]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near_ = learned.nearest(x, np.arange(1200), 10)
    start = learned.halved(x, 12)
    label = learned.balanced(near_, start, 12)
    inside = lambda c: (c[near_] == c[:, None]).mean()
    assert np.bincount(label, minlength=12).max() <= 110 and inside(label) > inside(start)


def test_empty_table_and_other_columns(spark):
    assert learned.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0
    assert learned.search(spark.createDataFrame([(0, [1.0], "")], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0
    clash = spark.createDataFrame([(0, [1.0, 0.0], 1, 2), (1, [3.0, 4.0], 3, 4)], "vec_id long, embedding array<float>, point int, part int")
    assert [tuple(r) for r in learned.search(clash, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 0.6)]
