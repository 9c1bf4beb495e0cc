"""What keeps the join in proportion to its input: frequent shingles that are sparse, pivots without a dense table, texts hashed again only where needed."""

import numpy as np
import pyarrow as pa
from mediajobs.llm import jaccard

PASSAGE = "one two three four five"


def test_sparse_but_frequent_shingles_are_counted():
    texts = [f"{PASSAGE} " + " ".join(f"d{i}w{j}" for j in range(20)) for i in range(12)]
    # three holders in a batch: nothing was counted before, as four were asked for and batches stood alone
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array(range(a, a + 3)), "text": texts[a : a + 3]}) for a in range(0, 12, 3)]
    rows = [r for t in jaccard._points(iter(batches)) for r in t.to_pylist()]
    (_, passage), = jaccard.shingle_sets(pa.array([PASSAGE]))
    assert [(r["key"], r["n"]) for r in rows if r["kind"] == 1] == [(int(passage.view(np.int64)[0]), 12)]
    assert sorted(r["doc_id"] for r in rows if r["kind"] == 0) == list(range(12))


def test_most_frequent_shingles_are_kept_where_many_recur():
    sets = [np.arange(100, dtype=np.uint64), np.arange(50, dtype=np.uint64), np.arange(10, dtype=np.uint64)]
    values, times = jaccard.recurring(sets, most=10)
    assert sorted(values.tolist()) == list(range(10)) and times.tolist() == [3] * 10
    values, times = jaccard.recurring(sets)
    assert values.tolist() == list(range(50)) and times.tolist() == [3] * 10 + [2] * 40


def test_pivots_hold_no_dense_table():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 1 << 62, 1500).astype(np.uint64)) for _ in range(30)]
    sets += [np.unique(np.append(s[:-20], s[:20] + np.uint64(1))) for s in sets]
    pivots = jaccard.Pivots(list(range(60)), sets)
    held = sum(v.nbytes for v in vars(pivots).values() if isinstance(v, np.ndarray))
    assert held <= 4 * sum(s.nbytes for s in sets)  # 18 times the sets before
    for s in (*sets[::7], r.integers(0, 1 << 62, 9).astype(np.uint64), sets[0][:1]):
        both = np.array([len(np.intersect1d(s, p)) for p in sets])
        union = pivots.sizes + len(s) - both
        linked, d = pivots.near(s)
        assert np.array_equal(linked, 5 * both >= 4 * union) and np.allclose(d, 1 - both / union)


def test_only_texts_of_members_are_hashed_again(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "e f"), (None, "g h")], "doc_id long, text string")
    firsts = spark.createDataFrame([(10, 1), (20, 2), (30, 3), (40, None)], "key long, doc_id long")
    members = spark.createDataFrame([(20,), (20,), (40,)], "member long")
    assert sorted(r.text for r in jaccard._texts(docs, firsts, members).collect()) == ["c d", "g h"]


def test_kept_rows_are_neither_hashed_again_nor_shuffled(spark, tmp_path):
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(1, text, "x"), (2, text + " more", "y"), (3, text, "z"), (4, "other", "v"), (5, None, "n"), (6, " ", "n")]
    spark.createDataFrame(rows, "doc_id long, text string, extra string").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    kept = jaccard.keep_one(docs)
    first = kept._jdf.queryExecution().optimizedPlan().children().head().toString()  # rows with ids of their own
    assert "LeftAnti" in first and "MapInArrow" not in first and "Aggregate" not in first.partition("LeftAnti")[0]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6]


def test_kept_rows_are_the_same_by_ids_and_by_keys(spark):
    words = lambda name, n=30: " ".join(f"{name}{i}" for i in range(n))
    rows = [(1, words("a")), (1, words("b")), (2, words("a") + " more"), (3, words("c")), (3, words("c")), (3, words("c") + " x"), (4, words("c")), (5, words("d")), (6, words("d"))]
    rows += [(None, words("d")), (None, words("e")), (None, words("e") + " x"), (7, None), (7, ""), (7, words("f")), (8, "\n"), (None, " "), (9, words("g"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    by_id, by_key = ([tuple(r) for r in jaccard.keep_one(docs, wanted).collect()] for wanted in (jaccard.WANTED, -1))
    assert sorted(by_id, key=str) == sorted(by_key, key=str)
    assert sorted((i for i, _ in by_id), key=str) == sorted([1, 1, 3, 5, None, 7, 7, 7, 8, None, 9], key=str)
