import math
import re
from collections import defaultdict

import pytest
from mediajobs.llm import mixing

SCHEMA = "doc_id long, text string, source string, target string"


def brute_targets(sizes):
    """sizes: source -> size; plain resharing until no source is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total = 1.5 * sum(sizes.values())
    target, fixed = {}, set()
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(2 * sizes[s] for s in fixed)
        w = sum(weight[s] for s in free)
        target = {s: 2.0 * sizes[s] if s in fixed else left * weight[s] / w for s in order}
        over = [s for s in free if target[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return target
        fixed.update(over)


def documents():
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 50)), f"s{i % 5}" if i % 3 else "big", "x") for i in range(900)]
    rows += [(2000 + i, "a b c", None, "x") for i in range(40)]
    rows += [(3000, None, "s1", "x"), (3001, "", "empty", "x"), (None, "a b", "s2", "x"), (7, "w " * 9, "s2", "x"), (7, "w " * 9, "s2", "x")]
    return rows


def test_targets_and_taken(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.digest(docs).collect()
    assert len(out) == len(rows)
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += size(t)
    want = brute_targets(dict(sizes))
    source = {i: s for i, t, s, _ in rows}
    taken = defaultdict(int)
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s])
        assert r.taken % max(r["size"], 1) == 0
        assert r.taken <= 2 * r["size"]
        assert r.taken >= math.floor(r.target / max(r.source_size, 1)) * r["size"]
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 50
    again = sorted(map(tuple, mixing.digest(docs.repartition(7)).collect()), key=str)
    assert again == sorted(map(tuple, out), key=str)


def test_mixed_rows_match_taken(spark):
    rows = [r for r in documents() if r[0] != 7] + [(8000, " ".join(["w"] * 30000), "s3", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    copies = {r.doc_id: r["count"] for r in mixing.mixed(docs).groupBy("doc_id").count().collect()}
    for r in mixing.digest(docs).collect():
        assert copies.get(r.doc_id, 0) * r["size"] == r.taken
    assert mixing.mixed(docs).columns == docs.columns


def test_equal_rows_at_the_edge(spark):
    # one source of equal rows, and another to take words from: some of them are sampled, no more than the digest says
    rows = [(5, "a b c d", "b", "x")] * 101 + [(i, "a b c", "a", "x") for i in range(50)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = sum(r.taken for r in mixing.digest(docs).collect() if r.doc_id == 5 and r["size"] == 4)
    got = mixing.mixed(docs).where("doc_id = 5 and source = 'b'").count()
    assert 4 * got == want
    assert got % 101


def test_quality_weight(spark):
    texts = ["one two three four five six seven eight nine ten", "a a a a a a a a a a", "same line\nsame line\nsame line", "$$$ %%% ### a b c d e f g", "word", None, ""]
    docs = spark.createDataFrame([(i, t, "s", "x") for i, t in enumerate(texts)], SCHEMA)
    q = {r.doc_id: r.q for r in docs.select("doc_id", mixing.quality_column(docs.text).alias("q")).collect()}
    assert q[0] == pytest.approx(0.5)
    assert q[5] == q[6] == q[3] == 0.05
    assert max(q[1], q[2], q[4]) < 0.2


def test_better_documents_are_taken_more_often(spark):
    rows = [(i, ("%%%% aaaa bb cc dd " if i % 2 else "aaaa bb cc dd ee ") * 4, "a" if i < 3000 else "b", "x") for i in range(4000)]
    out = mixing.digest(spark.createDataFrame(rows, SCHEMA)).where("source_size = 60000").collect()
    good = sum(r.taken for r in out if r.doc_id % 2 == 0)
    assert good > 1.1 * sum(r.taken for r in out if r.doc_id % 2)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.digest(docs).count() == 0
    assert mixing.mixed(docs).count() == 0
