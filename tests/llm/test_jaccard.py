import random
import re

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from mediajobs.llm import jaccard


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        r = find(a)
        least[r] = min((v for v in (least.get(r), i) if v is not None), default=None)
    return sorted(((i, len(s), least[find(a)]) for a, (i, s) in enumerate(sets)), key=str)


def near_copies(seed, groups=6, size=12):
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for g in range(groups):
        base = [f"g{g}w{r.randrange(400)}" for _ in range(r.randrange(8, 120))]
        for _ in range(size):
            words = list(base)
            for _ in range(r.randrange(5)):
                words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
            if r.random() < 0.3:
                words += passage
            rows.append((len(rows), " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  b"), (1004, "a b c"), (None, rows[0][1]), (None, "q")]
    rows += [rows[3], rows[3], (2000, " ".join(f"L{i}" for i in range(40000)))]
    return rows


@pytest.mark.parametrize(("block", "frequent"), [(256, 128), (4, 6)])
def test_matches_brute_force(spark, block, frequent):
    rows = near_copies(block)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
    got = jaccard.near_duplicates(docs.repartition(3), block, frequent).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_keep_one_and_empty(spark):
    schema = "doc_id long, text string, extra string"
    assert jaccard.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(3, "a b c d e f", "x"), (1, "a b c d e f", "y"), (2, "z", None), (2, "z", None), (9, None, "n")], schema)
    assert sorted(tuple(r) for r in jaccard.keep_one(docs).collect()) == [(1, "a b c d e f", "y"), (2, "z", None), (9, None, "n")]
    assert jaccard.keep_one(docs).columns == docs.columns


@pytest.mark.parametrize("spread", [3, 40])
def test_large_groups_of_near_copies(spark, spread):
    # distinct texts of one group, all or few of them near each other, and some that only share its beginning
    r = random.Random(spread)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(r.randrange(1, spread)):
            words[r.randrange(60, 120)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base[:30] + [f"y{i}z{j}" for j in range(90)])) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
    got = jaccard.near_duplicates(docs.repartition(3), 16).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def bodies(spark, texts):
    rows = [(i, zstandard.compress(t.encode())) for i, t in texts]
    return spark.createDataFrame(rows, "member long, body binary")


def test_windows_divide_and_recurse(spark):
    """One region of eight families: two of a family share much but don't link, two of different families share one passage."""
    r = random.Random(5)
    shared = [f"p{i}" for i in range(12)]
    texts, family = [], {}
    for f in range(8):
        base = [f"f{f}w{i}" for i in range(200)]
        for k in range(30):
            words = list(base)
            for at in r.sample(range(0, 200, 5), 3):  # unlinked relatives
                words[at] = f"f{f}k{k}x{at}"
            for copy in range(2):  # and one near copy of each
                if copy:
                    words[r.randrange(200)] = f"f{f}k{k}c"
                family[len(texts)] = f
                texts.append((len(texts), " ".join(shared + words)))
    n = len(texts)
    large = spark.createDataFrame([(7, i, n) for i in range(n)], "region long, member long, parent long")
    links, cells = jaccard.by_pivots(large, bodies(spark, texts), 16, pivots=48)
    assert len(links) >= 2  # recursion: one list of links for each round
    pairs, root = set(), {i: i for i in range(n)}
    for c in cells:
        members = {}
        for x in c.collect():
            members.setdefault((x.pivot, x.i, x.j), []).append(x.member)
        pairs |= {(a, b) for m in members.values() for a in m for b in m if a < b}
    # windows keep families apart but for few boundary members
    assert sum(family[a] != family[b] for a, b in pairs) < 0.25 * sum(family[a] != family[b] for a in range(n) for b in range(a))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in links:
        for x in e.collect():
            root[find(x.u)] = find(x.v)
    sets = [shingles(t) for _, t in texts]
    linked = [(a, b) for b in range(n) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(linked) >= n // 2
    assert all((a, b) in pairs or find(a) == find(b) for a, b in linked)


def test_packed_heads_and_bodies_are_exact():
    r = np.random.default_rng(3)
    for n in (1, 2, 700):
        h = np.unique(r.integers(0, 1 << 24, n).astype(np.uint32))
        assert np.array_equal(jaccard.head_of(jaccard.packed_head(h)), h)
    texts = ["a b c d e f", "Ü b", "w " * 2_000_000, " ".join(map(str, range(300_000))), "x"]
    got = list(jaccard.sets_of(pa.array([zstandard.compress(t.encode()) for t in texts], pa.binary())))
    want = [s for _, s in jaccard.shingle_sets(pa.array(texts))]
    assert len(got) == len(texts) and all(map(np.array_equal, got, want))


def test_a_group_of_near_copies_needs_no_cells(spark):
    r = random.Random(1)
    texts, rows = [], []
    base = [f"w{i}" for i in range(404)]
    for i in range(2000):
        words = list(base)
        words[r.randrange(404)] = f"x{i}"
        texts.append((i, " ".join(words)))
        rows.append((7, i, 2000))
    large = spark.createDataFrame(rows, "region long, member long, parent long")
    links, cells = jaccard.by_pivots(large, bodies(spark, texts), 64)
    assert sum(c.count() for c in cells) == 0
    assert sum(e.count() for e in links) < 2000 * 4
    found = jaccard.components(links[0], hot=50).collect()
    assert {x.root for x in found} == {0} and len(found) == 2000


def test_runs_over_any_batches():
    import pyarrow as pa

    r = random.Random(4)
    rows = sorted({(r.randrange(6), r.randrange(3), r.choice([5, 6, 10, 11, 40, 200]), r.randrange(30)) for _ in range(120)}, key=lambda x: (x[0], x[2], x[3]))

    def run(step, held=10**6):
        cut = [rows[i : i + step] for i in range(0, len(rows), step)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*p), (pa.int64(), pa.int32(), pa.int32(), pa.int64()))], list("spnk")) for p in cut]
        return sorted({x for b in jaccard._runs(batches, held) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())})

    whole = run(10**6)
    assert whole
    for step in (1, 2, 3, 7, 50):
        assert run(step) == whole
        # runs that are handed on early have another pivot, but the same members
        early, groups = {}, {}
        for rows_of, found in ((early, run(step, 2)), (groups, whole)):
            for pivot, member in found:
                rows_of.setdefault(member, set()).add(pivot)
        assert early.keys() == groups.keys()


def test_overlap_matrix():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 50, 30).astype(np.uint64)) for _ in range(9)]
    o = jaccard.overlaps(sets)
    for i in range(9):
        for j in range(9):
            assert o[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    got = {r.node: r.root for r in jaccard.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_heads_never_hide_a_link():
    r = np.random.default_rng(2)
    for _ in range(40):
        base = np.unique(r.integers(0, 1 << 62, 200).astype(np.uint64))
        sets = []
        for k in r.integers(0, 60, 6):
            s = base[r.permutation(len(base))[: len(base) - int(k) // 2]]
            sets.append(np.unique(np.append(s, r.integers(0, 1 << 62, int(k) // 2).astype(np.uint64))))
        frequent = np.sort(base[:17])
        may = jaccard.possible(np.array([len(s) for s in sets]), [jaccard.head(s, frequent) for s in sets])
        for i in range(6):
            for j in range(6):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                    assert may[i, j]
