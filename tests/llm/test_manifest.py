import hashlib
import random
import zlib

import pytest
from mediajobs.llm import manifest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, g string"


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(i, source, lang, n, text):
    return digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, text)))


def climb(hashes):
    """The top of a list of nodes, and for each its list of (siblings to the left, to the right)."""
    ways = [[] for _ in hashes]
    at = list(range(len(hashes)))
    while len(hashes) > 1:
        for w, i in zip(ways, at):
            w.append((hashes[i - 1], "") if i % 2 else ("", hashes[i + 1] if i + 1 < len(hashes) else ""))
        hashes = [digest("".join(hashes[i : i + 2])) for i in range(0, len(hashes), 2)]
        at = [i // 2 for i in at]
    return hashes[0], ways


def brute(rows):
    langs = {}
    for i, text, lang, source, n, *_ in rows:
        own = leaf(i, source, lang, n, text)
        touched = i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0
        langs.setdefault(lang, []).append((i is not None, i or 0, own, i, leaf(i, source, lang, n + 1, text) if touched else own))
    order = sorted(langs, key=lambda g: (g is not None, (g or "").encode()))
    tops = {g: climb([x[2] for x in sorted(langs[g])]) for g in order}
    root, ways = climb([tops[g][0] for g in order]) if order else (None, [])
    out = []
    for g, rest in zip(order, ways):
        for (*_, own, i, tampered), way in zip(sorted(langs[g]), tops[g][1]):
            folded = tampered
            for left, right in way + rest:
                folded = digest(left + folded + right)
            out.append((i, own, tops[g][0], root, digest("".join(a + b for a, b in way + rest)), folded, folded == root))
    return sorted(out, key=str)


def check(spark, rows, *spans):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for span in spans:
        assert sorted(map(tuple, manifest.verified(df, span).collect()), key=str) == brute(rows)


def made(r, ids, langs):
    return [(i, r.choice([None, "", "text " * r.randrange(9), "ünï 日本"]), r.choice(langs), r.choice([None, "", "a", "b"]), r.choice([None, 0, 7, 99]), 1, "x") for i in ids]


def test_equals_brute_force(spark):
    r = random.Random(1)
    check(spark, made(r, range(83), ["en", "de", None, "", "é", "z"]), 10, 1, 3)


def test_nodes_in_copies(spark, monkeypatch):
    monkeypatch.setattr(manifest, "REACH", 8)
    r = random.Random(2)
    rows = made(r, range(70), ["en"]) + made(r, range(100, 105), ["a", "b", "c", None])
    check(spark, rows, 1, 2)
    leaf_rows, node_rows = manifest.manifest(spark.createDataFrame(rows, SCHEMA), 2)
    met = leaf_rows.groupBy(F.col("parent").alias("node")).count().join(node_rows, "node").agg(F.max("count")).first()[0]
    assert met <= 8 and node_rows.count() == node_rows.select("node").distinct().count()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_few_rows(spark, n):
    r = random.Random(n)
    check(spark, made(r, range(n), ["en"]), 10)
    check(spark, [(i, "t", f"l{i}", "s", 1, 1, "x") for i in range(n)], 1)


def test_nulls_repeats_and_long_texts(spark):
    same = (7, "same", "en", "a", 4, 1, "x")
    rows = [same] * 9 + [(None, None, None, None, None, None, None)] * 3 + [(None, "", "en", "", 0, 1, "x"), (7, "other", "en", "a", 5, 2, "y")]
    check(spark, rows + [(50, "long é " * 300000, "en", "s", 3, 1, "x")], 10)


def test_empty_table_and_settings(spark):
    spark.conf.set("spark.sql.cteRecursionRowLimit", "12345")
    try:
        assert manifest.verified(spark.createDataFrame([], SCHEMA)).count() == 0
        assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "12345"
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
