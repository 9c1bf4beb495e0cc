import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from mediajobs.llm import importance
from mediajobs.llm.textbuf import ALNUM, slices
import pyarrow as pa

SCHEMA = "doc_id long, text string, row int, rank string"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def features(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return len(ws), ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])]


def brute(docs, target, percent):
    """Rows (doc_id, n_features, weight, score, rank); equal rows take neighbouring ranks."""
    s, t = [0] * 10000, [0] * 10000
    for texts, sums in ((docs, s), (target, t)):
        for text in texts if texts is target else [d[1] for d in texts]:
            for f in features(text)[1]:
                sums[zlib.crc32(f.encode()) % 10000] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    out = []
    for i, text, *_ in docs:
        n, fs = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10000] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = rank + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def check(spark, docs, target, percent=25, pivots=3):
    got = importance.resample(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame([(t,) for t in target], "text string"), percent, pivots=pivots)
    assert [c.dataType.simpleString() for c in got.schema] == ["bigint"] * 5
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, target, percent)


def prose(r, n):
    return " ".join(r.choice(["Ein", "the", "Ünder", "ÀB", "x1", "z", "日本", "don't", "A-b", "É"]) + str(r.randrange(30)) for _ in range(n))


def test_equals_brute_force(spark):
    r = random.Random(1)
    docs = [(i, prose(r, r.randrange(60)), 1, "a") for i in range(120)]
    docs += [(500, None, None, None), (501, "", 2, ""), (502, " .,;\n", 3, "b"), (None, prose(r, 30), 4, "c"), (None, None, 5, "d")]
    docs += [(600, "x" * 5000 + " " + prose(r, 3000) + " " + "y" * 65 + " " + "z" * 64, 6, "e")]
    for percent in (25, 100, 1):
        check(spark, docs, [prose(r, 40), None, "", "the the the THE"], percent)


def test_repeated_rows_and_ties(spark):
    r = random.Random(2)
    text = prose(r, 25)
    docs = [(7, text, 1, "a")] * 50 + [(i % 5, prose(r, 20 + i % 3), 1, "a") for i in range(40)] + [(None, text, 1, "a")] * 9
    check(spark, docs, [text], 60)
    check(spark, docs, [], 33, 15)


def test_few_or_no_documents(spark):
    check(spark, [], ["a b"])
    check(spark, [(1, "only a few words", 1, "a")], ["a b"], 100)
    check(spark, [(1, "w " * 19, 1, "a"), (2, "w " * 20, 1, "a")], ["w"], 100)


def test_hashes_of_words_and_pairs():
    texts = ["Aé b" * 3, "", "q" * 200 + " r", "日本 x " * 40, "a" * 64 + " " + "b" * 65, "z"]
    for words in slices(pa.array(texts), ALNUM):
        ((at, one), (pair_at, two)) = importance.features(words)
        every = [w for t in texts for w in features(t)[1][: features(t)[0]]]
        assert one.tolist() == [zlib.crc32(w.encode()) for w in every] and at.tolist() == list(range(len(every)))
        assert two.tolist() == [zlib.crc32(f.encode()) for t in texts for f in features(t)[1][features(t)[0] :]]


@pytest.mark.parametrize("k", [1, 2, 399, 700, 1000])
def test_quickselect(spark, k):
    rng = np.random.default_rng(k)
    rows = [(int(a), 0, int(b), 0, i) for i, (a, b) in enumerate(rng.integers(0, 4, (1000, 2)))]
    keys = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in importance.ORDER))
    assert importance.quickselect(keys, k, 4, seed=k) == sorted(rows)[k - 1]
