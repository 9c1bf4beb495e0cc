import random
import tempfile
from collections import Counter

import corpus_pipeline
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, label int, _key_ string"


def folder(spark, rows, labels):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def text(r, n=40):
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))


def test_nulls_repeats_and_clashing_columns(spark):
    r = random.Random(1)
    row = lambda i, t, source="a": (i, t, None, source, None, 7, "k", None, "x")
    copy, long = text(r), text(r, 6000)
    rows = [row(1, None), row(2, ""), row(3, "too short"), row(4, "dup dup dup dup dup " * 9)]  # rejected
    rows += [row(10, copy), row(11, copy), row(None, copy), row(12, copy + " more"), row(10, copy)]  # one stays
    rows += [row(20, text(r)), row(20, text(r)), row(None, text(r)), row(None, text(r)), row(30, text(r), None), row(31, long, "b")]  # all stay
    path = folder(spark, rows, [(10, 1, 0), (None, 0, 1), (20, 1, 0)])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.written(stage(spark, out[-1], path), "test"))
    assert all(d.columns == docs.columns for d in out[:-1])
    ids = lambda d: Counter(x.doc_id for x in d.collect())
    assert ids(out[1]) == ids(out[2]) == Counter(x[0] for x in rows if x[0] not in (1, 2, 3, 4))
    assert ids(out[3]) == Counter([10, 20, 20, None, None, 30, 31])
    assert {x.text for x in out[3].collect()} == {copy, long, *(x[1] for x in rows[9:13]), rows[13][1]}
    assert all(x["size"] == 7 and x.key == "k" and x["_key_"] == "x" for x in out[4].collect())
    sequences = Counter()
    for p in out[5].collect():
        sequences[p.sequence_id] += p.length
    assert max(sequences.values()) <= 2048
    whole = Counter(x.doc_id for x in out[5].where("piece = 0").collect())
    assert whole == ids(out[4])


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None, None, None, None, None)]])
def test_nothing_left(spark, rows):
    path = folder(spark, rows, [])
    got = corpus_pipeline.run(spark, path)
    assert got.count() == 0
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
