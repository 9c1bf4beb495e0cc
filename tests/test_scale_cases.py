"""Cases that small tables lack: ids of other types, vectors that can't be used, repeated ids, large groups."""

import random

import numpy as np
import pytest
from mediajobs.functions.numbering import numbered
from mediajobs.operators import images, ingest, normalize, search
from pyspark.sql import functions as F


def nearest(items, queries, k):
    out = []
    for q, v in queries:
        d = sorted((sum((a - b) ** 2 for a, b in zip(v, x)), i) for i, x in items)
        out += [(q, r + 1, i) for r, (_, i) in enumerate(d[:k])]
    return sorted(out)


def test_knn_takes_string_ids(spark):
    r = random.Random(2)
    items = [(f"m{r.randrange(10**9):x}", [round(r.gauss(0, 1), 1) for _ in range(3)]) for _ in range(200)]
    queries = [(f"q{i}", [r.gauss(0, 1) for _ in range(3)]) for i in range(9)]
    bad = [("zz", None), ("za", []), ("zb", [1.0, None, 0.0]), ("zc", [float("nan")] * 3), ("zd", [float("inf"), 0.0, 0.0])]
    media = spark.createDataFrame(items + bad, "media_id string, v array<double>")
    asked = spark.createDataFrame(queries + bad, "query_id string, query_vector array<double>")
    want = nearest(items, queries, 4)
    assert sorted((x.query_id, x["rank"], x.media_id) for x in search.knn(asked, media, "v", 4).collect()) == want
    assert sorted((x.query_id, x["rank"], x.media_id) for x in search.knn_builtin(asked, media, "v", 4).collect()) == want


def test_knn_sizes_must_agree(spark):
    media = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], "media_id long, v array<double>")
    asked = spark.createDataFrame([(5, [1.0])], "query_id long, query_vector array<double>")
    for run in (search.knn, search.knn_builtin):
        with pytest.raises(Exception, match="values for queries|different sizes"):
            run(asked, media, "v").collect()
    with pytest.raises(Exception, match="has 1 values, expected 2"):
        search.knn(asked, media, "v", size=2).collect()
    with pytest.raises(Exception, match="has 2 values, expected 3"):
        search.knn(asked.withColumn("query_vector", F.array(*[F.lit(1.0)] * 3)), media, "v", size=3).collect()


def test_filters_through_text_search(spark):
    from mediajobs.operators.models import _number, embed_table

    words = list({_number(w) % 16: w for w in "red green blue grey black white pink brown".split()}.values())[:4]

    media = embed_table(spark.createDataFrame([(f"m{i}", words[i % 4], i) for i in range(20)], "media_id string, input string, n int"))
    media = media.select("media_id", "n", F.col("vector").alias("multimodal_vector"), F.col("vector").alias("dino_vector"))
    asked = spark.createDataFrame([("q", words[0])], "query_id string, query_text string")
    pre = search.search_by_text(asked, media, 3, filter_expr="n > 7").orderBy("rank").collect()
    assert [x.media_id for x in pre] == ["m12", "m16", "m8"] and "multimodal_vector" not in pre[0]
    post = search.search_by_text(asked, media, 3, filter_expr="n > 7", prefilter=False).collect()
    assert [x.media_id for x in post] == ["m12", "m16"]  # m0 was ranked and is filtered


def test_documents_with_one_id_stay_apart(spark):
    payload = '{{"markdown":"{0}","pages":[{{"text":"{0}"}}, 3, {{"text":"x"}}],"blocks":[{{"type":"Title","content":"{0}","bbox":[1,2]}}]}}'
    raw = spark.createDataFrame([("a", payload.format("one")), ("a", payload.format("two")), ("b", "not json"), ("c", None)], "document_id string, payload string")
    got = normalize.assemble_document(normalize.parsed(raw)).collect()
    assert len(got) == 4
    by = {r.markdown: r for r in got if r.document_id == "a"}
    assert sorted(by) == ["one", "two"]
    for name, r in by.items():
        assert [(p.pos, p.page_number, p.text) for p in r.pages] == [(0, 1, name), (2, 3, "x")]
        assert [(b.block_id, b.type, b.content, b.page, b.bbox) for b in r.blocks] == [("a-b0", "heading", name, 1, [1.0, 2.0])]
        assert r.figures == r.tables == [] and r.metadata["raw_length"] == str(len(payload.format(name)))
    assert all(r.pages == [] and r.markdown == "" for r in got if r.document_id != "a")


def test_repeated_vectors_add_no_figures(spark):
    figures = spark.createDataFrame([("h", 1), ("g", 2)], "hash string, pos int")
    vectors = spark.createDataFrame([("h", "m", [2.0]), ("h", "m", [1.0]), ("h", "d", [])], "hash string, model string, vector array<float>")
    got = ingest.attach_embeddings(figures, vectors, "m", "d").orderBy("pos").collect()
    assert [(r.hash, r.multimodal_vector, r.dino_vector) for r in got] == [("h", [1.0], None), ("g", None, None)]


@pytest.mark.parametrize("slice_rows", [7, 10_000])
def test_numbered_equals_sorting(spark, slice_rows):
    r = random.Random(3)
    rows = [(r.choice(["a", "a", "a", "b", None]), i * i, r.randrange(9)) for i in range(300)]
    r.shuffle(rows)
    df = spark.createDataFrame([*rows, ("c", None, 1)], "k string, o long, place_ int")
    got = {(x.k, x.o): x.place for x in numbered(df, ["k"], "o", slice_rows=slice_rows).collect()}
    groups = {}
    for k, o, _ in rows:
        groups.setdefault(k, []).append(o)
    assert got == {("c", None): 1} | {(k, o): i + 1 for k, os in groups.items() for i, o in enumerate(sorted(os))}


def bicubic(pixels, side):
    """Each output pixel from its definition: cubic weights (a = -0.5) of the input pixels, wider when shrinking."""
    h, w, c = pixels.shape

    def weights(size):
        scale, out = max(size / side, 1.0), []
        for o in range(side):
            ws = []
            for i in range(size):
                x = abs(i + 0.5 - (o + 0.5) * size / side) / scale
                ws.append(1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0)
            out.append([v / sum(ws) for v in ws])
        return out

    rows, columns = weights(h), weights(w)
    out = np.zeros((side, side, c))
    for y in range(side):
        for x in range(side):
            for k in range(c):
                out[y, x, k] = sum(rows[y][i] * columns[x][j] * float(pixels[i, j, k]) for i in range(h) for j in range(w))
    return np.clip(np.round(out), 0, 255)


@pytest.mark.parametrize(("h", "w", "side"), [(5, 7, 9), (12, 9, 4), (6, 6, 6)])
def test_resampling_equals_brute_force(h, w, side):
    pixels = np.random.default_rng(h).integers(0, 256, (h, w, 3)).astype(np.uint8)
    got = images.tensor(pixels, side)
    want = ((bicubic(pixels, side) / 255 - images.MEAN) / images.STD).transpose(2, 0, 1)
    # a value halfway between two integers may round either way
    assert np.abs(got - want).max() < 1.01 / 255 / min(images.STD)
    assert (np.abs(got - want) < 1e-5).mean() > 0.98
