"""What Python steps hold at a time doesn't grow with the batches they are given."""

import io
import zipfile

import pyarrow as pa
from mediajobs.functions.batches import PIECE_ROWS, batched, pieces
from mediajobs.sources import results


def test_pieces_and_batches_are_small():
    wide = pa.RecordBatch.from_pydict({"x": ["a" * 100_000] * 300})
    cut = list(pieces(wide))
    assert sum(p.num_rows for p in cut) == 300 and max(p.num_rows for p in cut) <= 42
    assert [len(p) for p in pieces(pa.array(range(600)))] == [PIECE_ROWS, PIECE_ROWS, 600 - 2 * PIECE_ROWS] and not list(pieces(pa.array([], pa.int64())))
    out = list(batched(((b"x" * (1 << 20),) for _ in range(10)), pa.schema([("c", pa.binary())]), lambda r: len(r[0])))
    assert [b.num_rows for b in out] == [5, 5]


def _zipped(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("full.md", text)
        z.writestr("x_content_list.json", "[1]")
        z.writestr("1.png", b"\xff")
    return out.getvalue()


def test_archives_are_unpacked_into_shared_batches(spark):
    df = spark.createDataFrame([(str(i), _zipped(f"t{i}")) for i in range(300)], "document_id string, content binary").coalesce(1)
    unpacked = results.unpack_archives(df)
    got = sorted((r.document_id, r.markdown, r.content_list, dict(r.files)) for r in unpacked.collect())
    assert got == sorted((str(i), f"t{i}", "[1]", {"1.png": b"\xff"}) for i in range(300))
    # a data frame for each archive before
    assert "MapInArrow" in unpacked._jdf.queryExecution().toString()


def test_rows_of_holds_one_row():
    from mediajobs.functions.batches import rows_of

    b = pa.RecordBatch.from_pydict({"n": [1, None], "c": [b"x", b""]})
    assert list(rows_of([b, b.slice(0, 0), b.slice(1)])) == [(1, b"x"), (None, b""), (None, b"")]


def test_archives_are_made_without_a_data_frame_each(spark):
    from mediajobs.plans import inputs

    made = inputs.archives(spark, "/root/testdata/sf0.001")
    assert made.count() == 200 and "MapInArrow" in made._jdf.queryExecution().toString()


def test_tensors_leave_in_small_pieces(spark, monkeypatch):
    import numpy as np
    from mediajobs.operators import images
    from pyspark.sql import functions as F

    made = {}
    monkeypatch.setattr(images.F, "arrow_udf", lambda run, kind: made.setdefault("run", run) and (lambda c: c))
    images.image_to_tensor(F.struct(*[F.lit(0).alias(c) for c in ("height", "width", "nChannels", "data")]))
    pixels = [bytes([i % 256] * 4) for i in range(20)]
    batch = pa.StructArray.from_arrays([pa.array([2] * 20), pa.array([2] * 20), pa.array([1] * 20), pa.array(pixels)], ["height", "width", "nChannels", "data"])
    out = list(made["run"](iter([batch])))
    # one array of 20 tensors of 600 KB before
    assert max(len(o) for o in out) <= 6 and sum(map(len, out)) == 20
    first = images.tensor(np.full((2, 2, 3), 1, np.uint8)).ravel()
    assert np.array_equal(pa.chunked_array(out)[1].values.to_numpy(), first)


def test_texts_of_candidates_are_made_in_arrow():
    from mediajobs.operators import rerank

    given = ['{"title":" T ","steps":["a",{"text":"b"}]}', None, " plain ", "[1]"] * 100
    out = rerank._texts(pa.array(given))  # a pandas series before
    assert out.type == pa.string() and out.to_pylist() == ["T a b", "", "plain", "1"] * 100


def test_encoded_tables_keep_their_columns_and_order(spark):
    from mediajobs.operators import models

    df = spark.createDataFrame([(i, None if i % 50 == 0 else f"w{i} w", [0.5]) for i in range(600)], "id int, input string, vector array<float>").coalesce(1)
    out = models.embed_table(df)
    assert out.columns == ["id", "input", "vector"] and "MapInArrow" in out._jdf.queryExecution().toString()  # data frames before
    rows = out.collect()
    assert [r.id for r in rows] == list(range(600)) and rows[0].vector == [0.0] * 16 and all(len(r.vector) == 16 for r in rows)
    assert rows[7].vector == models.hash_encoder(["w7 w"])[0].tolist()


def test_tokens_are_cut_where_they_are_made(spark):
    from mediajobs.operators import models
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(" ".join(map(str, range(20))),), (None,), ("",)], "text string")
    out = df.select(models.tokenize(F.col("text")).alias("ids"), models.tokenize(F.col("text"), max_length=3).alias("cut"))
    got = out.collect()
    assert [(len(r.ids), len(r.cut)) for r in got] == [(20, 8), (0, 0), (0, 0)] and got[0].cut == got[0].ids[:8]
    assert "slice(" not in out._jdf.queryExecution().optimizedPlan().toString()  # all ids left Python before


def test_queries_are_encoded_once(spark):
    from mediajobs.operators import models, search

    seen = spark.sparkContext.accumulator(0)

    def encoder(texts):
        seen.add(len(texts))
        return models.hash_encoder(texts)

    media = spark.createDataFrame([(i, [float(i)] * 16) for i in range(5)], "media_id long, multimodal_vector array<float>")
    asked = spark.createDataFrame([(i, f"w{i}") for i in range(10)], "query_id long, query_text string")
    assert search.search_by_text(asked, media, 2, encoder).count() == 20
    assert seen.value == 10  # twice before: once to count them


def test_tasks_grow_with_rows(spark):
    from mediajobs.functions.sizes import spread, tasks_of

    rows = spark.range(250_001)
    assert (tasks_of(rows), tasks_of(rows, 25_000), tasks_of(rows.limit(0))) == (3, 11, 1)
    assert "REPARTITION_BY_NUM" in spread(rows, 3, "id")._jdf.queryExecution().executedPlan().toString()  # merged by bytes before


def test_only_documents_that_may_be_json_go_to_python(spark, monkeypatch):
    import sys

    from mediajobs.operators import rerank
    from pyspark.sql import functions as F

    assert set(rerank.SPACE) == {c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()}
    plain = [None, "", " \n", rerank.SPACE + "no 1 b" + rerank.SPACE, "\ufeff{}", "true story", "12 men", "None", "\x0b{}", "t" * 50, "\U0001f600 é"]
    told = ['{"title":" é\U0001f600 ","year":1.50}', " \r\n[1, null]\t", '"s "', "{bad ", "[Note] x", "null", "\ttrue\n", "-Infinity", "NaN", " -1.5e3 ", "007", '{"z":"a"} {}']
    df = spark.createDataFrame(list(enumerate(plain + told)), "pos int, document string").repartition(3)
    for most in (None, 3):
        got = df.select("pos", rerank.extract_document_text(F.col("document"), most).alias("t")).orderBy("pos").collect()
        assert [r.t for r in got] == [rerank._text(d)[:most] for d in plain + told]
    given = []
    monkeypatch.setattr(rerank.F, "arrow_udf", lambda run, kind: lambda c: given.append(c) or c)
    rerank.extract_document_text(F.col("document"))
    sent = [r.d for r in df.select(given[0].alias("d")).where("d is not null").collect()]
    assert sorted(sent) == sorted(told)  # all documents before


def test_tasks_that_extract_texts_hold_so_many_bytes(spark, monkeypatch):
    from mediajobs.functions.sizes import tasks_of_bytes
    from mediajobs.operators import rerank
    from mediajobs.plans import media
    from pyspark.sql import functions as F

    rows = spark.range(1000).select(F.col("id").alias("query_id"), F.lit(0).alias("pos"), F.repeat(F.lit("é"), 50).alias("document"))
    assert (tasks_of_bytes(rows, "document"), tasks_of_bytes(rows, "document", 10_000), tasks_of_bytes(rows.limit(0), "document")) == (1, 10, 1)
    assert tasks_of_bytes(spark.range(250_001).selectExpr("cast(null as string) as document"), "document") == 3
    monkeypatch.setattr(rerank, "tasks_of_bytes", lambda rows, column: 37)
    meta = media.rerank_meta(spark, "/root/testdata/sf0.001")
    assert meta._jdf.queryExecution().executedPlan().toString().count("37), REPARTITION_BY_NUM") == 1  # merged by bytes before
    assert rerank.text_candidates(rows).agg(F.count("*"), F.sum(F.length("text"))).first()[:] == (1000, 50_000)
