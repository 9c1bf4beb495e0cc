import json

import pytest
from mediajobs.functions.jsonpath import as_string, path_eval
from mediajobs.operators import normalize as N
from mediajobs.sources import results as R
from pyspark.sql import functions as F

VALUES = ["", "x", [], {}, False, 0, None, [1, None, [2, 3]], {"c": "y"}, [{"c": 1}, {"c": None}, {"d": 2}, {"c": [4, 5]}]]


def brute(path, data):
    """Path evaluation on Python values."""

    def operand(text):
        value, rest = data, text
        items = None
        for raw in rest.replace("[]", ".[]").replace("[0]", ".[0]").split("."):
            step = (lambda v, k=raw: (v[0] if isinstance(v, list) and v else None) if k == "[0]" else v.get(k) if isinstance(v, dict) else None)
            if raw == "[]":
                src = value if items is None else items
                if items is None and not isinstance(src, list):
                    return None
                items = [y for x in src for y in (x if isinstance(x, list) else [x])]
                items = [x for x in items if x is not None]
            elif items is None:
                value = step(value)
            else:
                items = [v for v in map(step, items) if v is not None]
        return value if items is None else items

    for p in (parts := [p.strip() for p in path.split("||")]):
        v = operand(p)
        if v not in (None, "", [], {}) and v is not False:
            return v
    return operand(parts[-1])


@pytest.mark.parametrize("path", ["a || b", "a", "b || a", "a[].c", "a[0]", "a.c || b", "a[] || b[].c"])
def test_paths_equal_brute_force(spark, path):
    rows = [(i, json.dumps({"a": a, "b": b})) for i, (a, b) in enumerate((a, b) for a in VALUES for b in VALUES)]
    df = spark.createDataFrame(rows, "i int, j string").withColumn("v", F.parse_json("j"))
    for r in df.select("j", F.to_json(path_eval(path, F.col("v"))).alias("got")).collect():
        want = brute(path, json.loads(r.j))
        assert (json.loads(r.got) if r.got else None) == want, r.j


def raw(spark, *payloads):
    return N.parsed(spark.createDataFrame([(f"d{i}", json.dumps(p) if not isinstance(p, str) else p) for i, p in enumerate(payloads)], "document_id string, payload string"))


def test_blocks_types_pages_and_content(spark):
    blocks = [
        {"type": "header", "content": "h", "page": "3"}, 5, {"label": "Figure_Title", "text": "t", "page": 3}, {"type": "TABLE_caption", "page": -1},
        {"type": "chart", "content": [{"text": "a"}, "b", 2, {}], "page": 2.0, "bbox": [1, 2.5]}, {"type": "equation", "page": "x", "bbox": "no"},
        {"content": {"k": 1}, "page": None},
    ]
    got = N.normalize_blocks(raw(spark, {"blocks": blocks})).orderBy("pos").collect()
    assert [(r.pos, r.block_id, r.type, r.content, r.page, r.bbox) for r in got] == [
        (0, "d0-b0", "heading", "h", 3, None), (2, "d0-b2", "heading", "t", 3, None), (3, "d0-b3", "table", "", 1, None),
        (4, "d0-b4", "figure", "a\nb\n2\n", 1, [1.0, 2.5]), (5, "d0-b5", "text", "", 1, None), (6, "d0-b6", "text", '{"k":1}', 1, None),
    ]


def test_markdown_alternatives(spark):
    rows = raw(
        spark, {"markdown": "", "data": {"markdown": [" a ", "", None, "b"]}}, {"blocks": [{"content": "x"}, {"content": ""}, {"text": "y"}]},
        {"markdown": 7}, {"other": 1}, "not json",
    )
    assert [r.markdown for r in N.normalize_markdown(rows).orderBy("document_id").collect()] == ["a\n\nb", "x\n\ny", "7", "", ""]


def test_pages_figures_tables_and_document(spark):
    p = {"pages": [1, {"text": "t", "width": 2}, {"page_number": 9}], "figures": [{"image": "", "img": "z"}, {"id": "q", "image_url": "u", "page": "4"}], "tables": [{"content": "m"}]}
    rows = raw(spark, p, {})
    assert [(r.page_number, r.text, r.width) for r in N.normalize_pages(rows).orderBy("pos").collect()] == [(2, "t", 2.0), (9, None, None)]
    assert [(r.figure_id, r.image, r.page) for r in N.normalize_figures(rows).orderBy("pos").collect()] == [("d0-fig0", "z", 1), ("q", "u", 4)]
    assert [(r.table_id, r.markdown) for r in N.normalize_tables(rows).collect()] == [("d0-tbl0", "m")]
    docs = N.assemble_document(rows).orderBy("document_id").collect()
    assert [(len(d.pages), len(d.figures), len(d.tables), d.blocks) for d in docs] == [(2, 2, 1, []), (0, 0, 0, [])]


def test_readers(spark, tmp_path):
    import io
    import zipfile

    items = [{"type": "title", "text": "T", "page_idx": 2}, {"type": "image", "img_path": "i/1.png", "image_caption": [" Fig ", "", "one"], "page_idx": 2}, {"type": "table", "caption": "C ", "text": "body"}]
    good = io.BytesIO()
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("a.md", "other")
        z.writestr("full.md", "main")
        z.writestr("x_content_list.json", json.dumps(items))
        z.writestr("i/1.png", b"png")
    (tmp_path / "a.zip").write_bytes(good.getvalue())
    a = R.read_zip_results(spark, str(tmp_path / "*.zip"))
    assert [r.markdown for r in a.collect()] == ["main"]
    listed = N.content_list(a)
    files = R.read_zip_files(spark, str(tmp_path / "*.zip"))
    assert [(r.figure_number, r.caption, r.page, r.image_base64) for r in N.content_list_figures(listed, files).collect()] == [("1", "Fig one", 2, "cG5n")]
    assert [(r.page_number, r.text) for r in N.content_list_pages(listed).orderBy("ordinal").collect()] == [(2, "T\n"), (1, "")]
    assert [(r.caption, r.markdown, r.page) for r in N.content_list_tables(listed).collect()] == [("C", "body", 1)]
    bad = spark.createDataFrame([("b", "{nope")], "document_id string, content_list string")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        N.content_list(bad).collect()
    lines = F.lit('{"a":1}\n\n  [2] \n')
    one = spark.range(1)
    assert one.select(R.jsonl_payload(lines)).first()[0] == '{"jsonl":[{"a":1},[2]]}'
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        one.select(R.jsonl_payload(F.lit("{bad"))).collect()
    got = one.select(*[R.json_payload(F.lit(x)) for x in ('{"k":1}', "[1]", "hi")]).first()
    assert list(got) == ['{"k":1}', '{"result":[1]}', '{"text":"hi"}']
    got = one.select(*[R.text_payload(F.lit(" a \n\n b"), F.lit(f)) for f in ("lines", "text", "json")]).first()
    assert json.loads(got[0]) == {"text": "a \n\n b", "blocks": [{"type": "text", "content": "a"}, {"type": "text", "content": "b"}]}
    assert json.loads(got[1]) == {"text": "a \n\n b", "markdown": "a \n\n b"} and json.loads(got[2]) == {"text": "a \n\n b"}


def test_sanitize_and_sources(spark):
    text = '{"a":{"TOKEN":1,"l":[{"secret":2,"c":[3]}]},"tokens":4}'
    assert spark.range(1).select(N.sanitize_payload(F.lit(text))).first()[0] == '{"a":{"l":[{"c":[3]}]},"tokens":4}'
    rows = [("p", "/x/y.pdf", None, None), ("q", "/gone", "data:image/jpeg;base64,QQ==", None), ("r", None, "QQ==", "http://h/a.pdf?x=/b"), ("s", None, None, "http://h/d/?q"), ("t", None, "", None)]
    req = spark.createDataFrame([(*r, None) for r in rows], "request_id string, file_path string, file_content_base64 string, file_url string, mime_type string")
    files = spark.createDataFrame([("/x/y.pdf",)], "path string")
    got = {r.request_id: (r.source, r.file_name, r.resolved_mime) for r in N.resolve_input_source(req, files).collect()}
    assert got == {
        "p": ("path", "y.pdf", "application/pdf"), "q": ("base64", "image.png", "image/jpeg"), "r": ("base64", "document.pdf", "application/pdf"),
        "s": ("url", "document.pdf", "application/pdf"), "t": ("none", "document.pdf", "application/pdf"),
    }
