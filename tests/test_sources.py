import io
import zipfile

import pytest
from mediajobs.sources import archives, results


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in entries:
            z.writestr(name, content)
    return out.getvalue()


def name(path):
    return path.rpartition("/")[2]


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.zip").write_bytes(zipped([("x/b.md", "second"), ("full.md", "Ä main"), ("1_content_list.json", "[1]"), ("2_content_list.json", "[2]"), ("i/", ""), ("i/1.png", b"\x00\xff")]))
    (tmp_path / "deep" / "b.zip").write_bytes(zipped([("n.md", "note"), ("m.md", "later")]))
    (tmp_path / "none.zip").write_bytes(zipped([]))
    (tmp_path / "other.txt").write_text("not an archive")
    return tmp_path


def test_archives(spark, folder):
    for path in (str(folder), f"file://{folder}", f"file:{folder}"):
        docs = {name(r.document_id): (r.markdown, r.content_list) for r in results.read_zip_results(spark, path).collect()}
        assert docs == {"a.zip": ("Ä main", "[1]"), "b.zip": ("note", None), "none.zip": ("", None)}
    files = sorted((name(r.document_id), r.path, bytes(r.content)) for r in results.read_zip_files(spark, str(folder)).collect())
    assert files == [("a.zip", "2_content_list.json", b"[2]"), ("a.zip", "i/1.png", b"\x00\xff")]
    assert archives.read_entries(spark, f"{folder}/*.zip").select("document_id").distinct().count() == 2


def test_contents_that_are_not_asked_for_are_not_read(spark, folder):
    rows = {r.entry: (r.size, r.content) for r in archives.read_entries(spark, f"{folder}/a.zip", ".md").collect()}
    assert rows["i/1.png"] == (2, None) and bytes(rows["full.md"][1]).decode() == "Ä main" and rows["i/"] == (0, None)


def test_large_archives_are_cut_and_small_ones_share_a_task(tmp_path):
    large = [(f"{i}.bin", bytes((i * j) % 251 for j in range(3000))) for i in range(40)]
    (tmp_path / "large.zip").write_bytes(zipped(large))
    for i in range(30):
        (tmp_path / f"s{i:02}.zip").write_bytes(zipped([("a.md", f"text {i}")]))
    parts = archives.parts(archives.found(str(tmp_path), ".zip"), 1500)
    ranges = [p.archives for p in parts]
    cut = [r[0] for r in ranges if name(r[0][0]) == "large.zip"]
    assert len(cut) > 3 and cut[0][1] == 0 and cut[-1][2] is None and all(a[2] == b[1] for a, b in zip(cut, cut[1:]))
    assert 1 < len(ranges) - len(cut) < 10
    read = [r for p in parts for r in archives.entries_of(p, None)]
    assert sorted((r[1], r[4]) for r in read if name(r[0]) == "large.zip") == sorted(large) and len(read) == 70


def test_entries_are_held_one_at_a_time(tmp_path):
    # 200 MB of entries in a small archive
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(50):
            z.writestr(f"{i}.bin", bytes(4 << 20))
    import tracemalloc

    tracemalloc.start()
    n = 0
    for part in archives.parts(archives.found(f"{tmp_path}/big.zip"), 1 << 14):
        for batch in archives._batches(archives.entries_of(part, None), archives._ENTRY):
            n += sum(len(v) for v in batch.column(4).to_pylist())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 50 * (4 << 20) and most < 40 << 20


def test_what_is_no_archive_is_an_error(spark, tmp_path):
    (tmp_path / "bad.zip").write_bytes(b"not a zip")
    with pytest.raises(Exception, match="zip"):
        results.read_zip_results(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="gone"):
        results.read_zip_results(spark, str(tmp_path / "gone")).collect()
    (tmp_path / "none").mkdir()
    assert results.read_zip_results(spark, str(tmp_path / "none")).count() == 0


def test_files_of_all_forms(spark, tmp_path):
    def at(form, **files):
        (tmp_path / form).mkdir()
        for k, v in files.items():
            (tmp_path / form / k).write_bytes(v)
        return str(tmp_path / form)

    def payloads(df):
        return {name(r.document_id): r.payload for r in df.collect()}

    path = at("json", a=b'{"k": "\xc3\xa4"}', b=b"[1, 2]", c=b"plain \xff text", d=b"")
    assert payloads(results.read_json_results(spark, path)) == {"a": '{"k": "ä"}', "b": '{"result":[1,2]}', "c": '{"text":"plain � text"}', "d": '{"text":""}'}
    path = at("lines", a=b'{"a":1}\r\n\n [2]', d=b"")
    assert payloads(results.read_jsonl_results(spark, path)) == {"a": '{"jsonl":[{"a":1},[2]]}', "d": '{"jsonl":[]}'}
    path = at("text", a=b" x \n\ny ", d=b"")
    assert payloads(results.read_text_results(spark, path, "text"))["a"] == '{"text":"x \\n\\ny","markdown":"x \\n\\ny"}'
    assert payloads(results.read_text_results(spark, path, "lines"))["a"] == '{"text":"x \\n\\ny","blocks":[{"type":"text","content":"x"},{"type":"text","content":"y"}]}'
    assert payloads(results.read_text_results(spark, path, "json")) == {"a": '{"text":"x \\n\\ny"}', "d": '{"text":""}'}
