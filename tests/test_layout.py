"""Numbering in slices, the media table's layout, the filter of known hashes, and routing by signature."""

import hashlib
import random

import pytest
from mediajobs.functions.numbering import numbered, sliced
from mediajobs.functions.shared import new_path
from mediajobs.operators import known, routing
from mediajobs.sources import tables
from pyspark.sql import functions as F


def digest(i):
    return hashlib.sha256(str(i).encode()).hexdigest()


@pytest.mark.parametrize("orders", ["far", "equal", "null", "mixed"])
def test_slices_are_bounded(spark, orders):
    n = 6000
    value = {"far": lambda i: 10**15 if i == 0 else i, "equal": lambda i: 5, "null": lambda i: None, "mixed": lambda i: (None, 7, i)[i % 3]}[orders]
    rows = spark.createDataFrame([("a" if i % 50 else "b", value(i), i) for i in range(n)], "k string, o long, i long").repartition(4)
    sizes = [r["count"] for r in sliced(rows, ["k"], "o", 500).groupBy(F.shiftright("_at", 33)).count().collect()]
    assert max(sizes) < 3 * 500
    got = sorted(numbered(rows, ["k"], "o", slice_rows=500).collect(), key=lambda r: (r.k, r.place))
    for k in "ab":
        own = [r for r in got if r.k == k]
        assert [r.place for r in own] == list(range(1, len(own) + 1)) and len({r.i for r in own}) == len(own)
        orders_of = [(r.o is not None, r.o or 0) for r in own]
        assert orders_of == sorted(orders_of)


def scanned(df):
    """Rows that the plan's scans gave."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), [0]

    def walk(node):
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if node.nodeName().startswith("Scan"):
            out[0] += node.metrics().apply("numOutputRows").value()
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    return out[0]


def test_lookups_prune(spark, tmp_path):
    rows = [(f"id{i:05}", digest(i), float(i)) for i in range(4000)]
    records = spark.createDataFrame(rows, "media_id string, hash string, created_at double")
    root = str(tmp_path / "media")
    tables.write_media(records.where("created_at < 3000"), root, (2, 3))
    tables.write_media(records.where("created_at >= 3000"), root, (2, 3))
    media = tables.read_media(spark, root, (2, 3))
    assert media.count() == 4000 and spark.read.parquet(tables.media_path(root, 2, 3)).count() == 4000
    one = tables.media_get_by_hash(media, digest(77))
    assert [r.media_id for r in one.collect()] == ["id00077"]
    # without the help of statistics and Bloom filters: two files of one bucket, of 128 files
    bucket = [r["count"] for r in media.groupBy(F.regexp_extract(F.input_file_name(), r"_(\d+)\.c", 1)).count().collect()]
    assert len(bucket) == 64
    spark.conf.set("spark.sql.parquet.filterPushdown", "false")
    try:
        assert scanned(media) == 4000 and scanned(media.where(F.col("hash") == digest(77))) <= max(bucket) < 120
    finally:
        spark.conf.unset("spark.sql.parquet.filterPushdown")
    # a Bloom filter tells which row groups lack an id
    by_id = tables.media_get_by_id(media, "id03500")
    assert [r.hash for r in by_id.collect()] == [digest(3500)]
    assert scanned(media.where(F.col("media_id") == "id03500")) < 400
    assert tables.media_get_by_id(media, "none").count() == 0
    # another session finds the layout again
    spark.sql(f"DROP TABLE {tables._table(spark, tables.media_path(root, 2, 3))}")
    again = tables.read_media(spark, root, (2, 3))
    assert again.count() == 4000 and again.where(F.col("hash") == digest(5)).count() == 1
    # a join by hash shuffles neither side
    both = again.select("hash").join(media.select("hash", "media_id"), "hash")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString() and both.count() == 4000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_media(spark, str(tmp_path / "gone"), (2, 3))


def test_filter_of_known_hashes(spark):
    stored = spark.createDataFrame([(digest(i),) for i in range(0, 3000)] + [(None,)], "hash string")
    path = new_path(spark, "filter")
    known.write_filter(stored.limit(1500), path)
    known.add_to_filter(stored, path)
    figures = spark.createDataFrame([(i, digest(i)) for i in range(2900, 6000)] + [(-1, None), (-2, digest(0)), (-3, digest(0))], "n long, hash string")
    f = known.HashFilter(spark, path)
    joined = figures.where(f.maybe()).count()
    assert 102 <= joined < 102 + 150  # of 3,103; the rest isn't shuffled
    got = sorted(r.n for r in known.new_figures(figures, stored, f).collect())
    assert got == [-1, *range(3000, 6000)]
    empty = new_path(spark, "filter")
    known.write_filter(stored.limit(0), empty)
    assert known.new_figures(figures, stored.limit(0), known.HashFilter(spark, empty)).count() == figures.count()


def test_candidates_by_signature(spark):
    r = random.Random(4)
    words = ["pdf", "PDF", "table", "Tables", "figures", "figure", "FIGURE", "ocr", None]
    some = lambda n: None if r.random() < 0.1 else [r.choice(words) for _ in range(r.randrange(n))]
    providers = [(f"p{i}", i, r.choice(["local", "remote", None]), r.choice([True, True, False, None]), some(7)) for i in range(25)]
    requests = [(f"r{i}", r.choice(["private", "public", None]), some(4)) for i in range(200)]
    p = spark.createDataFrame(providers, "name string, ordinal int, location string, enabled boolean, capabilities array<string>")
    q = spark.createDataFrame(requests, "request_id string, privacy string, needs array<string>")
    found = routing.route_candidates(q, p)
    private = F.coalesce(F.col("privacy"), F.lit("private")) == "private"
    fits = routing.satisfies_capabilities(F.col("needs"), F.col("capabilities"))
    want = q.crossJoin(p).where(F.col("enabled") & ~(private & (F.col("location") == "remote")) & fits)
    assert sorted((x.request_id, x.provider) for x in found.collect()) == sorted((x.request_id, x.name) for x in want.collect())
    table = {(x.request_id, x.name): x.fits for x in routing.capability_table(q, p).collect()}
    assert table == {(x.request_id, x.name): bool(x.f) for x in q.crossJoin(p).withColumn("f", fits).collect()}
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
