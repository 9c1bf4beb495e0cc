import pytest
from mediajobs.operators import health
from mediajobs.sources import tables
from mediajobs.streaming import jobs
from pyspark.sql import functions as F
from test_media import FIG_SCHEMA, FIGURES
from test_routing_health import log, replay


def source(spark, rows, schema, path, files=3):
    for i in range(files):
        spark.createDataFrame(rows[i::files], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_ingest_stream_equals_batch(spark, tmp_path):
    figures = source(spark, FIGURES, FIG_SCHEMA, str(tmp_path / "in"))
    vectors = spark.createDataFrame([], "hash string, model string, vector array<float>")
    for _ in range(2):
        jobs.run_available(jobs.ingest_stream(figures, vectors, str(tmp_path / "media"), str(tmp_path / "cp"), ("clip", "dino"), (2, 3), 1.0))
        media = tables.read_media(spark, str(tmp_path / "media"), (2, 3))
        assert media.count() == media.select("hash").distinct().count() == 2


def test_health_stream_equals_replay(spark, tmp_path):
    events = log(11, 60)
    schema = "provider string, t double, event_id long, kind string, latency_ms double"
    stream = source(spark, events, schema, str(tmp_path / "in"), files=1)
    out = jobs.health_stream(stream).writeStream.format("memory").queryName("health").outputMode("append").option("checkpointLocation", str(tmp_path / "cp"))
    jobs.run_available(out)
    got = {r.event_id: (r.failure_count, r.quota_state, r.cooldown_until, r.last_success, r.last_failure, r.latency_ms) for r in spark.table("health").collect()}
    assert got == replay(events)
    batch = health.provider_health(spark.createDataFrame(events, schema).withColumnRenamed("t", "ts"))
    assert got == {r.event_id: (r.failure_count, r.quota_state, r.cooldown_until, r.last_success, r.last_failure, r.latency_ms) for r in batch.collect()}


def test_shuffled_health_events_equal_replay(spark, tmp_path):
    import random

    events = sorted(log(12, 90), key=lambda e: e[1])
    # each comes up to some 20 places late
    r = random.Random(5)
    shuffled = [e for _, e in sorted((i + r.uniform(0, 20), e) for i, e in enumerate(events))]
    schema = "provider string, t double, event_id long, kind string, latency_ms double"
    parts = [shuffled[i : i + 25] for i in range(0, 90, 25)]
    lateness = max(max(e[1] for e in sum(parts[: i + 1], [])) - min(e[1] for e in p) for i, p in enumerate(parts))
    path = str(tmp_path / "in")
    for p in [*parts, [("end", 1e6, -1, "success", 0.0)]]:
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        try:
            jobs.durable_state(spark)
            out = jobs.health_stream_ordered(stream, f"{int(lateness) + 1} seconds").writeStream.format("parquet").option("path", str(tmp_path / "out"))
            jobs.run_available(out.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")))
        finally:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
            spark.conf.unset("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled")
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    got = {r.event_id: (r.failure_count, r.quota_state, r.cooldown_until, r.last_success, r.last_failure, r.latency_ms) for r in rows}
    assert len(rows) == len(events) and got == replay(events)


def test_running_statistics_and_dedup(spark, tmp_path):
    rows = [(n, "2024-01-01 00:00:00", f"h{n % 2}") for n in (1, 5, 300, 600, 0)]
    stream = source(spark, rows, "n_tokens int, ts string, hash string", str(tmp_path / "in"))
    jobs.run_available(jobs.stats_stream(stream).writeStream.format("memory").queryName("stats").outputMode("complete"))
    assert {r.bucket: (r.items, r.token_sum, r.max_tokens) for r in spark.table("stats").collect()} == {0: (3, 7, 5), 1: (1, 300, 300), 3: (1, 600, 600)}
    first = jobs.dedup_stream(stream.withColumn("ts", F.to_timestamp("ts")))
    jobs.run_available(first.writeStream.format("memory").queryName("dedup").outputMode("append"))
    assert sorted(r.hash for r in spark.table("dedup").collect()) == ["h0", "h1"]


def test_exact_dedup_outlives_watermarks_and_restarts(spark, tmp_path):
    schema, folder = "n int, hash string, ts timestamp", str(tmp_path / "in")

    def arrive(rows):
        df = spark.createDataFrame([(n, h, t) for n, h, t in rows], "n int, hash string, ts string").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).withWatermark("ts", "1 minute")
        jobs.run_available(jobs.dedup_stream_exact(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")))

    key = "spark.sql.streaming.stateStore.providerClass"
    try:
        jobs.durable_state(spark)
        arrive([(1, "a", "2024-01-01 00:00:00"), (2, "b", "2024-01-01 00:00:01"), (3, None, "2024-01-01 00:00:01")])
        run()
        arrive([(4, "c", "2024-03-01 00:00:00")])
        run()  # another run of the query, with the state of the first
        arrive([(5, "a", "2024-03-01 00:00:01"), (6, "b", "2024-05-01 00:00:00"), (7, None, "2024-05-01 00:00:00"), (8, "d", "2024-05-01 00:00:00")])
        run()
    finally:
        spark.conf.unset(key)
        spark.conf.unset("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled")
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3, 4, 8]
    assert list((tmp_path / "cp" / "state").rglob("*.changelog"))


@pytest.mark.parametrize("name", ["entry", "queries"])
def test_entry_points(spark, name):
    import __spark_entry__ as e

    if name == "entry":
        assert e.entry(spark).count() > 0
    else:
        assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_outside_imports_llm():
    import pathlib
    import re

    root = pathlib.Path(__file__).resolve().parents[1]
    for f in (root / "mediajobs").rglob("*.py"):
        if f.parent.name != "llm":
            assert not re.search(r"import .*\bllm\b|from .*\bllm\b", f.read_text()), f
