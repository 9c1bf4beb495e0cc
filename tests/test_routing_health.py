import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from mediajobs.operators import health, routing
from mediajobs.sources import tables
from pyspark.sql import functions as F

PROVIDERS = [
    ("a", 0, "local", True, 10, ["PDF", "table"]), ("b", 1, "remote", True, 50, ["pdf", "Figures"]), ("c", 2, "local", True, 10, ["pdf", "figure", "table"]),
    ("d", 3, "local", False, 99, ["pdf"]),
]
REQUESTS = [("r1", "private", ["pdf"], "c"), ("r2", "public", ["figures"], "a"), ("r3", None, ["ocr"], None), ("r4", "public", [], "b"), ("r5", "public", ["FIGURE"], None)]


def frames(spark):
    p = spark.createDataFrame(PROVIDERS, "name string, ordinal int, location string, enabled boolean, priority int, capabilities array<string>")
    r = spark.createDataFrame(REQUESTS, "request_id string, privacy string, needs array<string>, preferred_provider string")
    return r, p


def test_routing_and_fallback(spark):
    r, p = frames(spark)
    ranked = routing.rank_candidates(routing.route_candidates(r, p))
    by = {}
    for x in ranked.orderBy("request_id", "rank").collect():
        by.setdefault(x.request_id, []).append(x.provider)
    # figures is not satisfied the other way round by a capability "Figures" for the need "FIGURE"
    assert by == {"r1": ["c", "a"], "r2": ["b", "c"], "r4": ["b", "a", "c"], "r5": ["c"]}
    attempts = spark.createDataFrame(
        [("r1", "c", False, "boom", 1.0), ("r1", "a", True, None, 2.0), ("r2", "b", True, None, 3.0), ("r4", "b", False, "e1", 1.0), ("r4", "a", False, "e2", 1.0), ("r4", "c", False, "e3", 1.0)],
        "request_id string, provider string, success boolean, error string, latency_ms double",
    )
    won = {x.request_id: (x.provider_name, x.status, x.attempted_providers, x.fallback_reason, x.latency_ms) for x in routing.resolve_fallback(ranked, attempts).collect()}
    assert won == {"r1": ("a", "fallback", ["c", "a"], "boom", 2.0), "r2": ("b", "success", ["b"], None, 3.0)}
    failed = {x.request_id: (x.code, x.attempted_providers, x.last_error) for x in routing.routing_failures(r, ranked, attempts).collect()}
    assert failed["r3"] == (503, [], None) and failed["r4"] == (502, ["b", "a", "c"], "e3")
    only = spark.createDataFrame([("r1", "a", True), ("r1", "c", False)], "request_id string, provider string, available boolean")
    assert [x.provider for x in routing.route_candidates(r, p, only).collect()] == ["a"]


def replay(events):
    state, out = {}, {}
    for p, t, i, kind, ms in sorted(events, key=lambda e: (e[1], e[2])):
        s = state.setdefault(p, dict(n=0, quota="unknown", cool=None, good=None, bad=None, ms=None))
        if kind == "success":
            s.update(n=0, cool=None, good=t, ms=ms)
        else:
            s.update(n=s["n"] + 1, bad=t)
            if kind == "quota":
                s["quota"] = "exhausted"
            s["cool"] = t + (3600.0 if kind == "quota" else min(30.0 * 2 ** (s["n"] - 1), 300.0))
        out[i] = (s["n"], s["quota"], s["cool"], s["good"], s["bad"], s["ms"])
    return out


def log(seed, n=300):
    r = random.Random(seed)
    return [(r.choice("xyz"), float(r.randrange(0, 4000) * 10), i, r.choices(["success", "failure", "quota"], [4, 8, 0.1])[0], float(i % 9)) for i in range(n)]


@pytest.mark.parametrize("slice_seconds", [100, 5000, 10**9])
def test_health_equals_replay(spark, slice_seconds):
    events = log(slice_seconds)
    df = spark.createDataFrame(events, "provider string, ts double, event_id long, kind string, latency_ms double")
    got = health.provider_health(df.repartition(5), slice_seconds).collect()
    assert {r.event_id: (r.failure_count, r.quota_state, r.cooldown_until, r.last_success, r.last_failure, r.latency_ms) for r in got} == replay(events)
    # availability as of any time
    providers = spark.createDataFrame([("x", True, None), ("y", True, True), ("z", False, True), ("w", True, None), ("v", True, False)], "name string, enabled boolean, executable_present boolean")
    asks = [(i, float(t)) for i, t in enumerate(range(0, 41000, 777))]
    req = spark.createDataFrame(asks, "request_id long, ts double")
    out = health.provider_available_at(req, health.provider_health(df, slice_seconds), providers, slice_seconds).collect()
    assert len(out) == len(asks) * 5
    for r in out:
        t = asks[int(r.request_id)][1]
        seen = replay([e for e in events if e[0] == r.provider and e[1] <= t])
        last = list(seen.values())[-1] if seen else None
        up = r.provider not in ("z", "v") and (last is None or (last[1] != "exhausted" and (last[2] is None or t >= last[2])))
        assert r.available == up
    report = {r.name: r.failure_count for r in health.provider_status_report(health.provider_health(df), providers).collect()}
    assert report["w"] is None and set(report) == set("xyzwv")


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 40))
def test_backoff_curve(n):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is not None:
        assert spark.range(1).select(health.cooldown_seconds(F.lit(n), F.lit(False))).first()[0] == min(30.0 * 2 ** (n - 1), 300.0)


def test_attempt_outcomes(spark):
    rows = [(429, "single", False, "quota"), (204, "single", False, "failure"), (204, "step", False, "success"), (202, "poll", False, "failure"), (202, "workflow_poll", False, "success"), (None, "single", False, "failure"), (200, "single", True, "failure")]
    df = spark.createDataFrame(rows, "s int, k string, f boolean, want string")
    for r in df.select("want", health.classify_attempt(F.col("s"), F.col("k"), F.col("f")).alias("got")).collect():
        assert r.got == r.want


def test_dimension_tables(spark, tmp_path):
    f = tmp_path / "p.yaml"
    f.write_text("providers:\n  one: {driver: http, location: local, capabilities: [pdf]}\n  bad: 3\n  two: {driver: cli, command: ocr, priority: 7}\n")
    got = tables.load_provider_dim(spark, str(f), executables=frozenset()).orderBy("ordinal").collect()
    assert [(r.name, r.ordinal, r.location, r.priority, r.executable_present) for r in got] == [("one", 0, "local", 100, None), ("two", 1, "remote", 7, False)]
    for text, error in (("providers: {x: {driver: ftp}}", ValueError), ("providers: {}", ValueError), ("[1]", ValueError), ("a: [", RuntimeError)):
        f.write_text(text)
        with pytest.raises(error):
            tables.load_provider_dim(spark, str(f))
    with pytest.raises(FileNotFoundError):
        tables.load_provider_dim(spark, str(tmp_path / "none"))
    assert tables.load_provider_dim(spark, str(tmp_path / "none"), explicit=False).count() == 0
    assert {r.id: r.ovms_model for r in tables.load_model_dim(spark).collect()}["bge-m3"] == "bge-m3-i8"
    f.write_text("models:\n  m: {type: embedding, model_id: served}\n  n: {type: rerank, policy: CPU_ONLY}\n  bad: 3\n")
    got = tables.load_model_dim(spark, str(f)).collect()
    assert [(r.id, r.ovms_model, r.policy) for r in got] == [("m", "served", "GPU_PREFERRED"), ("n", "n", "CPU_ONLY")]
    j = tmp_path / "m.json"
    j.write_text('{"k": {"type": "embedding", "max_length": 512}}')
    assert [(r.id, r.max_length) for r in tables.load_model_dim(spark, str(tmp_path / "none"), str(j)).collect()] == [("k", 512)]
