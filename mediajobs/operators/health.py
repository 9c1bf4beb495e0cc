"""Provider health, replayed from event logs.

``events``: provider, ts, event_id (breaks ties), kind (success, failure, quota), latency_ms.
A provider's log may be long: state is combined over slices of time first
(``slice_seconds``) and then within each slice, so no window holds a whole log.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import cut

#: Accepted status codes by kind of call (fixed values).
ACCEPTED = {"single": (200, 201, 202), "step": (200, 201, 202, 204), "poll": (200,), "workflow_poll": (200, 201, 202)}
BACKOFF_S, MAX_BACKOFF_S, QUOTA_COOLDOWN_S = 30.0, 300.0, 3600.0
SLICE_SECONDS = 6 * 3600


def classify_attempt(status: Column, call_kind: Column, failed: Column | None = None) -> Column:
    """success, failure or quota; ``failed`` marks exceptions, timeouts and non-zero exits."""
    ok = F.lit(False)
    for kind, codes in ACCEPTED.items():
        ok = ok | ((call_kind == kind) & status.isin(*codes))
    out = F.when(status == 429, "quota").when(F.coalesce(ok, F.lit(False)), "success").otherwise("failure")
    return out if failed is None else F.when(F.coalesce(failed, F.lit(False)), "failure").otherwise(out)


def cooldown_seconds(failures: Column, quota: Column) -> Column:
    backoff = F.least(BACKOFF_S * F.pow(F.lit(2.0), F.least(failures, F.lit(20)) - 1), F.lit(MAX_BACKOFF_S))
    return F.when(quota, F.lit(QUOTA_COOLDOWN_S)).otherwise(backoff)


def provider_health(events: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """The state after each event: failure_count, quota_state, cooldown_until, last_success, last_failure, latency_ms.

    Times are epoch seconds. A success resets count and cooldown, not the quota.
    """
    t = F.col("ts").cast("double")
    e = events.withColumns(
        {"t": t, "ok": F.col("kind") == "success", "quota": F.col("kind") == "quota", "slice": F.floor(t / slice_seconds)}
    )
    order = F.struct("t", "event_id")
    ends = e.groupBy("provider", "slice").agg(
        F.max(F.when(F.col("ok"), order)).alias("last_ok"),
        F.max_by("latency_ms", F.when(F.col("ok"), order)).alias("ok_latency"),
        F.max(F.when(~F.col("ok"), F.col("t"))).alias("last_bad"),
        F.max("quota").alias("any_quota"),
        F.count_if(~F.col("ok")).alias("bad"),
    )
    # failures behind a slice's last success
    tail = e.join(ends.select("provider", "slice", "last_ok"), ["provider", "slice"]).groupBy("provider", "slice").agg(
        F.count_if(~F.col("ok") & (F.col("last_ok").isNull() | (order > F.col("last_ok")))).alias("run")
    )
    before = W.partitionBy("provider").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.join(tail, ["provider", "slice"])
    epoch = F.sum(F.col("last_ok").isNotNull().cast("int")).over(W.partitionBy("provider").orderBy("slice"))
    ends = ends.withColumn("epoch", epoch)
    within = W.partitionBy("provider", "epoch").orderBy("slice").rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = ends.withColumn("run_to_here", F.sum("run").over(within)).select(
        "provider",
        "slice",
        F.coalesce(F.lag("run_to_here").over(W.partitionBy("provider").orderBy("slice")), F.lit(0)).alias("run_before"),
        F.coalesce(F.max("any_quota").over(before), F.lit(False)).alias("quota_before"),
        F.max("last_ok.t").over(before).alias("ok_before"),
        F.last("ok_latency", True).over(before).alias("latency_before"),
        F.max("last_bad").over(before).alias("bad_before"),
    )
    w = W.partitionBy("provider", "slice").orderBy("t", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    e = e.join(carried, ["provider", "slice"]).withColumn("group", F.sum(F.col("ok").cast("int")).over(w))
    g = W.partitionBy("provider", "slice", "group").orderBy("t", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    count = F.count_if(~F.col("ok")).over(g) + F.when(F.col("group") == 0, F.col("run_before")).otherwise(0)
    sticky = F.greatest(F.max("quota").over(w), F.col("quota_before"))
    e = e.withColumn("failure_count", F.when(F.col("ok"), F.lit(0)).otherwise(count).cast("int"))
    return e.select(
        "provider",
        "ts",
        "event_id",
        "kind",
        "failure_count",
        F.when(sticky, "exhausted").otherwise("unknown").alias("quota_state"),
        F.when(~F.col("ok"), F.col("t") + cooldown_seconds(F.col("failure_count"), F.col("quota"))).alias("cooldown_until"),
        F.coalesce(F.last(F.when(F.col("ok"), F.col("t")), True).over(w), "ok_before").alias("last_success"),
        F.coalesce(F.last(F.when(~F.col("ok"), F.col("t")), True).over(w), "bad_before").alias("last_failure"),
        F.coalesce(F.last(F.when(F.col("ok"), F.col("latency_ms")), True).over(w), "latency_before").alias("latency_ms"),
    )


#: Rows of states and times of a slice, about.
SLICE_ROWS = 16384


def provider_available_at(requests: DataFrame, health: DataFrame, providers: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """request_id, provider, available: as of the request's time.

    ``providers``: name, enabled, executable_present (null counts as present), a dimension
    table. A provider without events is available; a state at a request's time counts.

    Which providers are down changes with states only, and requests of one time find the
    same. So states and the distinct times of requests are sorted over slices (by
    sampled splits, so no slice is large), each slice is merged in one pass, and
    the providers that are down travel as one array for each time. What a slice starts
    with is the last state of each provider before it.
    """
    states = health.select("provider", F.col("ts").cast("double").alias("t"), F.lit(0).alias("side"), "event_id", "quota_state", F.col("cooldown_until").cast("double").alias("cooldown_until"))
    asks = requests.select(F.col("ts").cast("double").alias("t")).distinct()
    asks = asks.select(F.lit(None).cast("string").alias("provider"), "t", F.lit(1).alias("side"), F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("string").alias("quota_state"), F.lit(None).cast("double").alias("cooldown_until"))
    both = states.union(asks)
    n, order = max(1, -(-both.count() // slice_rows)), ["t", "side", "event_id"]
    both = cut(both.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    # the last state of each provider in each slice, and of all slices before the next one
    ends = both.where("side = 0").groupBy("provider", part.alias("slice")).agg(F.max_by(F.struct("quota_state", "cooldown_until"), "at").alias("s"))
    until = F.coalesce(F.lead("slice").over(W.partitionBy("provider").orderBy("slice")), F.lit(n))
    carried = ends.withColumn("until", until).where("until > slice")
    starts = carried.select(F.explode(F.sequence(F.col("slice") + 1, "until")).alias("slice"), "provider", "s").where(F.col("slice") < n)
    starts = starts.select("slice", F.lit(-1).cast("long").alias("at"), "provider", F.lit(None).cast("double").alias("t"), F.lit(0).alias("side"), "s.quota_state", "s.cooldown_until")
    rows = both.select(part.alias("slice"), "at", "provider", "t", "side", "quota_state", "cooldown_until").union(starts)
    down = rows.repartition("slice").sortWithinPartitions("slice", "at").mapInArrow(_down, "_t double, down array<string>")
    # all providers in one row: they are a dimension table
    up = F.col("enabled") & F.coalesce("executable_present", F.lit(True))
    listed = providers.agg(F.collect_list(F.struct(F.col("name").alias("provider"), up.alias("on"))).alias("p"))
    asked = requests.withColumn("t", F.col("ts").cast("double")).join(down, F.col("t").eqNullSafe(F.col("_t")), "left").select("request_id", "down")
    out = asked.crossJoin(F.broadcast(listed)).select("request_id", "down", F.explode("p").alias("p"))
    free = ~F.coalesce(F.array_contains("down", F.col("p.provider")), F.lit(False))
    return out.select("request_id", "p.provider", (F.col("p.on") & free).alias("available"))


def _down(batches):
    """Rows sorted by slice and place (slice, at, provider, t, side, quota_state, cooldown_until) to the times asked for and the providers down then."""
    own, exhausted, cooling = None, set(), {}
    for b in batches:
        times, downs = [], []
        for slice_, _, provider, t, side, quota, until in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if slice_ != own:
                own, exhausted, cooling = slice_, set(), {}
            if side == 0:
                exhausted.discard(provider)
                cooling.pop(provider, None)
                if quota == "exhausted":
                    exhausted.add(provider)
                elif until is not None:
                    cooling[provider] = until
                continue
            times.append(t)
            if t is not None:
                cooling = {p: u for p, u in cooling.items() if t < u}
            downs.append([*exhausted, *cooling])
        yield pa.RecordBatch.from_arrays([pa.array(times, pa.float64()), pa.array(downs, pa.list_(pa.string()))], ["_t", "down"])


def provider_status_report(health: DataFrame, providers: DataFrame) -> DataFrame:
    """Every provider's definition with its latest state (nulls without events)."""
    names = ["failure_count", "quota_state", "cooldown_until", "last_success", "last_failure", "latency_ms"]
    latest = health.groupBy(F.col("provider").alias("name")).agg(F.max_by(F.struct(*names), F.struct("ts", "event_id")).alias("s"))
    return providers.join(latest, "name", "left").select(*providers.columns, *[f"s.{n}" for n in names])
