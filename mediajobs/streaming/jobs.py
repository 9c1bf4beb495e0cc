"""Incremental forms of the ingest, health and statistics operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import embedding, health, ingest
from ..sources import tables

HEALTH_STATE = "failure_count int, quota string, cooldown_until double, last_success double, last_failure double, latency_ms double"
HEALTH_OUT = "provider string, event_id long, " + HEALTH_STATE.replace("quota string", "quota_state string")


def ingest_stream(figures: DataFrame, vectors: DataFrame, root: str, checkpoint: str, models: tuple[str, str], sizes: tuple[int, int], as_of: float):
    """Writer that appends each micro-batch's new media; known hashes come from the table itself, so state stays small.

    A batch that is run again finds its own hashes in the table and adds nothing.
    """

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            media = tables.read_media(spark, root, sizes)
            media.schema["hash"]
        except Exception as e:  # the first batch makes the table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            media = spark.createDataFrame([], "hash string")
        records, _hashed = ingest.ingest(batch, media, vectors, *models, sizes, as_of)
        tables.write_media(records, root, sizes)

    return figures.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def dedup_stream(figures: DataFrame, column: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first figure of each hash within the watermark."""
    return figures.withWatermark(column, late).dropDuplicatesWithinWatermark(["hash"])


def durable_state(spark: SparkSession) -> None:
    """State of streaming queries in RocksDB, whose checkpoints hold changes only; for state that is kept for ever."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def dedup_stream_exact(figures: DataFrame) -> DataFrame:
    """The first figure of each hash, however late its copies come: known hashes are kept for ever (see ``durable_state``).

    Null hashes are one hash. Of copies in one micro-batch, any one is the first.
    """
    return figures.dropDuplicates(["hash"])


#: The state of a provider without events.
FRESH = (0, "unknown", None, None, None, None)


def after(state: tuple, t: float, kind: str, latency: float | None) -> tuple:
    """A provider's HEALTH_STATE after an event."""
    n, quota, _, good, bad, last = state
    if kind == "success":
        return 0, quota, None, t, bad, latency
    wait = health.QUOTA_COOLDOWN_S if kind == "quota" else min(health.BACKOFF_S * 2 ** min(n, 19), health.MAX_BACKOFF_S)
    return n + 1, "exhausted" if kind == "quota" else quota, t + wait, good, t, last


def health_stream(events: DataFrame) -> DataFrame:
    """State of each provider after each event; ``events``: provider, t (epoch seconds), event_id, kind, latency_ms."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else FRESH
        out = []
        for e in pd.concat(parts).sort_values(["t", "event_id"]).itertuples():
            now = after(now, float(e.t), e.kind, float(e.latency_ms))
            out.append((key[0], int(e.event_id), *now))
        state.update(now)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in HEALTH_OUT.split(", ")])

    return events.groupBy("provider").applyInPandasWithState(step, HEALTH_OUT, HEALTH_STATE, "append", GroupStateTimeout.NoTimeout)


WAITING = "t double, event_id long, kind string, latency_ms double"


class _InOrder(StatefulProcessor):
    """A provider's events, kept until no earlier one can come, and then replayed in their order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", HEALTH_STATE)
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            events = [(float(e.t), int(e.event_id), e.kind, None if pd.isna(e.latency_ms) else float(e.latency_ms)) for e in part.itertuples()]
            self.waiting.appendList(events)
            for ms in {int(1000 * e[0]) for e in events}:
                self.handle.registerTimer(ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # all that the watermark has passed at once; later timers of the batch find nothing left
        until = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        held = [tuple(e) for e in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((e for e in held if int(1000 * e[0]) <= until), key=lambda e: e[:2])
        if not due:
            return
        rest = [e for e in held if int(1000 * e[0]) > until]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        state = tuple(self.now.get()) if self.now.exists() else FRESH
        out = []
        for t, event_id, kind, latency in due:
            state = after(state, t, kind, latency)
            out.append((key[0], event_id, *state))
        self.now.update(state)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in HEALTH_OUT.split(", ")])

    def close(self) -> None:
        pass


def health_stream_ordered(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The same as ``health_stream`` for events in any order, up to ``late`` behind the latest; what comes later is left out.

    An event's state comes once the watermark has passed it. Needs ``durable_state``.
    """
    timed = events.withColumn("at", F.timestamp_seconds("t")).withWatermark("at", late)
    return timed.groupBy("provider").transformWithStateInPandas(_InOrder(), HEALTH_OUT, "Append", "EventTime")


def stats_stream(items: DataFrame) -> DataFrame:
    """Running counts by bucket (complete mode)."""
    n = F.greatest(F.col("n_tokens"), F.lit(1)).cast("long")
    return items.groupBy(embedding.bucket_of(n).alias("bucket")).agg(F.count("*").alias("items"), F.sum(n).alias("token_sum"), F.max(n).alias("max_tokens"))


def run_available(writer, on_done: Callable | None = None) -> None:
    """Run a writer over what there is now, and end."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    if on_done:
        on_done()
