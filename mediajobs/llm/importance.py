"""Target-distribution importance resampling (operator 11).

Hashed features: words (a-z, 0-9 and all beyond ASCII, after A-Z are lower-cased)
and runs of up to RUN words, joined by one space, fall into BUCKETS buckets by
crc32. A bucket's gain is the log ratio, in thousandths, of its share in the
target texts to its share in all documents, both with one more in each bucket.

1. Gains. Each task counts the buckets of its texts in one array; the arrays' sums
   give the BUCKETS gains, the only thing that travels.
2. Scores. A document's weight is the floored mean of its features' gains, looked
   up in the array. A Gumbel draw from the id's digest makes the highest scores a
   sample without replacement, with chances in the ratio of the weights'
   exponentials. The narrow rows are written once.
3. Quickselect. The last winner is the k-th key in the order of score (falling),
   id, number of features and row. Random pivot keys are drawn from the rows in
   question; one pass counts exactly, for each pivot, what lies before it, is it,
   and lies behind it; the stretch with the k-th key stays in question. The driver
   holds the pivots and their counts only, and rounds grow with the logarithm.
4. Ranks. Winners alone are sorted, over ranges of keys; each range's rows are
   numbered from the sum of the ranges before it. The others are never sorted.

Defined cases: null and empty texts have no features and weight 0; texts of fewer
than LEAST_WORDS words are scored but never drawn. Null ids draw as the word
``null`` and are last among ties. Repeated ids are rows of their own, with the same
draw. Equal rows have neighbouring ranks in any order. Very long texts are read
whole. Without target texts, or without documents, gains follow from the ones
added; an empty table gives an empty table. Other columns aren't looked at.
"""

from __future__ import annotations

import json
import math
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, written
from .textbuf import ALNUM, Words, slices

BUCKETS = 10_000
RUN = 2
LEAST_WORDS = 20
#: Of the documents with LEAST_WORDS words, so many in a hundred are drawn.
PERCENT = 25
SEED = 7
#: Pivot keys of a round.
PIVOTS = 63

ORDER = ("fall", "unnamed", "id", "n_features", "row")

#: Words of more bytes are taken by zlib, one by one.
LONG_WORD = 64
_BYTES = np.arange(256, dtype=np.uint32)
for _ in range(8):  # the reflected polynomial of crc32, bit by bit
    _BYTES = np.where(_BYTES & np.uint32(1), (_BYTES >> np.uint32(1)) ^ np.uint32(0xEDB88320), _BYTES >> np.uint32(1))


def extended(state: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """States of crc32 after the bytes ``buf[start:end]``, for all at once, byte by byte."""
    size = end - start
    order = np.argsort(-np.minimum(size, LONG_WORD + 1).astype(np.int16), kind="stable")
    out, at, falling = state[order], start[order], -size[order]
    shown = np.maximum(falling, -LONG_WORD - 1)  # in order
    for j in range(min(LONG_WORD, int(size.max(initial=0)))):
        n = np.searchsorted(shown, -j)
        out[:n] = _BYTES[(out[:n] ^ buf[at[:n] + j]) & np.uint32(255)] ^ (out[:n] >> np.uint32(8))
    for i in np.flatnonzero(falling < -LONG_WORD).tolist():
        out[i] = zlib.crc32(buf[at[i] + LONG_WORD : at[i] - falling[i]].tobytes(), int(~out[i])) ^ 0xFFFFFFFF
    back = np.empty_like(out)
    back[order] = out
    return back


def features(words: Words, run: int = RUN) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of run: the words that begin a run within their text, and the crc32 of these runs."""
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    at = np.arange(len(text))
    state = extended(np.full(len(text), 0xFFFFFFFF, np.uint32), words.buf, words.start, words.end)
    yield at, ~state
    for m in range(2, run + 1):
        more = at + m - 1 < len(text)
        more[more] = text[at[more]] == text[at[more] + m - 1]
        at, state = at[more], state[more]
        state = _BYTES[(state ^ np.uint32(0x20)) & np.uint32(255)] ^ (state >> np.uint32(8))
        last = at + m - 1
        state = extended(state, words.buf, words.start[last], words.end[last])
        yield at, ~state


def counts(texts: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of ``texts`` (text) a bucket holds; each task sends its sums only."""

    def count(batches):
        sums = np.zeros(buckets, np.int64)
        for b in batches:
            for words in slices(b.column(0), ALNUM):
                for _, crc in features(words, run):
                    sums += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """A gain for each bucket: floor(1000 * ln of (t + 1) (S + buckets) / ((s + 1) (T + buckets)))."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for sums, texts in ((s, docs), (t, target)):
        for bucket, n in counts(texts, run, buckets).collect():  # at most ``buckets`` rows
            sums[bucket] = n
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


SCORED = "doc_id {}, n_words long, n_features long, total long"


def scored(docs: DataFrame, gain: np.ndarray, run: int = RUN, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""

    def total(batches):
        for b in batches:
            for words in slices(b.column(1), ALNUM):
                sums, n = np.zeros(len(words.counts), np.int64), np.zeros(len(words.counts), np.int64)
                for m, (at, crc) in enumerate(features(words, run)):
                    of = np.zeros(len(words.start) + 1, np.int64)
                    of[at + 1] = gain[crc % np.uint32(len(gain))]
                    of = np.cumsum(of)
                    sums += of[words.first[1:]] - of[words.first[:-1]]
                    n += np.maximum(0, words.counts - m)
                ids = b.column(0).slice(words.lo, len(n))
                yield pa.RecordBatch.from_arrays([ids, pa.array(words.counts, pa.int64()), pa.array(n), pa.array(sums)], ["doc_id", "n_words", "n_features", "total"])

    rows = docs.select("doc_id", "text").mapInArrow(total, SCORED.format(docs.schema["doc_id"].dataType.simpleString()))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    draw = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    weight = F.when(F.col("n_features") > 0, F.floor(F.col("total") / F.col("n_features"))).otherwise(0).cast("long")
    return rows.withColumn("weight", weight).select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + draw).alias("score"))


def _keys(rows: list[tuple]) -> Column:
    """Keys as one constant, an array of structs of ORDER."""
    kind = ", ".join(f"{c}: bigint" for c in ORDER)
    return F.from_json(F.lit(json.dumps([dict(zip(ORDER, row, strict=True)) for row in rows])), f"array<struct<{kind}>>")


def _key(row: tuple) -> Column:
    return F.get(_keys([row]), F.lit(0))


def quickselect(keys: DataFrame, k: int, pivots: int = PIVOTS, seed: int = SEED) -> tuple:
    """The k-th smallest of the ORDER columns of ``keys``, which are longs without nulls and unique together; 1 <= k <= rows."""
    key, draws = F.struct(*ORDER), random.Random(seed)
    low = high = None
    while True:
        rows = keys
        if low is not None:  # the first column's range also reaches the scan
            rows = rows.where((F.col(ORDER[0]) >= low[0]) & (key > _key(low)))
        if high is not None:
            rows = rows.where((F.col(ORDER[0]) <= high[0]) & (key < _key(high)))
        chosen = sorted(map(tuple, rows.select(*ORDER).orderBy(F.rand(draws.getrandbits(31))).limit(pivots).collect()))
        # 2 for each pivot before a key, 1 for the pivot that it is
        side = lambda n, p: n + F.when(p < F.col("key"), 2).when(p == F.col("key"), 1).otherwise(0)
        place = F.aggregate(_keys(chosen), F.lit(0), side)
        counts = dict(rows.select(key.alias("key")).groupBy(place.alias("place")).count().collect())
        for at in range(2 * len(chosen) + 1):
            n = counts.get(at, 0)
            if k <= n:
                break
            k -= n
        if at % 2:
            return chosen[at // 2]
        low, high = (chosen[at // 2 - 1] if at else low), (chosen[at // 2] if at < 2 * len(chosen) else high)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with rank 1, 2, ... in the order of ``order``."""
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    ranges = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # one row for each range
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(ranges.select("part", before.alias("start")))
    rank = F.col("start") + (F.col("at") - F.shiftleft(F.col("part"), 33)) + 1
    return placed.withColumn("part", part).join(starts, "part").withColumn("rank", rank).drop("part", "start", "at")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, pivots: int = PIVOTS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every document.

    ``docs`` has doc_id and text, ``target`` has text.
    """
    found = scored(docs, gains(docs, target), seed=seed).withColumn("row", F.monotonically_increasing_id())
    rows = written(found.withColumns({
        "fall": -F.col("score"), "unnamed": F.col("doc_id").isNull().cast("long"), "id": F.coalesce("doc_id", F.lit(0)).cast("long"),
    }), "importance")
    able = F.col("n_words") >= LEAST_WORDS
    k = percent * rows.where(able).count() // 100
    result = ["doc_id", "n_features", "weight", "score"]
    null = F.lit(None).cast("long").alias("rank")
    if k == 0:
        return rows.select(*result, null)
    last = quickselect(rows.where(able), k, pivots, seed)
    drawn = able & (F.struct(*ORDER) <= _key(last))
    winners = ranked(rows.where(drawn).select(*result, *ORDER[:3], "row"), list(ORDER))
    return rows.where(~drawn).select(*result, null).union(winners.select(*result, "rank"))
