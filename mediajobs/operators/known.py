"""A stored Bloom filter of the hashes that a media table holds.

Most new figures aren't in the table; the filter knows this for nearly all of them
where they are, so only the others are shuffled and joined. It may take a new hash
for a known one, never the other way round, so results stay exact.

The filter is a table beside the media: 64-bit words, BITS of each set by a hash, its
word and bits chosen by the hash's digest. New hashes are added by writing their
words, too; reading joins words with OR. It has MOST_WORDS words at most (64 MB), the
size that tasks hold; beyond some 40 million hashes more figures are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a filter at most, and hashes for each of them, about.
MOST_WORDS, WORD_HASHES = 1 << 23, 5
BITS = 5
LEAST_WORDS = 1 << 10




def words_for(hashes: int) -> int:
    """Words of a filter of so many hashes: a power of two."""
    return min(MOST_WORDS, max(LEAST_WORDS, 1 << (max(1, hashes // WORD_HASHES) - 1).bit_length()))


def _spots(words: int) -> tuple[Column, Column]:
    """Word and bits of the column hash."""
    h = F.xxhash64("hash")
    word = h.bitwiseAND(F.lit(words - 1))
    bits = F.lit(0).cast("long")
    for i in range(BITS):  # six bits of the upper half for each
        bits = bits.bitwiseOR(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(hash), {32 + 6 * i}) & 63 as int))"))
    return word, bits


def write_filter(media: DataFrame, path: str, words: int | None = None) -> None:
    """Adds the hashes of ``media`` (hash) to the filter at ``path``; ``words``: its size, if it is a new one."""
    hashes = media.select("hash").where("hash is not null")
    words = words or words_for(hashes.count())
    word, bits = _spots(words)
    rows = hashes.groupBy(word.alias("word")).agg(F.bit_or(bits).alias("bits"))
    rows.withColumn("words", F.lit(words)).write.mode("append").parquet(path)


def add_to_filter(media: DataFrame, path: str) -> None:
    """Adds the hashes of ``media`` to the filter that is at ``path``, in its size."""
    known = media.sparkSession.read.parquet(path).select("words").first()
    write_filter(media, path, known.words if known else None)


class HashFilter:
    """The filter at a path, for use in queries."""

    def __init__(self, spark: SparkSession, path: str):
        stored = spark.read.parquet(path)
        self.size = (stored.select("words").first() or [LEAST_WORDS])[0]
        words = np.zeros(self.size, np.int64)
        # at most MOST_WORDS pairs of longs, in Arrow batches
        for batch in stored.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow().to_batches():
            words[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
        self.words = spark.sparkContext.broadcast(words)

    def maybe(self) -> Column:
        """Whether the table may hold a row's hash; null: no."""
        shared = self.words

        def held(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            words = shared.value
            for word, bits in batches:
                yield pd.Series((words[word.to_numpy()] & bits.to_numpy()) == bits.to_numpy())

        return F.pandas_udf(held, "boolean")(*_spots(self.size)) & F.col("hash").isNotNull()


def new_figures(figures: DataFrame, media: DataFrame, known: HashFilter) -> DataFrame:
    """``figures`` (hash) whose hash ``media`` lacks: those that the filter rules out stay where they are, the others are joined."""
    stored = media.select("hash").where("hash is not null")
    marked = figures.withColumn("_maybe", known.maybe())
    sure = marked.where(F.coalesce(~F.col("_maybe"), F.lit(True)))
    joined = marked.where("_maybe").join(stored, "hash", "left_anti")
    return sure.select(*figures.columns).unionByName(joined.select(*figures.columns))
