"""Sharding by extendible hashing (operator 8, DataFrame functions only).

A shard is a prefix of the bits of a document's hash. The directory starts with
the empty prefix; a bucket over LIMIT bytes splits on its next bit, and only
such buckets split. Bytes are counted for STEP_BITS bits at a time over the rows
of buckets that are still too large, so the number of rounds is the depth over
STEP_BITS; each round is one aggregation without any rows in one place.

A bucket of all BITS bits that is still too large holds rows of one hash: it is
an overflow chain, whose rows are dealt to pages of LIMIT bytes in turn; equal
rows are counted, not gathered. A single row over LIMIT is a page of its own.

The hash is of the id (null hashes as the text "null"); ids with one hash always
share a shard. Very long texts count by their bytes only. Null texts have 0 bytes. Repeated
rows are rows of their own. The directory tells for any id its shard. Extra
columns are not looked at by ``assign``; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: Bytes of a shard, at most.
LIMIT = 1 << 20
BITS = 32
STEP_BITS = 8


def hash_bits(doc_id):
    """The first BITS bits of the id's md5, as a string of 0 and 1."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    return F.lpad(F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 2), BITS, "0")


def directory(sized: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(prefix, depth, bytes, rows) of all buckets. ``sized`` has bits and bytes.

    ``open`` are buckets too large so far, with the sums of all their
    extensions by STEP_BITS bits. Of a row's prefixes between the round's
    lengths, the shortest whose bucket fits is a leaf.
    """
    leaves, todo = None, sized.groupBy("bits").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))
    todo = cut(todo.withColumn("at", F.lit("")))
    for lo in range(0, BITS, STEP_BITS):
        hi = lo + STEP_BITS
        depths = F.sequence(F.lit(lo), F.lit(hi))
        fine = todo.groupBy("at", F.substring("bits", 1, hi).alias("fine")).agg(
            F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")
        )
        sums = cut(
            fine.withColumn("depth", F.explode(depths)).withColumn("prefix", F.expr("substring(fine, 1, depth)"))
            .groupBy("prefix", "depth").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        )
        fits = sums.where((F.col("bytes") <= limit) | ((F.col("rows") == 1) | (F.col("depth") == BITS)))
        # a bucket that fits is a leaf if the one above it doesn't; the root has none above it
        above = sums.where((F.col("bytes") > limit) & (F.col("rows") > 1)).select(
            F.col("prefix").alias("up"), (F.col("depth") + 1).alias("up_depth")
        )
        found = fits.where("depth > 0").join(
            above, (F.expr("substring(prefix, 1, depth - 1)") == F.col("up")) & (F.col("depth") == F.col("up_depth")), "left_semi"
        )
        if lo == 0:
            found = found.union(fits.where("depth = 0"))
        found = cut(found.select("prefix", "depth", "bytes", "rows"))
        leaves = found if leaves is None else leaves.union(found)
        over = sums.where((F.col("depth") == hi) & (F.col("bytes") > limit) & (F.col("rows") > 1)).select(
            F.col("prefix").alias("big")
        )
        if hi == BITS:
            break
        todo = cut(todo.join(over, F.substring("bits", 1, hi) == F.col("big")).drop("at").withColumnRenamed("big", "at"))
        if todo.isEmpty():
            break
    return leaves


def shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, bytes, shard (its prefix), depth, page (0 but in overflow chains)."""
    sized = cut(
        docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")).withColumn(
            "bits", hash_bits("doc_id")
        )
    )
    found = directory(sized, limit)
    # every row meets the leaf among its prefixes of the depths there are
    depths = sorted(r.depth for r in found.select("depth").distinct().collect()) or [0]
    keyed = sized.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths]))).withColumn(
        "shard", F.expr("substring(bits, 1, depth)")
    )
    placed = keyed.join(
        found.select(F.col("prefix").alias("shard"), F.col("depth"), (F.col("bytes") > limit).alias("over")), ["shard", "depth"]
    )
    chain = placed.where(f"over and depth = {BITS}").groupBy("doc_id", "bytes", "shard", "depth").agg(F.count("*").alias("copies"))
    before = W.partitionBy("shard").orderBy("bytes", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    per_page = F.greatest(F.lit(1), F.floor(limit / F.greatest(F.col("bytes"), F.lit(1)))).cast("long")
    pages = F.ceil(F.col("copies") / per_page)
    chain = (
        chain.withColumn("first_page", F.coalesce(F.sum(pages).over(before), F.lit(0)))
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .withColumn("page", (F.col("first_page") + F.floor(F.col("copy") / per_page)).cast("long"))
    )
    columns = ["doc_id", "bytes", "shard", "depth", "page"]
    single = placed.where(f"not (over and depth = {BITS})").withColumn("page", F.lit(0).cast("long"))
    return single.select(columns).union(chain.select(columns))
