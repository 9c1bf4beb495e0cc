"""Mixing sources to target weights (operator 2, DataFrame functions only).

Targets: sources in code point order (null last) weigh 3, 1, 2, repeating, and
share EPOCHS times all sizes; none gets more than MOST times its own size, the
excess goes to the others by weight. Each source gives complete epochs first;
what remains of its target is sampled without replacement after Efraimidis and
Spirakis: every document draws an exponential key with its quality as rate, and
documents are taken in the order of keys up to the budget.

The prefix sums over keys are in two steps. Keys fall into bins of about
BIN_ROWS rows; sums of whole bins give each bin's start, and rows are sorted
within their bin only. So no task holds a whole source, however large. All this
is over narrow columns. As a source's sampled rows are a prefix in the order of
keys, one row per source (its edge) tells which they are, and ``mixed`` picks
the whole rows where they lie, without a shuffle of texts.

Defined cases: null texts have size 0, and rows of size 0 are never taken. A null
source is a source, the last. Draws come from the md5 of id, source, size and the
seed, so reruns agree; equal rows draw equal keys and are told apart only by
their place, one row at most more than the other. The document at the budget's
edge is taken if that comes nearer the target. Very long texts are one document
like others: one may overshoot its source's target by half its size at most.
Extra columns pass through ``mix``; columns that start with ``_m_`` are its own.
An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, words_of

WEIGHTS = (3, 1, 2)
#: Words of the mix as a multiple of all words.
EPOCHS = 1.5
#: No source or document is taken more often than this.
MOST = 2
#: Rows of a bin of keys, about.
BIN_ROWS = 4096
SEED = 20240229
SYMBOLS = "[#*$%&|<>]+"
#: Words of a text that count as half a full length.
SHORT = 10
#: Sources up to which their edges are broadcast instead of joined.
FEW_SOURCES = 100_000


def size_column(text):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def quality_column(text):
    """0.05 to 1, the product of four shares.

    Less for texts with many symbols, with repeated lines, with few different
    words for their length (below twice the root of the number of words), and for very short ones.
    """
    n = F.char_length(text)
    words = words_of(text)
    of = F.transform(F.array(F.struct(F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("d"))), lambda w: (
        F.least(F.lit(1.0), w["d"] / (2.0 * F.sqrt(F.greatest(w["n"], F.lit(1))))) * (w["n"] / (w["n"] + float(SHORT)))
    ))
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    clean = 1.0 - 4.0 * (n - F.char_length(F.regexp_replace(text, SYMBOLS, ""))) / F.greatest(n, F.lit(1))
    single = F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)).cast("double")
    return F.greatest(F.lit(0.05), F.coalesce(F.greatest(F.lit(0.0), clean) * single * F.element_at(of, 1), F.lit(0.0)))


def targets(sized: DataFrame) -> DataFrame:
    """Per source: _m_source, source_size, target. ``sized`` has source and _m_size.

    The windows without partition are over one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("_m_size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), (place + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size").cast("double"))
    every = W.partitionBy()
    filled = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        W.unboundedPreceding, -1
    )
    # sources by cap per weight: once one is not filled up to its cap, none behind it is
    per = (
        per.withColumn("total", F.least(EPOCHS * F.sum("source_size").over(every), F.sum("cap").over(every)))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(filled), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("open"))
        .withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    )
    # behind the first source that is not full, levels only fall
    level = F.max(F.when(~F.col("full"), F.col("level")))
    per = per.withColumn("final", level.over(every))
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight")))
    return per.select(F.col("source").alias("_m_source"), "source_size", target.alias("target"))


def keyed(sized: DataFrame, seed: int = SEED) -> DataFrame:
    """``sized`` with _m_key, the exponential draw with the quality as rate."""
    known = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("source", F.lit("null")), "_m_size", F.lit(seed))
    draw = (F.conv(F.substring(F.md5(known), 1, 13), 16, 10).cast("long") + 1) / float(2**52 + 1)
    return sized.withColumn("_m_key", -F.log(draw) / F.col("_m_quality"))


def mix(sized: DataFrame, seed: int = SEED) -> DataFrame:
    """``sized`` (doc_id, source, _m_size, _m_quality, ...) with _m_key, _m_source_size, _m_target, _m_epochs and _m_copies."""
    rows = sized.count()
    # in logarithms, keys of rates between 0.05 and 1 are spread about alike
    bins = max(64, rows // BIN_ROWS)
    drawn = keyed(sized, seed).withColumn("_m_bin", F.floor(bins * F.log1p("_m_key")).cast("long"))
    goals = targets(sized).withColumnRenamed("_m_source", "_m_goal")
    before = W.partitionBy("source").orderBy("_m_bin").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        drawn.groupBy("source", "_m_bin").agg(F.sum("_m_size").alias("_m_sum"))
        .withColumn("_m_start", F.coalesce(F.sum("_m_sum").over(before), F.lit(0)))
        .join(goals, F.col("source").eqNullSafe(F.col("_m_goal")))
        .select(F.col("source").alias("_m_source"), F.col("_m_bin").alias("_m_at"), "_m_start",
            F.col("source_size").alias("_m_source_size"), F.col("target").alias("_m_target"))
    )
    within = (
        W.partitionBy("source", "_m_bin").orderBy("_m_key", "doc_id", "_m_size").rowsBetween(W.unboundedPreceding, -1)
    )
    size, left = F.col("_m_size"), F.col("_m_rest") - F.col("_m_before")
    return (
        drawn.join(starts, F.col("source").eqNullSafe(F.col("_m_source")) & (F.col("_m_bin") == F.col("_m_at")))
        .withColumn("_m_before", F.col("_m_start") + F.coalesce(F.sum("_m_size").over(within), F.lit(0)))
        .withColumn("_m_epochs", F.when(F.col("_m_source_size") > 0, F.floor(F.col("_m_target") / F.col("_m_source_size"))).otherwise(0).cast("int"))
        .withColumn("_m_rest", F.col("_m_target") - F.col("_m_epochs") * F.col("_m_source_size"))
        .withColumn("_m_copies", F.when(size > 0, F.col("_m_epochs") + (left * 2 >= size).cast("long") * (left > 0).cast("long")).otherwise(0).cast("int"))
        .drop("_m_bin", "_m_source", "_m_at", "_m_start", "_m_before", "_m_rest")
    )


def edges(mixture: DataFrame) -> DataFrame:
    """Per source: _m_source, _m_epochs and the last sampled row in the order of keys (_m_edge), null if none is.

    _m_last: how many rows equal to the edge are sampled; _m_all: whether all of them are.
    """
    extra = F.col("_m_copies") > F.col("_m_epochs")
    groups = mixture.where("_m_size > 0").groupBy("source", "_m_epochs", _place().alias("place")).agg(
        F.count_if(extra).alias("n"), F.count("*").alias("of")
    )
    last = F.max(F.when(F.col("n") > 0, F.struct("place", "n", "of"))).alias("e")
    per = groups.groupBy("source", "_m_epochs").agg(last)
    return per.select(F.col("source").alias("_m_source"), "_m_epochs", F.col("e.place").alias("_m_edge"), F.col("e.n").alias("_m_last"), (F.col("e.n") == F.col("e.of")).alias("_m_all"))


def _place():
    return F.struct("_m_key", "doc_id", "_m_size")


def _first_of_each(rows: DataFrame) -> DataFrame:
    """The first _m_last of ``rows`` of each source, in any order; counted within partitions first."""
    rows = cut(rows.withColumn("_m_row", F.monotonically_increasing_id()))
    part = F.shiftright("_m_row", 33)
    counts = rows.groupBy("source", part.alias("_m_part")).count()
    before = F.sum("count").over(W.partitionBy("source").orderBy("_m_part").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(F.col("source").alias("_m_s"), F.col("_m_part").alias("_m_p"), F.coalesce(before, F.lit(0)).alias("_m_start"))
    placed = rows.withColumn("_m_part", part).withColumn("_m_place", F.row_number().over(W.partitionBy("source", "_m_part").orderBy("_m_row")))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("_m_s")) & (F.col("_m_part") == F.col("_m_p")))
    return placed.where(F.col("_m_start") + F.col("_m_place") <= F.col("_m_last"))


def narrow(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and quality of all rows."""
    text = F.col("text")
    return cut(docs.select("doc_id", "source", size_column(text).alias("_m_size"), quality_column(text).alias("_m_quality")))


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target and taken."""
    return mix(narrow(docs)).select(
        "doc_id",
        F.col("_m_size").alias("size"),
        F.col("_m_source_size").alias("source_size"),
        F.col("_m_target").alias("target"),
        (F.col("_m_copies") * F.col("_m_size")).alias("taken"),
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    found = cut(edges(mix(narrow(docs))))
    few = found.count() <= FEW_SOURCES
    text = F.col("text")
    rows = keyed(docs.withColumns({"_m_size": size_column(text), "_m_quality": quality_column(text)})).where("_m_size > 0")
    rows = rows.join(F.broadcast(found) if few else found, F.col("source").eqNullSafe(F.col("_m_source")))
    here, edge = _place(), F.col("_m_edge")
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    copies = F.col("_m_epochs") + one((here < edge) | (F.col("_m_all") & (here == edge)))
    taken = rows.withColumn("_m_n", copies).where("_m_n > 0").select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_m_n"))).alias("_m_copy"))
    out = taken.select(docs.columns)
    if found.where("not _m_all").isEmpty():
        return out
    # equal rows of which some are sampled
    return out.union(_first_of_each(rows.where(~F.col("_m_all") & (here == edge))).select(docs.columns))
