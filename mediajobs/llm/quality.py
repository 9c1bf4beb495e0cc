"""Quality rules as a short-circuit cascade (operator 9, DataFrame functions only).

Every rule is a condition for rejection over features of one text. On a random
sample of the whole table, executors evaluate every rule on every text and read
a clock between rules: a rule's cost is the median time of a document, and its
selectivity is counted jointly with the other rules'. The order is greedy: next
comes the rule with most rejections per cost among the documents that the rules
before it leave. A document that one rule rejects is not looked at by the rules
behind it (``CASE WHEN`` is lazy). The order changes the work only, never the
verdict: a document is kept exactly if no rule rejects it.

Null and empty texts have no words and fail ``few_words``. Texts of any length
are read whole; all features are linear in the text but for one sort of the
windows of texts that repeat a window. Repeated rows and ties are judged row by
row; extra columns pass through; an empty table gives an empty table. Names
that start with ``_q_`` are used for working columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, words_of

#: Words of a window for repetition.
WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Rows of the sample from which cost and selectivity are estimated, about. It bounds
#: the estimate's cost; the verdicts don't depend on it.
SAMPLE_ROWS = 1000
SEED = 20240229


def _n_chars(text: Column) -> Column:
    return F.char_length(text).cast("long")


def _without(text: Column, chars: str) -> Column:
    """``text`` without the characters of a regular expression's class."""
    return F.regexp_replace(text, f"[{chars}]+", "")


def window_hashes(words: Column) -> Column:
    """64-bit hashes of all windows of WINDOW words, by position; empty for shorter texts."""
    n = F.size(words)
    rest = lambda array, k: F.slice(array, k + 1, F.greatest(n, F.lit(1)))
    both = lambda a, b: F.xxhash64(a, b)
    two = F.zip_with(words, rest(words, 1), both)
    four = lambda h: F.zip_with(h, rest(h, 2), both)
    # a variable for the pairs' hashes, so that they are computed once
    four = F.flatten(F.transform(F.array(two), four))
    five = F.zip_with(four, rest(words, WINDOW - 1), both)
    return F.slice(five, 1, F.greatest(n - (WINDOW - 1), F.lit(0)))


def repeated_words(hashes: Column) -> Column:
    """Words in windows that occur twice or more, the first included.

    ``hashes`` must be a plain column. Equal windows are adjacent once sorted;
    the positions of those with an equal neighbour are sorted again, and each
    covers WINDOW words less what the next one covers. Texts without a repeated
    window, by far the most, stop at the count of distinct hashes.
    """
    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    # sorted arrays enter the lambdas as variables, so that they are computed once
    positions = F.flatten(
        F.transform(
            F.array(F.sort_array(pairs)),
            lambda s: F.flatten(
                F.filter(
                    F.zip_with(
                        s,
                        F.slice(s, 2, F.greatest(F.size(s), F.lit(1))),
                        lambda x, y: F.when(x["h"] == y["h"], F.array(x["p"], y["p"])),
                    ),
                    lambda p: p.isNotNull(),
                )
            ),
        )
    )
    covered = F.flatten(
        F.transform(
            F.array(F.sort_array(F.array_distinct(positions))),
            lambda s: F.transform(
                s, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(s, j + 1) - p, F.lit(WINDOW)))
            ),
        )
    )
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(total)


def working(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the arrays that features read: hashes of words and of windows, lines."""
    t = F.col("_q_text")
    return (
        docs.withColumn("_q_text", F.coalesce(F.col(text), F.lit("")))
        .withColumn("_q_words", F.transform(words_of(t), lambda w: F.xxhash64(w)))
        .withColumn("_q_hashes", window_hashes(F.col("_q_words")))
        .withColumn("_q_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    )


def features() -> dict[str, Column]:
    """The base counts (longs) over the columns of ``working``."""
    t, words, lines = F.col("_q_text"), F.col("_q_words"), F.col("_q_lines")
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": _n_chars(_without(t, "\\x20\\x09-\\x0D")),
        "n_symbols": _n_chars(t) - _n_chars(_without(t, SYMBOLS)),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_q_hashes")),
    }


@dataclass(frozen=True)
class Rule:
    """``reject`` is true for documents to drop."""

    name: str
    reject: Column


def rules(of: dict[str, Column]) -> list[Rule]:
    """Rules over the columns of ``working`` and the base counts ``of`` (expressions, or columns that hold them)."""
    t, words, n = F.col("_q_text"), F.col("_q_words"), of["n_words"]
    bangs = _n_chars(t) - _n_chars(_without(t, "!"))
    distinct = F.size(F.array_distinct(words))
    same = F.filter(
        F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: a == b), lambda x: x
    )
    return [
        Rule("few_words", n < 10),
        Rule("repeated_windows", 100 * of["n_repeat_words"] > 20 * n),
        Rule("symbols", 10 * of["n_symbols"] > n),
        Rule("bangs", 10 * bangs > 3 * n),
        Rule("stutter", 100 * F.size(same) > 20 * n),
        Rule("few_distinct", 100 * distinct < 15 * n),
        Rule("duplicate_lines", 2 * of["n_dup_lines"] > F.size("_q_lines")),
        Rule("long_words", of["word_chars"] > 20 * n),
    ]


def measured(docs: DataFrame, text: str, sample_rows: int) -> tuple[dict[int, int], list[float]]:
    """How many sampled documents have each set of rejecting rules (as bits), and each rule's median nanoseconds.

    Texts stay with the executors; one row for each set of rules comes back.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = docs.select(text).sample(share, SEED)
    clock = F.reflect(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")
    # an array's elements are evaluated in their order, so the clock is read between rules
    steps = [clock]
    for r in rules(features()):
        steps += [F.coalesce(r.reject, F.lit(False)).cast("long"), clock]
    n = len(steps) // 2
    at = lambda i: F.element_at("_q_steps", i + 1)
    seen = cut(
        working(sample, text).select(F.array(*steps).alias("_q_steps"))
        .select(
            sum((at(2 * i + 1) * (1 << i) for i in range(n)), F.lit(0).cast("long")).alias("sets"),
            *[(at(2 * i + 2) - at(2 * i)).alias(f"t{i}") for i in range(n)],
        )
    )
    sets = {r.sets: r["count"] for r in seen.groupBy("sets").count().collect()}
    times = seen.agg(*[F.median(f"t{i}") for i in range(n)]).first()
    return sets, [float(t or 1.0) for t in times]


def greedy(sets: dict[int, int], costs: list[float]) -> list[int]:
    """Rules by most rejections per cost among what the rules before them leave; ties to the cheaper, then the first."""
    order, left, sets = [], list(range(len(costs))), dict(sets)
    while left:
        rejected = {i: sum(n for s, n in sets.items() if s >> i & 1) for i in left}
        best = min(left, key=lambda i: (-rejected[i] / max(costs[i], 1.0), costs[i], i))
        order.append(best)
        left.remove(best)
        sets = {s: n for s, n in sets.items() if not s >> best & 1}
    return order


def ordered(found: list[Rule], docs: DataFrame, text: str, sample_rows: int) -> list[Rule]:
    """``found`` in the order of the cascade."""
    return [found[i] for i in greedy(*measured(docs, text, sample_rows))]


def verdict(order: list[Rule]) -> Column:
    """Name of the first rule that rejects the document, null if it is kept."""
    out = F
    for r in order:
        out = out.when(r.reject, F.lit(r.name))
    return out.otherwise(F.lit(None).cast("string"))


def _visible(df: DataFrame) -> DataFrame:
    return df.drop("_q_text", "_q_words", "_q_hashes", "_q_lines")


def apply_rules(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``rejected_by`` (null: kept)."""
    order = ordered(rules(features()), docs, text, sample_rows)
    return _visible(working(docs, text).withColumn("rejected_by", verdict(order)))


def keep_good(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with the columns of ``docs``."""
    order = ordered(rules(features()), docs, text, sample_rows)
    # a filter would be pushed below the arrays and compute them anew for every rule; a generator isn't
    kept = F.explode(F.when(verdict(order).isNull(), F.array(F.lit(True))))
    return _visible(working(docs, text).withColumn("_q_kept", kept).drop("_q_kept"))


def digest(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document: the base counts, base_failed and kept. As all counts are returned, the rules read them."""
    of = features()
    order = ordered(rules({k: F.col(k) for k in of}), docs, text, sample_rows)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        working(docs.select("doc_id", text), text)
        .withColumns(of)
        .withColumn("base_failed", failed)
        .select("doc_id", *of, "base_failed", (~failed & verdict(order).isNull()).alias("kept"))
    )
