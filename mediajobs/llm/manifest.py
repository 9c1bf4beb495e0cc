"""Merkle manifest of a dataset, with a proof for every row (operator 12).

A leaf is H (lowercase hex SHA-256) of a row's fields. Within each lang, leaves
ascend by id; every two consecutive nodes become H of both, a last single one H
of itself, until one remains, the lang's subroot. Subroots, in the order of langs
(null first), likewise give the root.

1. Places. Leaves are sorted over ranges of (lang, id); a row's index in its lang
   is the sum of the ranges before it and its place in its own.
2. Levels. Each group of 2**SPAN consecutive nodes is hashed up SPAN levels at
   once, in one array, so levels are built by one aggregation for every SPAN of
   them. What is stored (as Parquet) are node rows: a row links a node with its
   ancestor SPAN levels up, its parent here, and holds the siblings on the way.
   A node above more than REACH leaves is stored once for each REACH of them, so
   no key of the climb is hot.
3. Climb. A recursive query of Spark ascends from every leaf to the root by these
   links. It appends the siblings to the leaf's proof and folds the (tampered)
   leaf with them; each step joins with the node rows of one more span.

Defined cases: a null field is ``-``; an empty text is ``0:``, so the two differ.
Null ids come first in their lang. Repeated ids are leaves of their own, ordered
by their leaf. Equal rows are equal leaves, next to each other: each has the proof
of its place, in any order. A row alone in its lang is the subroot, a lang alone
the root; a proof without siblings is H of nothing. Very long texts are hashed
whole. Other columns, of any name, aren't part of a leaf. An empty table has no
root, and no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sizes import small
from .common import cut, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that a node row spans.
SPAN = 10
#: Leaves that share a node row at most, above the first span; a power of two.
REACH = 1 << 16


def hashed(fields: dict[str, Column]) -> Column:
    """H of the fields: each its UTF-8 byte count, ``:`` and value; null is ``-``."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[one(c.cast("string")) for c in fields.values()]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf and tampered: the leaf after tampering, null where that changes nothing.

    Tampering adds 1 to n_chars where 7 divides the crc32 of the id.
    """
    fields = {c: F.col(c) for c in FIELDS}
    touched = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    tampered = F.when(touched, hashed(fields | {"n_chars": F.col("n_chars") + 1}))
    return docs.select("doc_id", "lang", hashed(fields).alias("leaf"), tampered.alias("tampered"))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (g, ...) with i, the place within g (from 0) in the order of ``order``, and n, the rows of g."""
    keys = ["g", *order]
    ranges = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    parts = ranges.groupBy("g", part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    group = W.partitionBy("g")
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("g", "_part", "_first", before.alias("_start"), F.sum("_n").over(group).alias("n"))
    # few rows, unless groups are very many; then a key is no larger than a range
    joined = ranges.withColumn("_part", part).join(small(cut(starts)), ["g", "_part"])
    return joined.withColumn("i", F.col("_start") + F.col("_at") - F.col("_first")).drop("_part", "_first", "_start", "_at")


def _spans(nodes: DataFrame, payload: list[str], span: int) -> DataFrame:
    """One row for each group of 2**span nodes (g, i, n, hash, payload): g, n of the level above, i, hash and members with their siblings on the way."""
    height = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
    rows = nodes.withColumn("up", F.least(F.lit(span), height)).withColumn("above", F.expr("shiftright(i, up)"))
    groups = rows.groupBy("g", "n", "up", "above").agg(F.sort_array(F.collect_list(F.struct("i", "hash", *payload))).alias("m"))
    # levels[l] holds the hashes l levels up
    pair = "sha2(concat(get(e, 2 * j), coalesce(get(e, 2 * j + 1), '')), 256)"
    level = f"element_at(transform(array(element_at(acc, -1)), e -> transform(sequence(0, shiftright(size(e) - 1, 1)), j -> {pair})), 1)"
    steps = f"filter(sequence(1, {span}), l -> l <= up)"
    groups = groups.withColumn("levels", F.expr(f"aggregate({steps}, array(transform(m, x -> x.hash)), (acc, l) -> concat(acc, array({level})))"))
    sibling = "get(get(levels, l), shiftright(k, l) ^ 1)"
    # the siblings' bytes, and for each level whether one is to the left, right or missing
    path = f"transform(filter(sequence(0, {span - 1}), l -> l < up), l -> {sibling})"
    sides = f"array_join(transform(filter(sequence(0, {span - 1}), l -> l < up), l -> CASE WHEN {sibling} IS NULL THEN '-' WHEN shiftright(k, l) & 1 = 1 THEN 'l' ELSE 'r' END), '')"
    kept = "".join(f", '{c}', x.{c}" for c in payload)
    members = f"transform(m, (x, k) -> named_struct('i', x.i, 'hash', x.hash, 'siblings', unhex(array_join({path}, '')), 'sides', {sides}{kept}))"
    top = F.get(F.element_at("levels", -1), F.lit(0))
    return groups.select("g", F.expr("shiftright(n - 1, up) + 1").alias("n"), F.col("above").alias("i"), top.alias("hash"), F.expr(members).alias("members"))


def tree(nodes: DataFrame, payload: list[str], span: int) -> tuple[list[DataFrame], DataFrame]:
    """The node rows of each span of levels, and the top of each g.

    ``nodes``: g, i, n, hash, payload. A node row: g, i, siblings, sides, above (the
    ancestor's hash), last (whether that is the top); the first span keeps the payload.
    Tops: g, hash, spans (how many spans of levels g has).
    """
    stored, tops = [], []
    while True:
        up = written(_spans(nodes, payload, span), "manifest-levels")
        rows = up.select("g", F.col("hash").alias("above"), (F.col("n") == 1).alias("last"), F.inline("members"))
        stored.append(rows)
        tops.append(up.where("n = 1").select("g", "hash", F.lit(len(stored)).alias("spans")))
        nodes, payload = up.where("n > 1").select("g", "i", "n", "hash"), []
        if nodes.isEmpty():
            break
    every = tops[0]
    for t in tops[1:]:
        every = every.union(t)
    return stored, every


def _shift(spans: Column | int, span: int) -> Column:
    """Bits of a leaf's index that don't matter to its node row after ``spans`` spans."""
    return F.least(F.lit(REACH.bit_length() - 1), (F.lit(spans) if isinstance(spans, int) else spans) * span)


def _node(spans: Column, block: Column) -> Column:
    """Name of a node row: spans below it, block of leaves, and g."""
    return F.concat_ws(":", spans.cast("string"), block.cast("string"), "g")


def manifest(docs: DataFrame, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """The stored manifest: leaf rows and the node rows above them.

    Leaf rows: doc_id, leaf, tampered, siblings, sides, above, last, parent.
    Node rows: node, siblings, sides, above, last (above is the subroot), parent (null: above is the root).
    """
    g = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    rows = cut(leaves(docs).select(g.alias("g"), "doc_id", F.col("leaf").alias("hash"), "tampered").withColumn("row", F.monotonically_increasing_id()))
    of_langs, subroots = tree(placed(rows, ["doc_id", "hash", "row"]), ["doc_id", "tampered"], span)
    subroots = cut(subroots)
    ranks = placed(subroots.select(F.lit("").alias("g"), F.col("g").alias("lang"), "hash"), ["lang"])
    of_root, _ = tree(ranks, ["lang"], span)

    parent = _node(F.lit(1), F.expr(f"shiftright(i, {min(span, REACH.bit_length() - 1)})"))
    first = written(of_langs[0].select("doc_id", F.col("hash").alias("leaf"), "tampered", "siblings", "sides", "above", "last", parent.alias("parent"), "g", "i"), "manifest-leaves")
    sizes = cut(first.groupBy("g").agg(F.count("*").alias("leaves")))
    kept = ["siblings", "sides", "above", "last"]
    stored = []
    for s, nodes in enumerate(of_langs[1:], 1):
        # the blocks of leaves below node i of this span
        shift, bits = _shift(s, span), span * s
        low, high = F.shiftleft("i", bits), F.least(F.shiftleft(F.col("i") + 1, bits), F.col("leaves")) - 1
        blocks = nodes.join(small(sizes), "g").withColumn("shift", shift).withColumn("s", F.lit(s)).withColumn("low", low).withColumn("high", high)
        stored.append(blocks.withColumn("ends", F.lit(False)).select("g", "s", "low", "high", "shift", "ends", *kept))
    langs = ranks.select("lang", F.col("i").alias("rank")).join(subroots.select(F.col("g").alias("lang"), "spans"), "lang").join(sizes.withColumnRenamed("g", "lang"), "lang")
    for t, nodes in enumerate(of_root):
        # the way from subroots to the root belongs to each lang's climb
        s = F.col("spans") + t
        way = nodes.select("i", "siblings", "sides", "above", F.col("last").alias("ends"), F.lit(False).alias("last"))
        blocks = langs.withColumn("i", F.shiftright("rank", span * t)).join(small(way), "i")
        stored.append(blocks.select(F.col("lang").alias("g"), s.alias("s"), F.lit(0).cast("long").alias("low"), (F.col("leaves") - 1).alias("high"), _shift(s, span).alias("shift"), "ends", *kept))
    every = stored[0]
    for x in stored[1:]:
        every = every.union(x)
    blocks = every.withColumn("block", F.explode(F.expr("sequence(shiftright(low, shift), shiftright(high, shift))")))
    further = F.expr(f"shiftright(block, least({REACH.bit_length() - 1}, (s + 1) * {span}) - shift)")
    nodes = blocks.select(_node(F.col("s"), F.col("block")).alias("node"), *kept, F.when(~F.col("ends"), _node(F.col("s") + 1, further)).alias("parent"))
    return first.drop("g", "i"), written(nodes, "manifest-nodes")


#: A way's siblings as hex text, folded into the hash so far.
_FOLD = """aggregate(sequence(1, length({way}.sides)), {start}, (h, l) -> CASE substr({way}.sides, l, 1)
  WHEN 'l' THEN sha2(concat({sibling}, h), 256) WHEN 'r' THEN sha2(concat(h, {sibling}), 256) ELSE sha2(h, 256) END)"""
_SIBLING = "lower(hex(substr({way}.siblings, 32 * (length(replace(substr({way}.sides, 1, l), '-', '')) - 1) + 1, 32)))"


def _folded(way: str, start: str) -> str:
    fold = _FOLD.format(way=way, start=start, sibling=_SIBLING.format(way=way))
    return f"CASE WHEN {way}.sides = '' THEN {start} ELSE {fold} END"


def climbed(leaf_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (the siblings' bytes) and folded_root of every leaf row."""
    spark = leaf_rows.sparkSession
    before = spark.conf.get("spark.sql.cteRecursionRowLimit", None)
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    try:
        return cut(spark.sql(
            f"""WITH RECURSIVE climb AS (
              SELECT doc_id, leaf, parent, siblings AS proof, {_folded("b", "coalesce(b.tampered, b.leaf)")} AS folded,
                     CASE WHEN last THEN above END AS subroot, above
              FROM {{leaf_rows}} b
              UNION ALL
              SELECT c.doc_id, c.leaf, n.parent, concat(c.proof, n.siblings), {_folded("n", "c.folded")},
                     CASE WHEN n.last THEN n.above ELSE c.subroot END, n.above
              FROM climb c JOIN {{node_rows}} n ON c.parent = n.node
            )
            SELECT doc_id, leaf, subroot, above AS root, proof, folded AS folded_root FROM climb WHERE parent IS NULL""",
            leaf_rows=leaf_rows, node_rows=small(node_rows),
        ))
    finally:
        if before is None:
            spark.conf.unset("spark.sql.cteRecursionRowLimit")
        else:
            spark.conf.set("spark.sql.cteRecursionRowLimit", before)


def verified(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified (whether the tampered row still gives the root) of every row."""
    found = climbed(*manifest(docs, span))
    proof = F.sha2(F.lower(F.hex("proof")), 256)
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
