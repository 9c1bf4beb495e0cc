"""Routing of parse requests to providers, and what became of the attempts.

``requests``: request_id, privacy, needs array<string>, preferred_provider.
``providers``: a small dimension table (name, ordinal, location, priority,
capabilities, ...), joined by broadcast; ``available`` may narrow it per request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import cut
from ..functions.sizes import TASK_ROWS, small, spread, tasks_of

#: Needs that a capability of another name also satisfies (fixed values).
ALIASES = {"figures": "figure", "tables": "table"}


def satisfies_capabilities(needs: Column, capabilities: Column) -> Column:
    """Every need, or its alias, is among the capabilities, whatever the case; no needs are always satisfied."""
    have = F.transform(F.coalesce(capabilities, F.array().cast("array<string>")), F.lower)
    alias = lambda n: F.coalesce(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])[n], n)
    return F.forall(
        F.coalesce(needs, F.array().cast("array<string>")),
        lambda n: F.array_contains(have, F.lower(n)) | F.array_contains(have, alias(F.lower(n))),
    )


#: What every provider has, and every request needs; and what providers have that private requests may use. No need or capability holds a NUL.
ANY, NEAR = "\0any", "\0near"


def needs_of(privacy: Column | None, needs: Column) -> Column:
    """What a request needs, in lower case, each once and in order, with ANY, and NEAR if it is private."""
    listed = F.transform(F.coalesce(needs, F.array().cast("array<string>")), F.lower)
    marks = F.array(F.lit(ANY))
    if privacy is not None:
        marks = F.when(F.coalesce(privacy, F.lit("private")) == "private", F.array(F.lit(ANY), F.lit(NEAR))).otherwise(marks)
    return F.array_sort(F.array_distinct(F.concat(listed, marks)))


def capabilities_of(location: Column, capabilities: Column) -> Column:
    """What a provider has, in lower case, with ANY, and NEAR unless it is remote (or nowhere)."""
    have = F.transform(F.coalesce(capabilities, F.array().cast("array<string>")), F.lower)
    return F.concat(have, F.array(F.lit(ANY)), F.when(location != "remote", F.array(F.lit(NEAR))).otherwise(F.array().cast("array<string>")))


def solved(signatures: DataFrame, providers: DataFrame) -> DataFrame:
    """signature, provider of those that have everything that a signature (needs_of) holds; an equi-join on single needs."""
    alias = lambda n: F.coalesce(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])[n], n)
    asked = signatures.select("signature", F.explode("signature").alias("need"))
    asked = asked.select("signature", "need", F.explode(F.array_distinct(F.array("need", alias(F.col("need"))))).alias("has"))
    have = providers.select(F.col("name").alias("provider"), F.explode(F.array_distinct(capabilities_of(F.col("location"), F.col("capabilities")))).alias("has"))
    met = asked.join(have, "has").groupBy("signature", "provider").agg(F.collect_set("need").alias("met"))
    return met.where(F.size("met") == F.size("signature")).select("signature", "provider")


def route_candidates(requests: DataFrame, providers: DataFrame, availability: DataFrame | None = None) -> DataFrame:
    """One row per request and provider that may serve it.

    Requests of one signature (what they need, and whether they are private) have the
    same providers, so these are found once for each signature.
    ``availability`` (request_id, provider, available): missing rows count as unavailable.
    """
    signed = requests.withColumn("_signature", needs_of(F.col("privacy"), F.col("needs")))
    open_ = providers.where("enabled")
    found = solved(signed.select(F.col("_signature").alias("signature")).distinct(), open_)
    # from a checkpoint: it is counted, and each use would look through all requests again
    rows = cut(found.join(small(open_.withColumnRenamed("name", "provider")), "provider"))
    out = signed.join(small(rows), F.col("_signature") == F.col("signature")).select(*requests.columns, "provider", *[c for c in providers.columns if c != "name"])
    if availability is not None:
        out = out.join(availability.where("available").select("request_id", "provider"), ["request_id", "provider"], "left_semi")
    return out


def capability_table(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """request_id, name, fits of every request and provider: whether the provider has what the request needs, wherever it is."""
    signed = requests.select("request_id", needs_of(None, F.col("needs")).alias("signature"))
    signatures = signed.select("signature").distinct()
    fitting = solved(signatures, providers).groupBy("signature").agg(F.collect_set("provider").alias("fitting"))
    # the providers' names travel as one array, those that fit as another for each signature
    names = providers.agg(F.collect_set("name").alias("names"))
    known = signatures.join(fitting, "signature", "left").crossJoin(F.broadcast(names))  # one row
    listed = known.select("signature", F.explode("names").alias("name"), "fitting").select("signature", "name", F.coalesce(F.array_contains("fitting", F.col("name")), F.lit(False)).alias("fits"))
    return signed.join(small(listed), "signature").select("request_id", "name", "fits")


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """``candidates`` with rank: the preferred provider first, then by priority, ties in registry order."""
    preferred = F.coalesce(F.col("provider") == F.col("preferred_provider"), F.lit(False))
    order = W.partitionBy("request_id").orderBy(preferred.desc(), F.desc("priority"), F.asc("ordinal"))
    return spread(candidates, tasks_of(candidates), "request_id").withColumn("rank", F.row_number().over(order))


def resolve_fallback(ranked: DataFrame, attempts: DataFrame) -> DataFrame:
    """Per request that some candidate served: provider_name, status, latency_ms, attempted_providers, fallback_reason.

    ``attempts``: request_id, provider, success, error, latency_ms.
    """
    tried = ranked.select("request_id", "provider", "rank").join(attempts, ["request_id", "provider"])
    w = W.partitionBy("request_id").orderBy("rank")
    tried = tried.withColumn("before", F.lag("error").over(w)).withColumn(
        "first", F.min(F.when(F.col("success"), F.col("rank"))).over(W.partitionBy("request_id"))
    )
    names = F.transform(F.sort_array(F.collect_list(F.struct("rank", "provider"))), lambda x: x["provider"])
    won = F.col("rank") == F.col("first")
    return (
        tried.where("rank <= first").groupBy("request_id").agg(
            F.max(F.when(won, F.col("provider"))).alias("provider_name"),
            F.when(F.max("rank") == F.min("rank"), "success").otherwise("fallback").alias("status"),
            F.max(F.when(won, F.col("latency_ms"))).alias("latency_ms"),
            names.alias("attempted_providers"),
            F.max(F.when(won, F.col("before"))).alias("fallback_reason"),
        )
    )


def routing_failures(requests: DataFrame, ranked: DataFrame, attempts: DataFrame) -> DataFrame:
    """request_id, code, attempted_providers, last_error: 503 without candidates, 502 if all candidates failed."""
    n = tasks_of(requests, TASK_ROWS // 4)  # each has some candidates
    asked, had = spread(requests.select("request_id"), n, "request_id"), spread(ranked.select("request_id"), n, "request_id")
    none = asked.join(had, "request_id", "left_anti").select(
        "request_id", F.lit(503).alias("code"), F.array().cast("array<string>").alias("attempted_providers"), F.lit(None).cast("string").alias("last_error")
    )
    key = ["request_id", "provider"]
    tried = spread(ranked.select(*key, "rank"), n, *key).join(spread(attempts.select(*key, "success", "error"), n, *key), key, "left")
    names = F.transform(F.sort_array(F.collect_list(F.struct("rank", "provider"))), lambda x: x["provider"])
    failed = spread(tried, n, "request_id").groupBy("request_id").agg(
        F.lit(502).alias("code"), names.alias("attempted_providers"), F.max_by("error", "rank").alias("last_error"),
        F.count_if(F.coalesce("success", F.lit(False))).alias("n"),
    ).where("n = 0").drop("n")
    return none.union(failed)
