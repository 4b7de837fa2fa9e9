"""Additive ranking, session cohesion, reciprocal-rank fusion, final order; for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut

#: How near and how weak a hit gains by cohesion, how strong its neighbour must be, how much it gains; and of fusion.
SIGNALS = ("lexical", "vector", "graph", "relation", "seed_support")
COHESION_SEED, COHESION_BELOW, COHESION_REACH, COHESION_MOST = 3.0, 5.0, 12, 1.2
RRF_K, RERANK_K = 60, 50


def backend(text: bool, vectors: bool, graph: bool) -> str:
    """Name of what a query ran on."""
    if not text:
        return "heuristic"
    return {(True, True): "hybrid_graph", (False, True): "lexical_graph", (True, False): "hybrid", (False, False): "lexical"}[vectors, graph]


def combine(records: DataFrame, lexical: DataFrame | None = None, vector: DataFrame | None = None, graph: DataFrame | None = None, allowed: DataFrame | None = None, queries: DataFrame | None = None) -> DataFrame:
    """Hits (query_id, chain_key, index, id, importance, confidence) with all signals and `total`.

    records are the whole chains (the newest index of a chain counts for recency, whatever is filtered); `allowed`
    (chain_key, index, and query_id if it differs by query) are those that may be hits. A query with a text has as hits what
    has a lexical or vector score or is met in the graph: the rows start from these hits and not from the records.
    queries (query_id) have no text: every allowed record is a hit of each of them; they are few and are broadcast.
    """
    key = ["query_id", "chain_key", "index"]
    have = [c for c in ("chain_key", "index", "id", "importance", "confidence") if c in records.columns]
    rows = records.select(*have)
    ids = rows.select("chain_key", "index", "id")
    if queries is not None:
        hits = ids.select("chain_key", "index").crossJoin(F.broadcast(queries.select("query_id")))  # a stated set without texts
    else:
        lists = []
        if lexical is not None:
            lists.append(lexical.where("lexical > 0").select(*key))
        if vector is not None:
            vector = vector.select("query_id", F.col("thought_id").alias("id"), "vector").join(ids, "id")
            lists.append(vector.where("vector > 0").select(*key))
        if graph is not None:
            graph = graph.select("query_id", "chain_key", "id", "graph", "relation", "seed_support").join(ids, ["chain_key", "id"])
            lists.append(graph.select(*key))
        hits = lists[0]
        for more in lists[1:]:
            hits = hits.unionByName(more)
        hits = hits.distinct()
    if allowed is not None:
        hits = hits.join(allowed, [c for c in key if c in allowed.columns], "left_semi")
    rows = hits.join(rows, ["chain_key", "index"])
    for name, signal in (("lexical", lexical), ("vector", vector), ("graph", graph)):
        if signal is not None and queries is None:
            rows = rows.join(signal.select(*key, *[c for c in SIGNALS if c in signal.columns and (c == name or name == "graph")]), key, "left")
    rows = rows.withColumns({s: F.coalesce(s, F.lit(0.0)) if s in rows.columns else F.lit(0.0) for s in SIGNALS})
    newest = records.groupBy("chain_key").agg(F.max("index").alias("newest"))
    return additive(rows.join(newest, "chain_key"))


def additive(rows: DataFrame) -> DataFrame:
    """importance_score, confidence_score, recency and total; recency needs `newest`, the greatest index of the chain."""
    lexical, importance = F.col("lexical"), F.col("importance")
    parts = {
        "importance_score": F.when(lexical > 0, lexical * (importance - 0.5) * 0.3).otherwise((importance - 0.5) * 0.1),
        "confidence_score": F.coalesce("confidence", F.lit(0.0)) * 0.1,
        "recency": F.when(F.col("newest") == 0, 0.05).otherwise(F.col("index") / F.greatest("newest", F.lit(1)) * 0.05),
    }
    boosted = F.col("vector") * (1 + 35 * F.exp(-lexical / 3))
    rows = rows.withColumns(parts)
    return rows.withColumn("total", lexical + boosted + F.col("graph") + F.col("relation") + F.col("seed_support") + sum((F.col(p) for p in parts), F.lit(0.0)))


def cohesion(hits: DataFrame) -> DataFrame:
    """hits with `cohesion`, added to total: weak hits near a strong one of the same query and chain gain.

    Every strong hit names the indexes that it reaches, and hits meet them by equal keys: no range join, and no window over
    the hits of a query.
    """
    key = ["query_id", "chain_key", "index"]
    hits = cut(hits)
    reach = F.explode(F.sequence(F.col("index") - COHESION_REACH, F.col("index") + COHESION_REACH))
    strong = hits.where(F.col("lexical") >= COHESION_SEED).select("query_id", "chain_key", F.col("index").alias("at"), reach.alias("index"))
    nearest = strong.groupBy(*key).agg(F.min(F.abs(F.col("index") - F.col("at"))).alias("d"))
    gain = F.when((F.col("lexical") < COHESION_BELOW) & (F.col("d") > 0), COHESION_MOST * (1 - F.col("d") / COHESION_REACH))
    return hits.join(nearest, key, "left").withColumn("cohesion", F.coalesce(gain, F.lit(0.0))).withColumn("total", F.col("total") + F.col("cohesion")).drop("d")


def rrf(hits: DataFrame, rerank_k: int = RERANK_K) -> DataFrame:
    """hits with `rrf`; hits in one of the three lists get it in place of their lexical and vector parts.

    Lists: lexical, vector, and graph + relation + seed_support, each of the rerank_k best by score, then index. Only the
    heads of lists are ranked; they meet the hits by their keys.
    """
    key = ["query_id", "chain_key", "index"]
    hits = cut(hits)
    structure = F.col("graph") + F.col("relation") + F.col("seed_support")
    heads = None
    for score in (F.col("lexical"), F.col("vector"), structure):
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "index", "chain_key")
        head = hits.select(*key, score.alias("score")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= rerank_k).select(*key, "r")
        heads = head if heads is None else heads.unionByName(head)
    fused = heads.groupBy(*key).agg(F.sum(1.0 / (RRF_K + F.col("r"))).alias("rrf"))
    hits = hits.join(fused, key, "left")
    listed = F.col("rrf").isNotNull()
    total = F.col("rrf") + structure + F.col("importance_score") + F.col("confidence_score") + F.col("recency") + (F.col("cohesion") if "cohesion" in hits.columns else F.lit(0.0))
    return hits.withColumn("total", F.when(listed, total).otherwise(F.col("total"))).withColumn("rrf", F.coalesce("rrf", F.lit(0.0)))


def final_order() -> list[Column]:
    return [F.desc(c) for c in ("total", "lexical", "vector", "graph", "relation", "seed_support", "importance")] + [F.coalesce("confidence", F.lit(0.0)).desc(), F.desc("index"), F.asc("chain_key")]


def best(hits: DataFrame, k: int = 10, offset: int = 0) -> DataFrame:
    """Ranks offset + 1 to offset + k of each query in the final order, with the number of all its hits."""
    if k < 1:
        raise ValueError("limit must be at least 1")
    w = Window.partitionBy("query_id").orderBy(*final_order())
    totals = hits.groupBy("query_id").agg(F.count("*").alias("total_candidates"))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= offset + k).where(F.col("rank") > offset).join(totals, "query_id")
