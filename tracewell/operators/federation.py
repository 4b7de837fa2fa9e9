"""Several chains at once: merging ranked results, ancestors, mapping agents, catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import lexical, ranking
from .storage import cut, numbered


def dedupe(hits: DataFrame, first_chain_wins: bool = False) -> DataFrame:
    """One hit for each id of a query: the higher total, of equals the earlier chain; or simply the earlier chain (chain_pos)."""
    order = ["chain_pos", F.desc("total"), "index"] if first_chain_wins else [F.desc("total"), "chain_pos", "index"]
    w = Window.partitionBy("query_id", "id").orderBy(*order)
    return hits.withColumn("r", F.row_number().over(w)).where(F.col("r") == 1).drop("r")


def federated(hits: DataFrame, k: int = 10, offset: int = 0, first_chain_wins: bool = False) -> DataFrame:
    """Hits of chains (query_id, chain_key, chain_pos, id, index, total) merged: total descending, then index, then id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("total"), "index", "id")
    return dedupe(hits, first_chain_wins).withColumn("rank", F.row_number().over(w)).where((F.col("rank") > offset) & (F.col("rank") <= offset + k))


def federated_rrf(hits: DataFrame, k: int = 60) -> DataFrame:
    """Sum over chains of 1 / (k + rank in the chain) for each id: chains hold different records with equal indexes, so ids are the key."""
    w = Window.partitionBy("query_id", "chain_key").orderBy(F.desc("total"), "index")
    return hits.withColumn("r", F.row_number().over(w)).groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("r"))).alias("rrf"))


def ancestors(records: DataFrame) -> DataFrame:
    """chain_key, ancestor, distance: chains reached over BranchesFrom relations of genesis records; a cycle ends where it closes.

    Distances double: what is up to 2 * step away is up to step away from something that is exactly step from its ancestor.
    """
    first = records.where(F.col("index") == 0).select("chain_key", F.explode("relations").alias("r"))
    parents = first.where((F.col("r.kind") == "BranchesFrom") & F.col("r.chain_key").isNotNull()).select("chain_key", F.col("r.chain_key").alias("ancestor")).distinct()
    seen, step = cut(parents.where("chain_key <> ancestor").withColumn("distance", F.lit(1))), 1
    while True:
        far = seen.where(F.col("distance") == step).select(F.col("chain_key").alias("ancestor"), F.col("ancestor").alias("far"))
        up = seen.join(far, "ancestor").where("chain_key <> far").groupBy("chain_key", F.col("far").alias("ancestor")).agg((F.min("distance") + step).alias("distance"))
        found = cut(up.join(seen, ["chain_key", "ancestor"], "left_anti"))
        if not found.take(1):
            return seen
        seen, step = cut(seen.unionByName(found)), 2 * step


def ranked_over_ancestors(queries: DataFrame, records: DataFrame, lineage: DataFrame, k: int = 10, offset: int = 0, **how) -> DataFrame:
    """Ranked search over each query's chain and all its ancestors: query_id, chain_key, id, index, total, rank.

    queries: query_id, text, chain_key; lineage: as of ancestors(). Every chain is searched by itself (its own statistics
    and newest index), its offset + k best hits are merged, of equal ids that of the nearest chain stays; total descending.
    how: as of bm25.
    """
    own = queries.select("query_id", "chain_key", F.lit(0).alias("chain_pos"))
    up = queries.select("query_id", "chain_key").join(lineage, "chain_key").select("query_id", F.col("ancestor").alias("chain_key"), F.col("distance").alias("chain_pos"))
    asked = cut(own.unionByName(up))
    there = records.join(asked.select("chain_key").distinct(), "chain_key", "left_semi")
    hits = cut(lexical.bm25(queries.select("query_id", "text"), there, **how).join(asked.select("query_id", "chain_key"), ["query_id", "chain_key"], "left_semi"))
    rows = ranking.combine(there, hits)
    per_chain = Window.partitionBy("query_id", "chain_key").orderBy(*ranking.final_order())
    rows = rows.withColumn("place", F.row_number().over(per_chain)).where(F.col("place") <= offset + k)
    return federated(rows.join(asked, ["query_id", "chain_key"]), k, offset, first_chain_wins=True).select("query_id", "chain_key", "id", "index", "total", "rank")


def branch(parent_chain: str, parent_id: str, new_chain: str, agent: str, spark) -> DataFrame:
    """The genesis record of a branch: a StateSnapshot that names where it left; history is not copied."""
    return spark.createDataFrame([(new_chain, 0, agent, "StateSnapshot", f"Branch of {parent_chain}", [("BranchesFrom", parent_id, parent_chain, None, None)])], "chain_key string, index bigint, agent_id string, thought_type string, content string, relations array<struct<kind:string,target_id:string,chain_key:string,valid_at:timestamp,invalid_at:timestamp>>")


def map_agents(source: DataFrame, target: DataFrame) -> DataFrame:
    """source_agent, target_agent, similarity: the same id if the target has it, else the one whose id shares most of its characters; then more records, then the greater id.

    source, target: agent_id, n. Agents are few; ids meet on shared characters, not all with all.
    """
    letters = lambda df, p: df.select(F.col("agent_id").alias(f"{p}_agent"), F.col("n").alias(f"{p}_n"), F.array_distinct(F.split("agent_id", "")).alias(f"{p}_c"))
    s, t = letters(source, "source"), letters(target, "target")
    both = s.withColumn("c", F.explode("source_c")).join(t.withColumn("c", F.explode("target_c")), "c").groupBy("source_agent", "target_agent").agg(F.count("*").alias("common"), F.first(F.size("source_c")).alias("a"), F.first(F.size("target_c")).alias("b"), F.first("target_n").alias("target_n"))
    none = s.join(both.select("source_agent").distinct(), "source_agent", "left_anti").select("source_agent")
    scored = both.select("source_agent", "target_agent", "target_n", (F.col("common") / (F.col("a") + F.col("b") - F.col("common"))).alias("similarity"))
    if none.take(1):
        top = target.orderBy(F.desc("n"), F.desc("agent_id")).limit(1).select(F.col("agent_id").alias("target_agent"), F.col("n").alias("target_n"), F.lit(0.0).alias("similarity"))
        scored = scored.unionByName(none.crossJoin(F.broadcast(top)).select("source_agent", "target_agent", "target_n", "similarity"))  # one row on the right
    w = Window.partitionBy("source_agent").orderBy((F.col("source_agent") == F.col("target_agent")).desc(), F.desc("similarity"), F.desc("target_n"), F.desc("target_agent"))
    return scored.withColumn("r", F.row_number().over(w)).where("r = 1").select("source_agent", "target_agent", "similarity")


def merge_chain(source: DataFrame, mapping: DataFrame, target_chain: str, next_index: int) -> DataFrame:
    """Records of a chain re-appended to another: agents mapped, refs and relations dropped, indexes after next_index - 1."""
    moved = source.join(mapping.select(F.col("source_agent").alias("agent_id"), "target_agent"), "agent_id").withColumnRenamed("index", "old_index")
    moved = numbered(moved, ["chain_key"], ["old_index"], "index").withColumn("index", F.col("index") + next_index).drop("old_index")
    dropped = {c: F.expr(f"slice({c}, 1, 0)") for c in ("refs", "relations") if c in source.columns}
    return moved.withColumns({"agent_id": F.col("target_agent"), "chain_key": F.lit(target_chain), **dropped}).drop("target_agent")


def catalog(records: DataFrame) -> DataFrame:
    """chain_key, n, agents, head_id: the list of chains."""
    return records.groupBy("chain_key").agg(F.count("*").alias("n"), F.count_distinct("agent_id").alias("agents"), F.max_by("id", "index").alias("head_id"))
