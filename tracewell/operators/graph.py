"""Graph of references and relations: adjacency, budgeted breadth-first expansion, scores, context bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut

#: Boost of each relation kind; plain references have none.
BOOSTS = {
    "ContinuesFrom": 0.60, "BranchesFrom": 0.55, "Corrects": 0.50, "Invalidates": 0.50, "Supersedes": 0.45, "DerivedFrom": 0.40,
    "Summarizes": 0.20, "CausedBy": 0.20, "Supports": 0.15, "Contradicts": 0.15, "RelatedTo": 0.08, "References": 0.06,
}
MAX_DEPTH, MAX_VISITED = 2, 128


def adjacency(records: DataFrame) -> DataFrame:
    """chain_key, src, dst, dst_chain, kinds, by_ref, provenances: one row per pair of nodes, what links them merged.

    Refs to missing records are dropped; relations to missing ones stay; a relation with the key of another chain leads to
    a remote node of that chain (dst_chain; null: the own one). provenances are the distinct sources of the edge, refs first, then
    relations by kind and validity.
    """
    ids = records.select("chain_key", F.col("id").alias("dst"), F.col("index").alias("ref"))
    none, never = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    source = lambda way, ref, kind, since, until: F.struct(F.lit(way).alias("way"), ref.alias("ref"), kind.alias("kind"), since.alias("valid_at"), until.alias("invalid_at"))
    refs = records.select("chain_key", F.col("id").alias("src"), F.explode("refs").alias("ref")).join(ids, ["chain_key", "ref"]).select("chain_key", "src", "dst", none.alias("dst_chain"), source(0, F.col("ref"), none, never, never).alias("p"))
    rel = records.select("chain_key", F.col("id").alias("src"), F.explode("relations").alias("r"))
    away = F.when(F.col("r.chain_key") != F.col("chain_key"), F.col("r.chain_key"))
    rel = rel.select("chain_key", "src", F.col("r.target_id").alias("dst"), away.alias("dst_chain"), source(1, F.lit(None).cast("bigint"), F.col("r.kind"), F.col("r.valid_at"), F.col("r.invalid_at")).alias("p"))
    merged = refs.unionByName(rel).groupBy("chain_key", "src", "dst", "dst_chain").agg(F.sort_array(F.collect_set("p")).alias("provenances"))
    kinds = F.array_distinct(F.transform(F.filter("provenances", lambda p: p["way"] == 1), lambda p: p["kind"]))
    return merged.select("chain_key", "src", "dst", "dst_chain", F.sort_array(F.array_compact(kinds)).alias("kinds"), F.exists("provenances", lambda p: p["way"] == 0).alias("by_ref"), "provenances")


def directed(edges: DataFrame, direction: str = "both") -> DataFrame:
    """chain_key, node, node_chain, next, next_chain, dir (0 out, 1 in), kinds. Chains are those of remote nodes, empty for own ones."""
    away = F.coalesce("dst_chain", F.lit("")).alias("x") if "dst_chain" in edges.columns else F.lit("").alias("x")
    e = edges.select("chain_key", "src", "dst", "kinds", away)
    out = e.select("chain_key", F.col("src").alias("node"), F.lit("").alias("node_chain"), F.col("dst").alias("next"), F.col("x").alias("next_chain"), F.lit(0).alias("dir"), "kinds")
    back = e.select("chain_key", F.col("dst").alias("node"), F.col("x").alias("node_chain"), F.col("src").alias("next"), F.lit("").alias("next_chain"), F.lit(1).alias("dir"), "kinds")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def neighbours(edges: DataFrame, direction: str = "both") -> DataFrame:
    """chain_key, node, neighbours: for each node the sorted nodes next to it, as (chain of a remote one or empty, id, direction)."""
    return directed(edges, direction).groupBy("chain_key", "node_chain", "node").agg(F.sort_array(F.collect_set(F.struct("next_chain", F.col("next").alias("id"), F.when(F.col("dir") == 0, "out").otherwise("in").alias("direction")))).alias("neighbours"))


def expand(seeds: DataFrame, edges: DataFrame, max_depth: int = MAX_DEPTH, max_visited: int = MAX_VISITED, direction: str = "both", include_seeds: bool = False) -> DataFrame:
    """query_id, chain_key, seed, node, depth, path, hops, kinds, truncated: breadth first from each seed by itself.

    Nodes are found in the order of first-in-first-out: by parent, outgoing before incoming, then chain and id. Each is found
    once, so no path has a cycle. A seed that has found max_visited nodes, itself included, stops for good and is marked
    truncated. Remote nodes count as found and are passed through, but are not among the rows. hops gives the direction, the
    kinds of relation and the node reached for each step of the path.
    """
    arcs = directed(edges, direction)
    key = ["query_id", "chain_key", "seed"]
    hop = "array<struct<direction:string,kinds:array<string>,node_chain:string,node:string>>"
    start = seeds.select("query_id", "chain_key", F.col("id").alias("seed"), F.col("id").alias("node"), F.lit("").alias("node_chain"), F.lit(0).alias("depth"), F.lit(1).cast("bigint").alias("ord"), F.array("id").alias("path"), F.array().cast(hop).alias("hops"), F.array().cast("array<string>").alias("kinds"), F.lit(False).alias("cut"))
    seen = frontier = cut(start)
    over = start.where("false").select(*key)
    for depth in range(1, max_depth + 1):
        met = frontier.where("not cut").select(*key, "node", "node_chain", "ord", "path", "hops").join(arcs, ["chain_key", "node", "node_chain"])
        first = Window.partitionBy(*key, "next", "next_chain").orderBy("ord", "dir")
        met = met.withColumn("r", F.row_number().over(first)).where("r = 1").select(*key, F.col("next").alias("node"), F.col("next_chain").alias("node_chain"), "ord", "dir", "path", "hops", "kinds")
        new = met.join(seen.select(*key, "node", "node_chain"), [*key, "node", "node_chain"], "left_anti")
        had = seen.groupBy(*key).agg(F.count("*").alias("had"), F.max("cut").alias("stopped"))
        order = Window.partitionBy(*key).orderBy("ord", "dir", "node_chain", "node")
        new = new.withColumn("place", F.row_number().over(order)).withColumn("many", F.count("*").over(Window.partitionBy(*key))).join(had, key).where("not stopped")
        new = cut(new)
        over = over.unionByName(new.where(F.col("had") + F.col("many") > max_visited).select(*key))
        step = F.struct(F.when(F.col("dir") == 0, "out").otherwise("in").alias("direction"), "kinds", "node_chain", "node")
        new = new.where(F.col("had") + F.col("place") <= max_visited).select(*key, "node", "node_chain", F.lit(depth).alias("depth"), F.col("place").cast("bigint").alias("ord"), F.array_append("path", F.col("node")).alias("path"), F.array_append("hops", step).alias("hops"), "kinds", (F.col("had") + F.col("many") > max_visited).alias("cut"))
        frontier = cut(new)
        if not frontier.take(1):
            break
        seen = cut(seen.unionByName(frontier))
    marked = seen.join(over.distinct().withColumn("truncated", F.lit(True)), key, "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))
    return marked.where((F.lit(include_seeds) | (F.col("depth") > 0)) & (F.col("node_chain") == "")).select(*key, "node", "depth", "path", "hops", "kinds", "truncated")


def relation_score(kinds: Column, depth: Column) -> Column:
    boosts = F.create_map(*[F.lit(x) for p in BOOSTS.items() for x in p])
    best = F.coalesce(F.array_max(F.transform(kinds, lambda k: F.coalesce(boosts[k], F.lit(0.0)))), F.lit(0.0))
    return best / F.greatest(depth, F.lit(1))


def proximity(depth: Column) -> Column:
    return F.when(depth > 0, 1.0 / F.greatest(depth, F.lit(1))).otherwise(0.0)


def seed_support(paths: Column) -> Column:
    return F.least(paths - 1, F.lit(5)) * 0.2


def graph_hits(expansion: DataFrame, seeds: DataFrame) -> DataFrame:
    """query_id, chain_key, id, seed_paths, depth, graph, relation, seed_support: hits of all seeds merged.

    Hits that are another seed are left out. The nearest path counts, of equals the one of the better relation, then of
    the smaller seed.
    """
    other = seeds.select("query_id", "chain_key", F.col("id").alias("node"))
    rows = expansion.join(other, ["query_id", "chain_key", "node"], "left_anti").withColumn("rel", relation_score(F.col("kinds"), F.col("depth")))
    best = F.min(F.struct("depth", (-F.col("rel")).alias("back"), "seed"))
    merged = rows.groupBy("query_id", "chain_key", F.col("node").alias("id")).agg(F.count_distinct("seed").alias("seed_paths"), best.alias("b"))
    return merged.select("query_id", "chain_key", "id", "seed_paths", F.col("b.depth").alias("depth"), proximity(F.col("b.depth")).alias("graph"), (-F.col("b.back")).alias("relation"), seed_support(F.col("seed_paths")).alias("seed_support"))


def bundles(seeds: DataFrame, expansion: DataFrame, records: DataFrame) -> DataFrame:
    """query_id, chain_key, seed, lexical, support: what each seed leads to, by depth, index and id."""
    at = records.select("chain_key", F.col("id").alias("node"), "index")
    rows = expansion.where("depth > 0").join(at, ["chain_key", "node"])
    support = rows.groupBy("query_id", "chain_key", "seed").agg(F.sort_array(F.collect_list(F.struct("depth", "index", "node"))).alias("support"))  # at most max_visited
    empty = F.array().cast("array<struct<depth:int,index:bigint,node:string>>")
    return seeds.select("query_id", "chain_key", F.col("id").alias("seed"), "lexical").join(support, ["query_id", "chain_key", "seed"], "left").withColumn("support", F.coalesce("support", empty))
