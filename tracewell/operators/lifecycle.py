"""Chains from birth to removal: bootstrap, defaults of retrospectives, copying an agent, index freshness, prompts, paging of bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stem import stem
from ..functions.text import stems, tokens
from .graph import BOOSTS
from .storage import numbered

#: Version of how documents are cut into terms: a changed one makes stored postings stale.
NORMALIZER = 1
RETROSPECTIVE = {"thought_type": "LessonLearned", "role": "Retrospective", "importance": 0.7}


def bootstrap(chains: DataFrame, records: DataFrame, content: str) -> DataFrame:
    """First records, Summaries in the role of a Checkpoint, for those of chains (chain_key, agent_id) that hold nothing yet."""
    empty = chains.join(records.select("chain_key").distinct(), "chain_key", "left_anti")
    return empty.select("chain_key", F.lit(0).cast("bigint").alias("index"), "agent_id", F.lit("Summary").alias("thought_type"), F.lit("Checkpoint").alias("role"), F.lit(content).alias("content"), F.lit(1.0).alias("importance"))


def retrospective(inputs: DataFrame) -> DataFrame:
    """inputs with the defaults of a retrospective where they say nothing."""
    have = set(inputs.columns)
    return inputs.withColumns({k: F.coalesce(k, F.lit(v)) if k in have else F.lit(v) for k, v in RETROSPECTIVE.items()})


def copy_agent(records: DataFrame, agent: str, source: str, target: str) -> DataFrame:
    """One agent's records of a chain, numbered after the last of another; refused if the agent is there already."""
    there = records.where((F.col("chain_key") == target) & (F.col("agent_id") == agent))
    if there.take(1):
        raise ValueError(f"{agent} already has records in {target}")
    last = records.where(F.col("chain_key") == target).agg(F.max("index").alias("i")).first()["i"]
    next_index = 0 if last is None else last + 1
    mine = records.where((F.col("chain_key") == source) & (F.col("agent_id") == agent)).withColumnRenamed("index", "old_index")
    mine = numbered(mine, ["chain_key"], ["old_index"], "index").withColumn("index", F.col("index") + next_index).drop("old_index")
    return mine.withColumn("chain_key", F.lit(target))


def deregister(records: DataFrame, chain: str) -> DataFrame:
    """The log without a chain; written back, its partition goes."""
    return records.where(F.col("chain_key") != chain)


def term_postings(records: DataFrame, term: str, stemmed: bool = True) -> DataFrame:
    """chain_key, index, tf of one term in contents, by its stem; more or fewer than one token give nothing."""
    words = records.sparkSession.range(1).select(tokens(F.lit(term)).alias("w")).first()["w"]
    if len(words) != 1:
        return records.select("chain_key", "index", F.lit(0).alias("tf")).where("false")
    wanted = stem(words[0]) if stemmed else words[0]
    there = tokens(F.col("content"))
    tf = F.size(F.filter(stems(there) if stemmed else there, lambda t: t == wanted))
    return records.select("chain_key", "index", tf.alias("tf")).where("tf > 0")


def index_freshness(meta: DataFrame, records: DataFrame) -> DataFrame:
    """chain_key, fresh: whether stored postings (chain_key, normalizer, n, head_id) are those of the log as it is."""
    now = records.groupBy("chain_key").agg(F.count("*").alias("now_n"), F.max_by("id", "index").alias("now_head"))
    same = (F.col("normalizer") == NORMALIZER) & (F.col("n") == F.col("now_n")) & (F.col("head_id") == F.col("now_head"))
    return now.join(meta, "chain_key", "left").select("chain_key", F.coalesce(same, F.lit(False)).alias("fresh"))


def bootstrap_prompt(closure: DataFrame, records: DataFrame) -> DataFrame:
    """chain_key, target, prompt: the closure of a record as text lines in the order of the log."""
    line = F.format_string("[#%d] %s: %s", F.col("index"), F.col("thought_type"), F.col("content"))
    rows = closure.join(records.select("chain_key", "id", "index", "thought_type", "content"), ["chain_key", "id"]).withColumn("line", line)
    return rows.groupBy("chain_key", "target").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", "line"))), lambda x: x["line"]), "\n").alias("prompt"))


def page_bundles(bundles: DataFrame, page_size: int, offset: int = 0) -> DataFrame:
    """Bundles of each query by seed score, one page of them, with the total of all."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("lexical"), "chain_key", "seed")
    rows = bundles.withColumn("place", F.row_number().over(w)).withColumn("total", F.count("*").over(Window.partitionBy("query_id")))
    return rows.where((F.col("place") > offset) & (F.col("place") <= offset + page_size))


def kind_label(kind: Column) -> Column:
    """snake_case name of a relation kind for transport."""
    names = F.create_map(*[F.lit(x) for k in BOOSTS for x in (k, "".join("_" + c.lower() if c.isupper() else c for c in k).lstrip("_"))])
    return names[kind]


def graph_json(expansion: DataFrame) -> DataFrame:
    """query_id, chain_key, seed, json: what a seed leads to, for transport: nodes with depth and path, and the steps of each path with labels of their relations."""
    step = lambda h: F.struct(h["direction"].alias("direction"), F.transform(h["kinds"], kind_label).alias("relations"), F.nullif(h["node_chain"], F.lit("")).alias("chain_key"), h["node"].alias("node"))
    node = F.struct("depth", "node", "path", F.transform("hops", step).alias("hops"))
    made = expansion.groupBy("query_id", "chain_key", "seed").agg(F.sort_array(F.collect_list(node)).alias("nodes"), F.max("truncated").alias("truncated"))  # max_visited nodes at most
    return made.select("query_id", "chain_key", "seed", F.to_json(F.struct("nodes", "truncated")).alias("json"))
