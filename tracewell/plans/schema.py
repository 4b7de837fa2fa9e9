"""Record schema, enumerations, and the views that give the driver's tables the shape of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RELATION = "struct<kind:string,target_id:string,chain_key:string,valid_at:timestamp,invalid_at:timestamp>"
RECORD_DDL = (
    "chain_key string, schema_version int, id string, index bigint, timestamp timestamp, session_id string, agent_id string, "
    "signing_key_id string, thought_signature binary, thought_type string, role string, content string, confidence float, "
    f"importance float, tags array<string>, concepts array<string>, refs array<bigint>, relations array<{RELATION}>, "
    "entity_type string, source_episode string, prev_hash string, hash string"
)
SCHEMA_VERSION = 3
#: Record types, roles, relation kinds.
TYPES = (
    "PreferenceUpdate", "UserTrait", "RelationshipUpdate", "Finding", "Insight", "FactLearned", "PatternDetected", "Hypothesis", "Mistake",
    "Correction", "LessonLearned", "AssumptionInvalidated", "Constraint", "Plan", "Subgoal", "Decision", "StrategyShift", "Wonder", "Question",
    "Idea", "Experiment", "ActionTaken", "TaskComplete", "Checkpoint", "StateSnapshot", "Handoff", "Summary", "Surprise", "Reframe", "Goal",
    "LLMExtracted",
)
ROLES = (
    "Memory", "WorkingMemory", "Summary", "Compression", "Checkpoint", "Handoff", "Audit", "Retrospective",
)
KINDS = (
    "References", "Summarizes", "Corrects", "Invalidates", "CausedBy", "Supports", "Contradicts", "DerivedFrom", "ContinuesFrom", "BranchesFrom",
    "RelatedTo", "Supersedes",
)
INVALIDATING = ("Supersedes", "Corrects", "Invalidates")


def record_schema() -> StructType:
    return StructType.fromDDL(RECORD_DDL)


def upgrade(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """df of any schema version with the current schema (and the columns to keep): missing columns get their defaults, arrays are never null."""
    defaults = {"schema_version": F.lit(SCHEMA_VERSION), "role": F.lit("Memory"), "importance": F.lit(0.5)}
    out = []
    for f in record_schema().fields:
        value = F.col(f.name) if f.name in df.columns else F.lit(None)
        if f.name in defaults:
            value = defaults[f.name] if f.name == "schema_version" else F.coalesce(value, defaults[f.name])
        if f.dataType.typeName() == "array":
            value = F.coalesce(value.cast(f.dataType), F.array().cast(f.dataType))
        out.append(value.cast(f.dataType).alias(f.name))
    return df.select(*out, *keep)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation(kind, target, chain=None) -> F.Column:
    null_ts = F.lit(None).cast("timestamp")
    chain = chain if chain is not None else F.lit(None).cast("string")
    return F.struct(kind.alias("kind"), target.alias("target_id"), chain.alias("chain_key"), null_ts.alias("valid_at"), null_ts.alias("invalid_at"))


def conversation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per turn; a conversation is a chain of its own. Every turn continues the one before; every fifth corrects the second before."""
    t = _table(spark, sf_dir, "conversations")
    ident = lambda back: F.md5(F.concat(F.lit("conv:"), F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - back).cast("string")).cast("binary"))
    relations = F.array_compact(F.array(F.when(F.col("turn") > 0, relation(F.lit("ContinuesFrom"), ident(1))), F.when((F.col("turn") % 5 == 4), relation(F.lit("Corrects"), ident(2)))))
    return t.select(
        F.col("conv_id").cast("string").alias("chain_key"), ident(0).alias("id"), F.col("turn").cast("bigint").alias("index"), F.col("conv_id").cast("string").alias("session_id"), F.col("role").alias("agent_id"),
        F.expr("CASE role WHEN 'user' THEN 'Question' WHEN 'assistant' THEN 'FactLearned' ELSE 'Constraint' END").alias("thought_type"), F.lit("Memory").alias("role"), F.col("text").alias("content"),
        F.when(F.col("role") == "user", 0.8).otherwise(0.2).alias("importance"), F.lit(None).cast("double").alias("confidence"),
        F.array(F.concat(F.lit("session:"), F.col("conv_id").cast("string")), F.concat(F.lit("role:"), F.col("role"))).alias("tags"), F.array().cast("array<string>").alias("concepts"),
        F.when(F.col("turn") > 2, F.array(F.lit(0).cast("bigint"))).otherwise(F.array().cast("array<bigint>")).alias("refs"), relations.alias("relations"),
    )


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per event in a single chain."""
    return _table(spark, sf_dir, "events").select(
        F.lit("evt").alias("chain_key"), F.concat(F.lit("evt:"), F.col("event_id").cast("string")).alias("id"), F.col("event_id").alias("index"), F.col("ts").alias("timestamp"), F.col("user_id").cast("string").alias("agent_id"),
        F.expr("CASE event_type WHEN 'signup' THEN 'UserTrait' WHEN 'purchase' THEN 'Decision' WHEN 'error' THEN 'Mistake' WHEN 'view' THEN 'Finding' ELSE 'ActionTaken' END").alias("thought_type"),
        F.lit("Memory").alias("role"), F.concat_ws(" ", "event_type", "props").alias("content"), (F.col("event_id") % 10 / 10.0).alias("importance"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 7 / 7.0).alias("confidence"), F.array("event_type", F.concat(F.lit("scope:"), F.expr("CASE user_id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'session' ELSE 'agent' END"))).alias("tags"),
        F.array(F.concat(F.lit("k"), F.regexp_extract("props", r'"k": *(\d+)', 1))).alias("concepts"), F.col("event_type").alias("entity_type"), F.concat(F.lit("ep"), (F.col("event_id") % 50).cast("string")).alias("source_episode"),
    )


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per document in a single chain; its language is its tag, its source the agent."""
    return _table(spark, sf_dir, "documents").select(
        F.lit("doc").alias("chain_key"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id").alias("index"), F.col("source").alias("agent_id"), F.lit("FactLearned").alias("thought_type"),
        F.col("text").alias("content"), (F.col("doc_id") % 10 / 10.0).alias("importance"), F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 5 / 5.0).alias("confidence"),
        F.array("lang").alias("tags"), F.array(F.concat(F.lit("topic"), (F.col("doc_id") % 13).cast("string"))).alias("concepts"), F.col("source").alias("source"),
    )


def event_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent registry of the event chain: names, owners and aliases are made up from the user id."""
    return _table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).select(
        F.lit("evt").alias("chain_key"), F.col("user_id").cast("string").alias("agent_id"), F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("display_name"), F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("Team"), (F.col("user_id") % 5).cast("string"))).alias("owner"),
        F.lit(None).cast("string").alias("description"), F.array(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("aliases"),
    )


def document_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent registry of the document chain: every source has a name, an owner, a description and an alias made up from its number."""
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return _table(spark, sf_dir, "documents").select("source").distinct().select(
        F.lit("doc").alias("chain_key"), F.col("source").alias("agent_id"), F.concat(F.lit("Source "), n.cast("string")).alias("display_name"), F.concat(F.lit("Team"), (n % 5).cast("string")).alias("owner"),
        F.when(n % 4 == 0, "editions of things").otherwise("plain").alias("description"), F.array(F.concat(F.lit("s"), n.cast("string"))).alias("aliases"),
    )


#: The same views for DuckDB.
CONV = """conv AS (
  SELECT CAST(conv_id AS VARCHAR) AS chain_key, md5('conv:' || conv_id || ':' || turn) AS id, turn AS idx, role AS agent_id, text AS content,
         CASE role WHEN 'user' THEN 'Question' WHEN 'assistant' THEN 'FactLearned' ELSE 'Constraint' END AS thought_type,
         CASE WHEN role = 'user' THEN 0.8 ELSE 0.2 END::DOUBLE AS importance, ['session:' || conv_id, 'role:' || role] AS tags, conv_id, turn
  FROM conversations)"""
EVT = """evt AS (
  SELECT event_id AS idx, 'evt:' || event_id AS id, ts, CAST(user_id AS VARCHAR) AS agent_id,
         CASE event_type WHEN 'signup' THEN 'UserTrait' WHEN 'purchase' THEN 'Decision' WHEN 'error' THEN 'Mistake' WHEN 'view' THEN 'Finding' ELSE 'ActionTaken' END AS thought_type,
         concat_ws(' ', event_type, props) AS content, (event_id % 10) / 10.0::DOUBLE AS importance, CASE WHEN event_id % 3 <> 0 THEN (event_id % 7) / 7.0::DOUBLE END AS confidence,
         [event_type, 'scope:' || CASE user_id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'session' ELSE 'agent' END] AS tags,
         ['k' || regexp_extract(props, '"k": *(\\d+)', 1)] AS concepts, event_type AS entity_type, 'ep' || (event_id % 50) AS source_episode, user_id
  FROM events)"""
DOC = """doc AS (
  SELECT doc_id AS idx, 'doc:' || doc_id AS id, source AS agent_id, text AS content, (doc_id % 10) / 10.0::DOUBLE AS importance,
         CASE WHEN doc_id % 4 <> 0 THEN (doc_id % 5) / 5.0::DOUBLE END AS confidence, [lang] AS tags, ['topic' || (doc_id % 13)] AS concepts, source,
         concat_ws(' ', 'Source ' || regexp_extract(source, '(\\d+)$', 1), 'Team' || (regexp_extract(source, '(\\d+)$', 1)::INT % 5), CASE WHEN regexp_extract(source, '(\\d+)$', 1)::INT % 4 = 0 THEN 'editions of things' ELSE 'plain' END, 's' || regexp_extract(source, '(\\d+)$', 1)) AS registry
  FROM documents)"""
AGENTS = """agents AS (
  SELECT DISTINCT CAST(user_id AS VARCHAR) AS agent_id, 'User ' || user_id AS display_name, CASE WHEN user_id % 4 <> 0 THEN 'Team' || (user_id % 5) END AS owner, 'u' || user_id AS alias
  FROM events)"""

