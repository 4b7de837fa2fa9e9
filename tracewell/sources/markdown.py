"""Memory markdown: export by section, import line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.schema import TYPES

#: Sections in order and the record types they hold.
SECTIONS = {
    "Identity": ("PreferenceUpdate", "UserTrait", "RelationshipUpdate",),
    "Knowledge": ("Finding", "Insight", "FactLearned", "PatternDetected", "Hypothesis", "Surprise",),
    "Constraints And Decisions": ("Constraint", "Plan", "Subgoal", "Decision", "StrategyShift",),
    "Corrections": ("Mistake", "Correction", "LessonLearned", "AssumptionInvalidated", "Reframe",),
    "Open Threads": ("Wonder", "Question", "Idea", "Experiment",),
    "Execution State": ("ActionTaken", "TaskComplete", "Checkpoint", "StateSnapshot", "Handoff", "Summary",),
}
LINE = r"^- \[#(\d+)\] (\w+): (.*) \((agent .*)\)$"
KNOWN = [t for t in TYPES if t not in ("Goal", "LLMExtracted")]


def line(agent: Column) -> Column:
    """`- [#index] Type: content (agent a; role R; importance 0.50; confidence 0.90; tags x, y)`; Memory as a role is not written."""
    role = F.when(F.col("role") != "Memory", F.concat(F.lit("role "), F.col("role")))
    confidence = F.when(F.col("confidence").isNotNull(), F.format_string("confidence %.2f", F.col("confidence").cast("double")))
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("tags "), F.array_join("tags", ", ")))
    about = F.concat_ws("; ", F.concat(F.lit("agent "), agent), role, F.format_string("importance %.2f", F.col("importance").cast("double")), confidence, tags)
    return F.concat(F.format_string("- [#%d] %s: ", F.col("index"), F.col("thought_type")), F.col("content"), F.lit(" ("), about, F.lit(")"))


def lines(records: DataFrame, agent: Column | None = None) -> DataFrame:
    """chain_key, section_no, section, index, line: the body of the export, row by row; types of no section are left out."""
    where = F.create_map(*[F.lit(x) for k, types in enumerate(SECTIONS.values()) for t in types for x in (t, k)])
    rows = records.withColumn("section_no", where[F.col("thought_type")]).where("section_no is not null")
    names = F.array(*[F.lit(s) for s in SECTIONS])
    return rows.select("chain_key", "section_no", names[F.col("section_no")].alias("section"), "index", line(F.col("agent_id") if agent is None else agent).alias("line"))


def export(records: DataFrame) -> DataFrame:
    """chain_key, markdown: one document for each chain. Meant for chains of a size that one reads."""
    parts = lines(records).groupBy("chain_key", "section_no", "section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", "line"))), lambda x: x["line"]), "\n").alias("body"))
    text = F.concat(F.lit("## "), F.col("section"), F.lit("\n\n"), F.col("body"), F.lit("\n\n"))
    body = parts.groupBy("chain_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section_no", text.alias("t")))), lambda x: x["t"]), "").alias("body"), F.count("*"))
    counts = records.groupBy("chain_key").agg(F.count("*").alias("n"))
    head = F.concat(F.lit("# MEMORY\n\nGenerated from `"), F.col("chain_key"), F.lit("` with "), F.col("n").cast("string"), F.lit(" thought(s).\n\n"))
    return counts.join(body, "chain_key", "left").select("chain_key", F.concat(head, F.coalesce("body", F.lit(""))).alias("markdown"))


def parse(text_lines: DataFrame, column: str = "value") -> DataFrame:
    """Records of exported lines: old_index, thought_type, content, agent_id, role, importance, confidence, tags. Lines that do not fit are skipped."""
    v = F.col(column)
    about = F.regexp_extract(v, LINE, 4)
    part = lambda name: F.nullif(F.regexp_extract(about, rf"(?:^|; ){name} ([^;]*)", 1), F.lit(""))
    rows = text_lines.where(v.rlike(LINE)).select(
        F.regexp_extract(v, LINE, 1).cast("bigint").alias("old_index"), F.regexp_extract(v, LINE, 2).alias("thought_type"), F.regexp_extract(v, LINE, 3).alias("content"), part("agent").alias("agent_id"),
        F.coalesce(part("role"), F.lit("Memory")).alias("role"), F.coalesce(part("importance").try_cast("double"), F.lit(0.5)).alias("importance"), part("confidence").try_cast("double").alias("confidence"),
        F.coalesce(F.split(part("tags"), ", "), F.array().cast("array<string>")).alias("tags"),
    )
    return rows.where(F.col("thought_type").isin(KNOWN))
