"""Exact, substring and registry filters; conditions are ANDed, values of a list ORed. Array and substring tests run after the scan, the others are pushed to it."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_VALUES = 100
#: An agent is a row of its chain's registry; the same id in another chain is another agent.
AGENT = ["chain_key", "agent_id"]


@dataclass
class Query:
    types: list[str] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    agent_ids: list[str] = field(default_factory=list)
    agent_names: list[str] = field(default_factory=list)
    agent_owners: list[str] = field(default_factory=list)
    tags_any: list[str] = field(default_factory=list)
    concepts_any: list[str] = field(default_factory=list)
    text_contains: str | None = None
    min_importance: float | None = None
    min_confidence: float | None = None
    since: datetime | None = None
    until: datetime | None = None
    entity_type: str | None = None
    source_episode: str | None = None
    scope: str | None = None
    limit: int | None = None

    def validate(self) -> Query:
        """Lists of over 100 values and non-positive limits are refused."""
        for name, value in vars(self).items():
            if isinstance(value, list) and len(value) > MOST_VALUES:
                raise ValueError(f"{name}: more than {MOST_VALUES} values")
        if self.limit is not None and self.limit < 0:
            raise ValueError("limit must not be negative")
        return self


def contains_any(values: Column, needles: Iterable[str]) -> Column:
    """Some trimmed, lower-cased needle is part of some lower-cased value. Blank needles are ignored; with only blank ones nothing fits."""
    needles = [n.strip().lower() for n in needles]
    needles = [n for n in needles if n]
    if not needles:
        return F.lit(False)
    return F.coalesce(F.exists(values, lambda v: _any(F.contains(F.lower(v), F.lit(n)) for n in needles)), F.lit(False))


def _any(conditions: Iterable[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def time_window(start: datetime, amount: int, unit: str) -> tuple[datetime, datetime]:
    """Inclusive bounds of a window of `amount` seconds or milliseconds; the end is padded to the last microsecond of its unit."""
    if unit not in ("seconds", "milliseconds") or amount < 0:
        raise ValueError("a window is a number of seconds or milliseconds")
    pad = timedelta(seconds=1) if unit == "seconds" else timedelta(milliseconds=1)
    return start, start + timedelta(**{unit: amount}) + pad - timedelta(microseconds=1)


def by_agent_name(records: DataFrame, agents: DataFrame, names: Iterable[str]) -> DataFrame:
    """Records of agents (chain_key, agent_id) whose display name or an alias equals one of names, whatever the case."""
    wanted = [n.lower() for n in names]
    hit = agents.where(F.lower("display_name").isin(wanted) | F.exists("aliases", lambda a: F.lower(a).isin(wanted)))
    return records.join(hit.select(*AGENT).distinct(), AGENT, "left_semi")


def by_agent_owner(records: DataFrame, agents: DataFrame, owners: Iterable[str]) -> DataFrame:
    """Records of agents with one of the owners, whatever the case; agents without owner never fit."""
    hit = agents.where(F.lower("owner").isin([o.lower() for o in owners]))
    return records.join(hit.select(*AGENT).distinct(), AGENT, "left_semi")


def text_contains(records: DataFrame, agents: DataFrame | None, needle: str) -> DataFrame:
    """Records whose content, agent id, tags, concepts or registered names, owner or description hold the needle as it is, whatever the case."""
    n = F.lit(needle.lower())
    inside = lambda c: F.coalesce(F.exists(c, lambda v: F.contains(F.lower(v), n)), F.lit(False))
    here = F.coalesce(F.contains(F.lower("content"), n), F.lit(False)) | F.coalesce(F.contains(F.lower("agent_id"), n), F.lit(False)) | inside("tags") | inside("concepts")
    if agents is None:
        return records.where(here)
    words = F.lower(F.concat_ws("\n", "display_name", "owner", "description", F.array_join("aliases", "\n")))
    hit = agents.where(F.contains(words, n)).select(*AGENT, F.lit(True).alias("registry_hit")).distinct()
    return records.join(hit, AGENT, "left").where(here | F.coalesce("registry_hit", F.lit(False))).drop("registry_hit")


def related_to_concept(records: DataFrame, concept: str, limit: int | None = None) -> DataFrame:
    """Records with a concept that holds this one, the newest `limit` of them."""
    return apply(records, Query(concepts_any=[concept], limit=limit))


def newest(records: DataFrame, n: int, per: tuple[str, ...] = ()) -> DataFrame:
    """The n rows of greatest index (of each group), without order; sort by index to get them as they were appended."""
    if not per:
        return records.orderBy(F.desc("index")).limit(n)
    w = Window.partitionBy(*per).orderBy(F.desc("index"))
    return records.withColumn("newest_rank", F.row_number().over(w)).where(F.col("newest_rank") <= n).drop("newest_rank")


def apply(records: DataFrame, query: Query, agents: DataFrame | None = None) -> DataFrame:
    """Records that fit the query; scope joins the tag needles, so it is ORed with them."""
    q = query.validate()
    out = records
    for column, values in (("thought_type", q.types), ("role", q.roles), ("agent_id", q.agent_ids)):
        if values:
            out = out.where(F.col(column).isin(values))
    for column, value in (("entity_type", q.entity_type), ("source_episode", q.source_episode)):
        if value is not None:
            out = out.where(F.col(column) == value)
    for column, least in (("importance", q.min_importance), ("confidence", q.min_confidence)):
        if least is not None:
            out = out.where(F.col(column) >= least)
    if q.since is not None:
        out = out.where(F.col("timestamp") >= F.lit(q.since))
    if q.until is not None:
        out = out.where(F.col("timestamp") <= F.lit(q.until))
    tags = [*q.tags_any, *([f"scope:{q.scope}"] if q.scope else [])]
    if tags:
        out = out.where(contains_any(F.col("tags"), tags))
    if q.concepts_any:
        out = out.where(contains_any(F.col("concepts"), q.concepts_any))
    if q.agent_names:
        out = by_agent_name(out, agents, q.agent_names)
    if q.agent_owners:
        out = by_agent_owner(out, agents, q.agent_owners)
    if q.text_contains is not None:
        out = text_contains(out, agents, q.text_contains)
    return out if q.limit is None else newest(out, q.limit)
