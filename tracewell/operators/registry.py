"""Registries derived from records: agents, entity types, what a result touches; and recall of benchmark queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def agent_counts(records: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """chain_key, agent_id, n, first_index, last_index (and display_name, owner)."""
    out = records.groupBy("chain_key", "agent_id").agg(F.count("*").alias("n"), F.min("index").alias("first_index"), F.max("index").alias("last_index"))
    return out if agents is None else out.join(agents.select("chain_key", "agent_id", "display_name", "owner"), ["chain_key", "agent_id"], "left")


def listing(records: DataFrame, agents: DataFrame) -> DataFrame:
    """agent_counts with `place`: agents of each chain in the order of their names (their ids where they have none), whatever the case, then ids."""
    name = F.lower(F.coalesce("display_name", "agent_id"))
    w = Window.partitionBy("chain_key").orderBy(name, F.lower("agent_id"), "agent_id")  # the agents of a chain
    return agent_counts(records, agents).withColumn("place", F.row_number().over(w))


def entity_types(records: DataFrame) -> DataFrame:
    return records.where(F.col("entity_type").isNotNull()).groupBy("chain_key", "entity_type").agg(F.min("index").alias("first_index"), F.max("index").alias("last_index"), F.count("*").alias("n"))


def touched(records: DataFrame, *by: str) -> DataFrame:
    """Sorted distinct agents, types, tags and concepts of a result."""
    flat = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_set(c))))
    return records.groupBy(*by).agg(F.sort_array(F.collect_set("agent_id")).alias("agents"), F.sort_array(F.collect_set("thought_type")).alias("types"), flat("tags").alias("tags"), flat("concepts").alias("concepts"))


def names_over_time(events: DataFrame) -> DataFrame:
    """chain_key, agent_id, display_name, aliases, owner: (seq, display_name, owner) rows folded in order: a new name makes the old one an alias; the first owner stays."""
    schema = "chain_key string, agent_id string, display_name string, aliases array<string>, owner string"

    def fold(pdf):
        import pandas as pd

        pdf = pdf.sort_values("seq")
        name, owner, aliases = None, None, []
        for new, who in zip(pdf["display_name"], pdf["owner"], strict=True):
            if new is not None and new != name:
                if name is not None and name not in aliases:
                    aliases.append(name)
                aliases = [a for a in aliases if a != new]
                name = new
            owner = owner if owner is not None else who
        return pd.DataFrame({"chain_key": [pdf["chain_key"].iloc[0]], "agent_id": [pdf["agent_id"].iloc[0]], "display_name": [name], "aliases": [aliases], "owner": [owner]})

    return events.groupBy("chain_key", "agent_id").applyInPandas(fold, schema)


AGENT = "chain_key string, agent_id string, display_name string, owner string, description string, aliases array<string>, status string, public_keys array<struct<key_id:string,algorithm:string,public_key_bytes:binary,added_at:timestamp,revoked_at:timestamp>>"
CHANGE = "chain_key string, agent_id string, seq bigint, kind string, display_name string, owner string, description string, alias string, key_id string, algorithm string, public_key_bytes binary, at timestamp"


def changed(changes: DataFrame) -> DataFrame:
    """Agents (chain_key, agent_id, display_name, owner, description, aliases, status, public_keys) after changes, in the order of seq.

    kind: `upsert` (display_name, owner, description: what is given replaces; a new name makes the old one an alias, the
    first owner stays), `describe`, `alias`, `add_key`, `revoke_key` (by key_id, at), `disable`, `enable`. Other kinds are an
    error. The changes of one agent are folded together; agents side by side.
    """

    schema = to_arrow_schema(StructType.fromDDL(AGENT))

    def fold(table):
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: r["seq"])
        agent = {"chain_key": rows[0]["chain_key"], "agent_id": rows[0]["agent_id"], "display_name": None, "owner": None, "description": None, "aliases": [], "status": "active", "public_keys": []}
        for r in rows:
            if r["kind"] in ("upsert", "describe"):
                new = r["display_name"] if r["kind"] == "upsert" else None
                if new is not None and new != agent["display_name"]:
                    if agent["display_name"] is not None and agent["display_name"] not in agent["aliases"]:
                        agent["aliases"].append(agent["display_name"])
                    agent["aliases"] = [a for a in agent["aliases"] if a != new]
                    agent["display_name"] = new
                if r["kind"] == "upsert" and agent["owner"] is None:
                    agent["owner"] = r["owner"]
                if r["description"] is not None:
                    agent["description"] = r["description"]
            elif r["kind"] == "alias":
                if r["alias"] and r["alias"] not in (agent["display_name"], *agent["aliases"]):
                    agent["aliases"].append(r["alias"])
            elif r["kind"] == "add_key":
                agent["public_keys"] = [k for k in agent["public_keys"] if k["key_id"] != r["key_id"]] + [{"key_id": r["key_id"], "algorithm": r["algorithm"], "public_key_bytes": r["public_key_bytes"], "added_at": r["at"], "revoked_at": None}]
            elif r["kind"] == "revoke_key":
                for k in agent["public_keys"]:
                    if k["key_id"] == r["key_id"] and k["revoked_at"] is None:
                        k["revoked_at"] = r["at"]
            elif r["kind"] in ("disable", "enable"):
                agent["status"] = "disabled" if r["kind"] == "disable" else "active"
            else:
                raise ValueError(f"no such change: {r['kind']}")
        return pa.Table.from_pylist([agent], schema)

    wanted = [f.split()[0] for f in CHANGE.split(", ")]
    full = changes.select(*[F.col(c) if c in changes.columns else F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in CHANGE.split(", "))])
    return full.select(*wanted).groupBy("chain_key", "agent_id").applyInArrow(fold, AGENT)


def latest(events: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The last event of each key: upserts, status changes, revocations."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return events.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def project(records: DataFrame, agents: DataFrame) -> DataFrame:
    """chain_key, index, json: a record for transport, with its agent's name and owner; non-finite numbers become null or 0.5."""
    rows = records.join(agents.select("chain_key", "agent_id", "display_name", "owner"), ["chain_key", "agent_id"], "left")
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c))
    body = F.struct("id", "index", "agent_id", F.col("display_name").alias("agent_name"), F.col("owner").alias("agent_owner"), "thought_type", "content", F.coalesce(finite("importance"), F.lit(0.5)).alias("importance"), finite("confidence").alias("confidence"), "tags")
    return rows.select("chain_key", "index", F.to_json(body).alias("json"))


def recall_at(hits: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """One row: share of the queries of gold (query_id, id) with a gold id among the first k hits, for each k."""
    best = gold.join(hits.select("query_id", "id", "rank"), ["query_id", "id"], "left").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return best.agg(*[F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("double")).alias(f"r_{k}") for k in ks])
