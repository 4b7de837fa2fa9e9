"""Write side: normalising new records, chaining their hashes, verifying chains, near-duplicates of recent records."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stem_set, tokens
from ..plans.schema import SCHEMA_VERSION
from .storage import cut, numbered

#: Columns that a hash covers.
HASHED = ("index", "agent_id", "thought_type", "role", "content", "importance", "confidence", "tags", "concepts")


def clean_labels(values: Column) -> Column:
    """Trimmed, blanks dropped, one of each whatever the case; the first spelling wins."""
    trimmed = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")
    return F.aggregate(trimmed, F.array().cast("array<string>"), lambda out, v: F.when(F.exists(out, lambda o: F.lower(o) == F.lower(v)), out).otherwise(F.array_append(out, v)))


def with_scope(tags: Column, scope: str) -> Column:
    return F.array_union(tags, F.array(F.lit(f"scope:{scope}")))


def normalise(inputs: DataFrame, log: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """Caller's records (chain_key, seq, id, ...) ready for their chains.

    Indexes follow each chain's last record in the log, in the order of seq; importance and confidence are clamped to 0..1;
    labels are cleaned; entity_type is trimmed. Each ref adds a References relation to the record that has that index, in
    the log or among the inputs, and relations without valid_at get `now` (the time of the query by default); equal
    relations are kept once. Refs to indexes that do not exist yet are marked by `bad_refs`.
    """
    now = F.current_timestamp() if now is None else now
    rows = inputs.drop("index")
    if log is not None:
        rows = rows.join(log.groupBy("chain_key").agg((F.max("index") + 1).alias("next_index")), "chain_key", "left")
    else:
        rows = rows.withColumn("next_index", F.lit(0))
    rows = numbered(rows, ["chain_key"], ["seq"], "index").withColumn("index", F.col("index") + F.coalesce("next_index", F.lit(0))).drop("next_index", "seq")
    # Ids of the records that refs name: only (chain, index, id) of those moves.
    wanted = rows.select("chain_key", F.col("index").alias("from"), F.explode(F.array_distinct("refs")).alias("index")).where(F.col("index") < F.col("from"))
    known = rows.select("chain_key", "index", "id")
    known = known if log is None else known.unionByName(log.select("chain_key", "index", "id"))
    named = wanted.join(known, ["chain_key", "index"]).groupBy("chain_key", F.col("from").alias("index")).agg(F.sort_array(F.collect_list(F.struct(F.col("index").alias("ref"), "id"))).alias("named"))
    rows = rows.join(named, ["chain_key", "index"], "left")
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))
    none = F.lit(None)
    by_ref = F.transform(F.coalesce("named", F.array().cast("array<struct<ref:bigint,id:string>>")), lambda r: F.struct(F.lit("References").alias("kind"), r["id"].alias("target_id"), none.cast("string").alias("chain_key"), now.alias("valid_at"), none.cast("timestamp").alias("invalid_at")))
    given = F.transform("relations", lambda r: F.struct(r["kind"].alias("kind"), r["target_id"].alias("target_id"), r["chain_key"].alias("chain_key"), F.coalesce(r["valid_at"], now).alias("valid_at"), r["invalid_at"].alias("invalid_at")))
    made = {
        "importance": F.when(F.col("importance").isNotNull(), clamp("importance")).otherwise(0.5), "confidence": F.when(F.col("confidence").isNotNull(), clamp("confidence")),
        "tags": clean_labels(F.col("tags")), "concepts": clean_labels(F.col("concepts")), "relations": F.array_distinct(F.concat(given, by_ref)),
        "bad_refs": F.exists("refs", lambda r: (r < 0) | (r >= F.col("index"))),
    }
    if "entity_type" in rows.columns:
        made["entity_type"] = F.nullif(F.trim("entity_type"), F.lit(""))
    return rows.withColumns(made).drop("named")


def payload(columns: tuple[str, ...] = HASHED) -> Column:
    """What is hashed of a record besides the hash before it: its fields as JSON; nulls are written."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def signable(schema_version: int = SCHEMA_VERSION) -> Column:
    """What a caller signs of a record, as JSON: its own fields, cleaned as they will be stored, in this order; nulls are written."""
    clamp = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))))
    body = F.struct(F.lit(schema_version).alias("schema_version"), "agent_id", "session_id", "thought_type", "role", "content", clamp("confidence").alias("confidence"), clamp("importance").alias("importance"), clean_labels(F.col("tags")).alias("tags"), clean_labels(F.col("concepts")).alias("concepts"), "refs", "relations")
    return F.to_json(body, {"ignoreNullFields": "false"})


def record_hash(prev: Column, body: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(prev, F.lit("")), F.lit("\n"), body), 256)


def chain_hashes(records: DataFrame, columns: tuple[str, ...] = HASHED, heads: DataFrame | None = None) -> DataFrame:
    """records with prev_hash and hash: each chain is one sequence, each hash follows from the one before.

    Rows stream through sorted by chain and index, one at a time, whatever the length of a chain; only keys and bodies'
    digests are shipped. heads (chain_key, hash): where chains go on from.
    """
    made = records.select("chain_key", "index", F.sha2(payload(columns), 256).alias("body"))
    if heads is not None:
        made = made.join(heads.select("chain_key", F.col("hash").alias("head")), "chain_key", "left")
    else:
        made = made.withColumn("head", F.lit(None).cast("string"))
    made = made.repartition("chain_key").sortWithinPartitions("chain_key", "index")

    def fold(batches):
        import hashlib

        chain, prev = None, ""
        for b in batches:
            before, after = [], []
            for key, body, head in zip(*(b.column(c).to_pylist() for c in ("chain_key", "body", "head")), strict=True):
                if key != chain:
                    chain, prev = key, head or ""
                before.append(prev)
                prev = hashlib.sha256(f"{prev}\n{body}".encode()).hexdigest()
                after.append(prev)
            yield pa.RecordBatch.from_arrays([b.column("chain_key"), b.column("index"), pa.array(before), pa.array(after)], names=["chain_key", "index", "prev_hash", "hash"])

    hashes = made.mapInArrow(fold, "chain_key string, index bigint, prev_hash string, hash string")
    return records.drop("prev_hash", "hash").join(hashes, ["chain_key", "index"])


def verify(records: DataFrame, columns: tuple[str, ...] = HASHED) -> DataFrame:
    """chain_key, n, ok, first_bad: positions are 0, 1, ...; each prev_hash is the hash before; each hash is right.

    A row is checked against the row with the index before it, which it meets by an equal key, so a long chain is dealt
    out over all tasks. Repeated indexes are bad, too.
    """
    here = records.select("chain_key", "index", F.coalesce("prev_hash", F.lit("")).alias("prev_hash"), "hash", F.sha2(payload(columns), 256).alias("body"))
    before = here.groupBy("chain_key", (F.col("index") + 1).alias("index")).agg(F.max("hash").alias("before"), F.count("*").alias("copies"))
    first = F.col("index") == 0
    met = here.join(before, ["chain_key", "index"], "left")
    links = F.when(first, F.col("prev_hash") == "").otherwise((F.col("prev_hash") == F.col("before")) & (F.col("copies") == 1))
    good = F.coalesce(links & (F.col("index") >= 0) & (F.col("hash") == record_hash(F.col("prev_hash"), F.col("body"))), F.lit(False))
    out = met.withColumn("good", good).groupBy("chain_key").agg(F.count("*").alias("n"), F.min("good").alias("fine"), F.min(F.when(~F.col("good"), F.col("index"))).alias("first_bad"), F.max("index").alias("top"))
    return out.select("chain_key", "n", (F.col("fine") & (F.col("n") == F.col("top") + 1)).alias("ok"), "first_bad")


def head_report(records: DataFrame, columns: tuple[str, ...] = HASHED) -> DataFrame:
    """chain_key, n, head_id, head_hash, head_index, latest, ok, first_bad: what each chain ends with, and whether it verifies."""
    last = F.max_by(F.struct("id", "hash", "index", "content"), "index").alias("h")
    heads = records.groupBy("chain_key").agg(last).select("chain_key", F.col("h.id").alias("head_id"), F.col("h.hash").alias("head_hash"), F.col("h.index").alias("head_index"), F.col("h.content").alias("latest"))
    return verify(records, columns).join(heads, "chain_key")


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def plain_words() -> Column:
    return F.array_distinct(tokens(F.col("content")))


def recent_duplicates(records: DataFrame, threshold: float, window: int = 64, words: Column | None = None) -> DataFrame:
    """chain_key, index, similarity, supersedes: for each record the most similar of the `window` before it in its chain, from threshold on; the earliest of equals.

    Similarity is Jaccard of the stems of tokens and of their irregular base forms, or of `words` (plain_words: distinct tokens).
    Records meet in buckets of `window` indexes, each joined with its own and the next: an equi-join, not a band join.
    """
    words = stem_set(F.col("content")) if words is None else words
    rows = cut(records.select("chain_key", "index", "id", words.alias("w")))  # words are cut once
    rows = rows.where(F.size("w") > 0).withColumn("bucket", F.floor(F.col("index") / window))
    old = rows.select("chain_key", F.col("index").alias("old_index"), F.col("id").alias("old_id"), F.col("w").alias("old_w"), F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    met = rows.join(old, ["chain_key", "bucket"]).where((F.col("old_index") < F.col("index")) & (F.col("old_index") >= F.col("index") - window))
    scored = met.withColumn("similarity", jaccard(F.col("w"), F.col("old_w"))).where(F.col("similarity") >= threshold)
    best = F.max(F.struct("similarity", (-F.col("old_index")).alias("early"), "old_id")).alias("b")
    return scored.groupBy("chain_key", "index").agg(best).select("chain_key", "index", F.col("b.similarity").alias("similarity"), F.col("b.old_id").alias("supersedes"))
