"""Structured Streaming jobs over an append-only log: event fan-out, running registries, dedup state, derived tables."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import stem_set, stems, tokens

ATTEMPTS, BACKOFF_S = 3, 1.0
#: Rows of hooks up to this number are broadcast; more are joined like any table.
BROADCAST_HOOKS = 10_000


def log_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_agents(stream: DataFrame) -> DataFrame:
    """chain_key, agent_id, n, first_index, last_index; update mode."""
    return stream.groupBy("chain_key", "agent_id").agg(F.count("*").alias("n"), F.min("index").alias("first_index"), F.max("index").alias("last_index"))


def running_terms(stream: DataFrame, stemmed: bool = True) -> DataFrame:
    """chain_key, term, df: document frequencies of contents, as stems, as they grow; update mode."""
    words = tokens(F.col("content"))
    return stream.select("chain_key", F.explode(F.array_distinct(stems(words) if stemmed else words)).alias("term")).groupBy("chain_key", "term").agg(F.count("*").alias("df"))


def running_lengths(stream: DataFrame) -> DataFrame:
    """chain_key, n_docs, tokens: what average lengths come from; update mode."""
    return stream.select("chain_key", F.size(tokens(F.col("content"))).alias("len")).groupBy("chain_key").agg(F.count("*").alias("n_docs"), F.sum("len").alias("tokens"))


def dedup(stream: DataFrame, threshold: float, window: int = 64, words: Column | None = None) -> DataFrame:
    """chain_key, index, similarity, supersedes: the most similar of the last `window` records of the chain, from threshold on. State: that many word sets a chain.

    Words are stems of tokens and of their irregular base forms, or those given (commit.plain_words: distinct tokens).
    """
    rows = stream.select("chain_key", "index", "id", (stem_set(F.col("content")) if words is None else words).alias("words"))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = [(i, d, set(w)) for i, d, w in zip(*state.get, strict=True)] if state.exists else []
        new = pd.concat(list(batches)).sort_values("index")
        out = []
        for index, ident, words in zip(new["index"], new["id"], new["words"], strict=True):
            mine, best = set(words), (0.0, None)
            for i, d, w in kept:
                if mine and w and i >= index - window:
                    s = len(mine & w) / len(mine | w)
                    best = (s, d) if s > best[0] else best
            if best[1] is not None and best[0] >= threshold:
                out.append((key[0], index, best[0], best[1]))
            kept = [*kept, (int(index), ident, mine)][-window:]
        state.update(([i for i, _, _ in kept], [d for _, d, _ in kept], [sorted(w) for _, _, w in kept]))
        yield pd.DataFrame(out, columns=["chain_key", "index", "similarity", "supersedes"])

    return rows.groupBy("chain_key").applyInPandasWithState(run, "chain_key string, index bigint, similarity double, supersedes string", "idx array<bigint>, ids array<string>, words array<array<string>>", "append", GroupStateTimeout.NoTimeout)


def fan_out(stream: DataFrame, hooks: DataFrame, send: Callable[[str, str], bool], checkpoint: str, attempts: int = ATTEMPTS, backoff: float = BACKOFF_S):
    """Starts a query that sends every new record to the hooks (url, chain_key or null, types) it fits.

    send(url, json) runs on executors, is tried `attempts` times with doubling pauses and may raise; what fails for good
    is counted by the sender's own means and does not stop the stream.
    """

    def deliver(rows) -> None:
        for r in rows:
            for k in range(attempts):
                try:
                    if send(r["url"], r["json"]):
                        break
                except Exception:
                    pass
                if k + 1 < attempts:
                    time.sleep(backoff * 2**k)

    # A hook meets a record on equal keys (chain or any, type or any): one row for each of its types, four of a record.
    of_types = F.when(F.size("types") == 0, F.array(F.lit(None).cast("string"))).otherwise(F.array_distinct(F.array_compact("types")))
    wanted = hooks.select("url", F.col("chain_key").isNull().alias("any_chain"), F.col("chain_key").alias("hook_chain"), (F.size("types") == 0).alias("any_type"), F.explode(of_types).alias("hook_type"))

    def batch(df: DataFrame, _: int) -> None:
        no, yes, none = F.lit(False), F.lit(True), F.lit(None).cast("string")
        chains, types = F.array(F.struct(yes.alias("any"), none.alias("v")), F.struct(no.alias("any"), F.col("chain_key").alias("v"))), F.array(F.struct(yes.alias("any"), none.alias("v")), F.struct(no.alias("any"), F.col("thought_type").alias("v")))
        json = F.to_json(F.struct("chain_key", "index", "id", "thought_type", "content")).alias("json")
        rows = df.select(json, F.explode(chains).alias("c"), types.alias("ts")).select("json", "c", F.explode("ts").alias("t"))
        few = wanted.limit(BROADCAST_HOOKS + 1).count() <= BROADCAST_HOOKS
        fits = (F.col("c.any") == F.col("any_chain")) & F.col("c.v").eqNullSafe(F.col("hook_chain")) & (F.col("t.any") == F.col("any_type")) & F.col("t.v").eqNullSafe(F.col("hook_type"))
        rows.join(F.broadcast(wanted) if few else wanted, fits).select("url", "json").foreachPartition(deliver)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def append_vectors(stream: DataFrame, path: str, checkpoint: str):
    """Starts a query that embeds every new record and appends it to the vector table."""
    from ..operators.vector import build_sidecar

    return stream.writeStream.foreachBatch(lambda df, _: build_sidecar(df).write.mode("append").parquet(path)).option("checkpointLocation", checkpoint).start()


def commit_stream(stream: DataFrame, path: str, checkpoint: str, every: str = "2 seconds", threshold: float | None = None, on_append: Callable[[DataFrame], None] | None = None):
    """Starts a query that appends what arrives to a log, one group for each micro-batch of `every`.

    A group is first kept as it will be appended (`<checkpoint>-groups/<number>`), then appended, then marked as done. What
    is replayed after a failure is the kept group, of which only records that the log lacks are written, so each is in the
    log once. on_append is called with the records of each group. flush(query) waits until all that has arrived is there.
    """
    from ..sources.files import exists, open_log, prepare, write_log

    groups = f"{checkpoint.rstrip('/')}-groups"

    def write(rows: DataFrame, batch: int) -> None:
        spark, kept = rows.sparkSession, f"{groups}/{batch}"
        if exists(spark, f"{kept}/_DONE"):
            return
        if not exists(spark, f"{kept}/_SUCCESS"):
            if not rows.take(1):
                return
            prepare(spark, path, rows, threshold).write.mode("overwrite").parquet(kept)
        group = spark.read.parquet(kept)
        new = group.join(open_log(spark, path).select("chain_key", "id"), ["chain_key", "id"], "left_anti") if exists(spark, path) else group
        write_log(new, path)
        if on_append is not None:
            on_append(group)
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{kept}/_DONE")
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True).close()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def flush(query) -> None:
    """Returns when everything that has arrived so far is committed."""
    query.processAllAvailable()


def running_postings(stream: DataFrame, path: str, checkpoint: str, fields: tuple[str, ...] = ("content", "tags", "concepts", "agent_id")):
    """Starts a query that appends the postings of new records, as lexical.postings makes them, to a table; its sums are what bm25 needs."""
    from ..operators import lexical

    def write(rows: DataFrame, batch: int) -> None:
        lexical.postings(lexical.field_tokens(rows, fields, stemmed=True), fields).write.mode("overwrite").parquet(f"{path}/group={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
