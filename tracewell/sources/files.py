"""Reading and writing record logs: JSON lines, Parquet by chain, backup manifests, transport projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.commit import chain_hashes, normalise, recent_duplicates, verify
from ..operators.storage import stored
from ..plans.schema import RECORD_DDL, upgrade


def read_jsonl(spark: SparkSession, path: str, with_version: bool = False) -> DataFrame:
    """Records of JSON lines; blank lines are skipped, nothing is inferred.

    Every record says its own schema version (none: 0), so versions may follow each other in a file: with_version adds it as
    found_version, and records of versions 0 and 1 lose their hashes, which were made over other fields.
    """
    rows = spark.read.schema(RECORD_DDL).json(path).where(F.col("index").isNotNull())
    found = rows.withColumn("found_version", F.coalesce("schema_version", F.lit(0)))
    old = F.col("found_version") < 2
    found = found.withColumns({c: F.when(old, F.lit("")).otherwise(F.col(c)) for c in ("prev_hash", "hash")})
    return upgrade(found, ("found_version",) if with_version else ())


def write_log(records: DataFrame, path: str, mode: str = "append") -> None:
    """A log partitioned by chain, rows of a file in order of index, so that chain filters prune and index and time filters skip row groups."""
    records.repartition("chain_key", F.floor(F.col("index") / 1_000_000)).sortWithinPartitions("chain_key", "index").write.mode(mode).partitionBy("chain_key").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def open_log(spark: SparkSession, path: str, chain: str | None = None, checked: bool = False) -> DataFrame:
    """The records of a log, or of one chain of it. checked: an error if positions or hashes of a chain are not right."""
    log = upgrade(spark.read.schema(RECORD_DDL).parquet(path))
    log = log if chain is None else log.where(F.col("chain_key") == chain)
    if checked:
        bad = verify(log).where("not ok").limit(5).collect()
        if bad:
            raise ValueError("broken chains: " + ", ".join(f"{r['chain_key']} (from {r['first_bad']})" for r in bad))
    return log


def prepare(spark: SparkSession, path: str, inputs: DataFrame, threshold: float | None = None, window: int = 64, now: Column | None = None) -> DataFrame:
    """Caller's records (chain_key, seq, agent_id, thought_type, content, ...) as they are to be appended to a log.

    Missing fields get their defaults, ids are made, the rest is as commit.normalise says. Refs to indexes that do not exist
    yet are an error, and nothing is written. With a threshold, a record that is at least that similar to one of the `window`
    before it in its chain gets a Supersedes relation to it. Hashes go on from the heads of the chains. Of the log only
    heads, ids of named records and the last `window` records of touched chains are read.
    """
    now = F.current_timestamp() if now is None else now
    known = open_log(spark, path) if exists(spark, path) else spark.createDataFrame([], RECORD_DDL)
    known = known.join(inputs.select("chain_key").distinct(), "chain_key", "left_semi")
    rows = inputs.withColumn("id", F.coalesce("id", F.uuid()) if "id" in inputs.columns else F.uuid())
    rows = rows.withColumn("timestamp", F.coalesce("timestamp", now) if "timestamp" in inputs.columns else now)
    seq = F.col("seq") if "seq" in inputs.columns else F.monotonically_increasing_id()
    rows = stored(upgrade(rows.withColumns({"seq": seq, "index": F.lit(None).cast("bigint")}), ("seq",)), "append-input")
    made = stored(normalise(rows, known.select("chain_key", "index", "id"), now), "append-rows")
    bad = made.where("bad_refs").select("chain_key", "index").limit(5).collect()
    if bad:
        raise ValueError("refs to records that do not exist: " + ", ".join(f"{r['chain_key']}#{r['index']}" for r in bad))
    made = made.drop("bad_refs")
    if threshold is not None:
        tops = known.groupBy("chain_key").agg(F.max("index").alias("top"))
        last = known.join(tops, "chain_key").where(F.col("index") > F.col("top") - window).select("chain_key", "index", "id", "content")
        near = recent_duplicates(last.unionByName(made.select("chain_key", "index", "id", "content")), threshold, window).select("chain_key", "index", "supersedes")
        link = F.struct(F.lit("Supersedes").alias("kind"), F.col("supersedes").alias("target_id"), F.lit(None).cast("string").alias("chain_key"), now.alias("valid_at"), F.lit(None).cast("timestamp").alias("invalid_at"))
        made = made.join(near, ["chain_key", "index"], "left").withColumn("relations", F.when(F.col("supersedes").isNotNull(), F.array_distinct(F.concat("relations", F.array(link)))).otherwise(F.col("relations"))).drop("supersedes")
    heads = known.groupBy("chain_key").agg(F.max_by("hash", "index").alias("hash"))
    return stored(upgrade(chain_hashes(upgrade(made), heads=heads)), "append-done")


def append(spark: SparkSession, path: str, inputs: DataFrame, threshold: float | None = None, window: int = 64, now: Column | None = None, on_append: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Appends records to a log and gives them as prepare() made them; on_append is called with them once they are written."""
    done = prepare(spark, path, inputs, threshold, window, now)
    write_log(done, path)
    if on_append is not None:
        on_append(done)
    return done


def migrate(spark: SparkSession, old: str, new: str, archive: str | None = None) -> None:
    """An older log, JSON lines, as a current one; its hashes are made anew. The old one is then moved to `archive` (`<old>-archive`)."""
    write_log(upgrade(chain_hashes(read_jsonl(spark, old).drop("prev_hash", "hash"))), new, "errorifexists")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(old).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(path(old), path(archive or f"{old.rstrip('/')}-archive")):
        raise OSError(f"{old} could not be moved")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of every file below a folder: what a backup is checked against."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_backup(now: DataFrame, kept: DataFrame) -> DataFrame:
    """path, problem: files missing, changed or added since the manifest was kept; empty if all is well."""
    both = kept.select("path", F.col("sha256").alias("was")).join(now.select("path", F.col("sha256").alias("is")), "path", "full_outer")
    problem = F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "added").when(F.col("is") != F.col("was"), "changed")
    return both.select("path", problem.alias("problem")).where("problem is not null")


def backup(spark: SparkSession, path: str, to: str) -> DataFrame:
    """Copies a folder with its manifest beside it (`<to>-manifest`), paths relative; gives the manifest."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    a, b = hadoop.Path(path), hadoop.Path(to)
    hadoop.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)
    relative(manifest(spark, to), to).write.mode("overwrite").parquet(f"{to}-manifest")
    return spark.read.parquet(f"{to}-manifest")


def relative(files: DataFrame, root: str) -> DataFrame:
    base = root.rstrip("/").rsplit("/", 1)[-1]
    return files.withColumn("path", F.regexp_extract("path", rf".*/{base}/(.*)$", 1))


def restore(spark: SparkSession, backup_path: str, to: str) -> DataFrame:
    """Copies a backup back and gives what does not match its manifest."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    a, b = hadoop.Path(backup_path), hadoop.Path(to)
    hadoop.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)
    return verify_backup(relative(manifest(spark, to), to), spark.read.parquet(f"{backup_path}-manifest"))
