"""Tables and folders in the place that driver and executors share: what cuts lineage and outlives executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Setting by which Spark deletes the shuffle files of a job at its end, and not when the driver's garbage is next collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: How a table in a local shared folder is written: without checksum files, for each of which Hadoop starts one chmod more. Until chmod runs,
#: a clone of the JVM stands beside it, which looks like as much memory again. The checksums of Parquet's pages are verified instead.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
VERIFIED = {"parquet.page.verify-checksum.enabled": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a purely local session one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracewell-")
        spark.sparkContext.setCheckpointDir(found)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a fresh folder in the shared place; deleted when the driver ends."""
    uri = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)

    def drop() -> None:
        try:
            fs.delete(path, True)
        except Exception:  # the JVM may be gone by then
            pass

    atexit.register(drop)
    return uri


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as a Parquet table in the shared folder and read back. Shuffle files of the job go as soon as it ends."""
    conf, uri = df.sparkSession.conf, f"{new_folder(df.sparkSession, name)}/t"
    before = conf.get(CLEANUP, "false")
    try:
        conf.set(CLEANUP, "true")
        df.write.options(**PLAIN if uri.startswith("file:") else {}).parquet(uri)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.options(**VERIFIED).schema(df.schema).parquet(uri)


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage."""
    return stored(df, "cut")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """df with `name`: 0, 1, ... for the rows of each key in the order. A key of any size is dealt out: rows are sorted in ranges, each counted on from the ranges before it."""
    parts = stored(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("part", F.spark_partition_id()), "numbered")
    upto = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy(*keys, "part").agg(F.count("*").alias("n"))  # a row for each key, and one more for each range that a key goes on in
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n")
    local = F.row_number().over(Window.partitionBy(*keys, "part").orderBy(*order)) - 1
    return parts.withColumn("local", local).join(offsets, [*keys, "part"]).withColumn(name, (F.col("local") + F.col("offset")).cast("bigint")).drop("local", "offset", "part")


def file_system(uri: str):
    """pyarrow file system and path of a URI of the shared folder."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)
