"""Helpers that the training-data operators share: shared storage, table loading, byte-level word splitting."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import file_system, new_folder, shared_dir, stored
from ..plans.session import ship

__all__ = ["alnum_words", "file_system", "join_counted", "new_folder", "publish", "shared_dir", "ship", "slices", "space_words", "steady", "stored", "table", "tidy"]

#: Keys with more rows than both are joined by broadcast: HOT_ROWS, and the HOT_KEYS-th part of all rows.
HOT_ROWS, HOT_KEYS = 256, 50_000

#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A-Z to a-z; every ASCII byte that is neither a digit nor a letter becomes a space.
LOWER_ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Java pattern of what bytes.split() takes for a word.
WORD = r"[^\x20\x09-\x0D]+"


def space_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of `[^\\x20\\x09-\\x0D]+`; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of ASCII letters, digits and all non-ASCII characters; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER_ALNUM).split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steady_scan(df: DataFrame) -> bool:
    """Whether df is a plain scan of files, projected and filtered at most: its rows come in the same order and partitions whenever it is read."""
    todo, scans = [df._jdf.queryExecution().optimizedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName() not in ("Project", "Filter", "LogicalRelation", "SubqueryAlias") and not node.nodeName().startswith("Relation"):
            return False
        scans += not node.children().size()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return scans == 1 and df._jdf.queryExecution().optimizedPlan().deterministic() and bool(df.inputFiles())


def steady(df: DataFrame, name: str) -> DataFrame:
    """df if it is a plain scan of files, whose rows keep their numbers whenever it is read; else a stored copy of it."""
    return df if steady_scan(df) else stored(df, name)


def join_counted(left: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """left.join(counted, keys) for a table `counted` with one row and the number `n` of left rows for each key.

    Keys of more than a HOT_KEYS-th of all rows (and HOT_ROWS) meet their rows by broadcast, so none of them fills a task;
    there are HOT_KEYS of those at most.
    """
    total = counted.agg(F.sum("n")).first()[0] or 0
    most = max(HOT_ROWS, total // HOT_KEYS)
    hot = counted.where(F.col("n") > most)
    if not hot.take(1):
        return left.join(counted, keys)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(counted.where(F.col("n") <= most), keys)
    return rest.unionByName(left.join(F.broadcast(hot), keys))


def tidy(spark: SparkSession) -> None:
    """Collects garbage of the driver, Python's first: plans, broadcasts and shuffles that nothing refers to any more go, here and on executors."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(batch, column: int, rows: int = 1024, size: int = 2 << 20):
    """Slices of an Arrow batch with up to `rows` rows and `size` bytes of the texts in a column; a longer text is alone."""
    import numpy as np
    import pyarrow.compute as pc

    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = int(upto[at - 1]) if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(upto, done + size, "right"))))
        yield batch.slice(at, end - at)
        at = end


def publish(fs, temp: str, name: str) -> None:
    """Gives a finished file its name. Where another try of the task was first, its file stays: both hold the same."""
    from pyarrow.fs import FileType

    try:
        fs.move(temp, name)
    except OSError:  # stores whose rename does not replace
        if fs.get_file_info(name).type != FileType.File:
            raise
        fs.delete_file(temp)
