"""Mixing sources to target weights by weighted fair queueing.

Every document gets a virtual finish time: the words of its source up to and including it, in a shuffled order, over
the target of its source. All sources then advance at the rate of their targets, so the documents that finish before
one common time are the mix. A second pass over a source continues its own clock, which is how a source gives more than
it holds. Running sums are taken in two levels (buckets of the shuffled order, then rows in a bucket), and the common
time is found from a histogram of finish times of which one bucket is sorted row by row, so that neither a source nor
the whole table is ever put in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

ROWS_PER_BUCKET = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], budget: float, repeats: int) -> DataFrame:
    """(source, source_size) with each source's target.

    Weights go round over the sources in code-point order, null last. A target stops at `repeats` times the source's
    size; what is over goes to the others by weight: target = min(repeats * size, weight * level), where the level makes
    the targets add up to budget * total size. One row per source: the windows here see no documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("place", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(repeats))).withColumn("ratio", F.col("cap") / F.col("weight"))
    total = F.sum("source_size").over(every) * F.lit(float(budget))
    left = total - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0))
    width = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))
    s = s.withColumn("level", left / width).withColumn("budget", total)
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(every)["level"]
    return s.withColumn("target", F.least("cap", F.coalesce(F.col("weight") * first, F.col("cap")))).select("source", "source_size", "target", "budget")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, repeats: int = 2, seed: int = 17, row: Column | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (and row_key, if `row` is given).

    docs has doc_id, text, source; other columns are not read. Null or empty text: size 0, never taken. Null source: a
    source of its own. Null doc_id: an ordinary value. Rows with equal doc_id, source and text are placed at one point
    of the order in any sequence, which gives the same rows. Documents are taken whole, at most `repeats` times. The mix
    holds budget * total words or less; what is missing is less than one document of each source. Empty table: empty
    result.
    """
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text")), 1)
    base = docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), key.alias("key"), *([row.alias("row_key")] if row is not None else []))
    base = stored(base, "mix-sizes")
    n_buckets = base.count() // ROWS_PER_BUCKET + 1
    base = base.withColumn("bucket", F.floor(F.col("key") / F.lit(2.0**63) * F.lit(float(n_buckets))))
    buckets = base.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, budget, repeats)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("before", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source")))
    offsets = offsets.select(F.col("o.source").alias("o_source"), F.col("o.bucket").alias("o_bucket"), "before", "source_size", "target", "budget")
    rows = base.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket")))
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("clock", F.col("before") + F.sum("size").over(within))
    finish = [F.try_divide(F.col("source_size") * i + F.col("clock"), F.col("target")).alias(f"finish_{i}") for i in range(repeats)]
    rows = stored(rows.select("doc_id", "source", "size", "source_size", "target", "budget", *finish, *(["row_key"] if row is not None else [])), "mix-finish")
    until = _common_time(rows, repeats, n_buckets)
    copies = sum((F.coalesce((F.col(f"finish_{i}") <= F.lit(until)).cast("int"), F.lit(0)) for i in range(repeats)), F.lit(0))
    out = rows.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"), *(["row_key"] if row is not None else []))


def _common_time(rows: DataFrame, repeats: int, n_buckets: int) -> float:
    """The largest finish time up to which all items fit the budget; items that finish together go together."""
    bins = float(max(1024, n_buckets))
    items = rows.where("size > 0").select("size", "budget", F.explode(F.array(*[f"finish_{i}" for i in range(repeats)])).alias("finish"))
    items = items.withColumn("bin", F.least(F.floor(F.col("finish") * bins), F.lit(int(4 * bins))))
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    hist = items.groupBy("bin").agg(F.sum("size").alias("words"), F.max("budget").alias("budget")).withColumn("upto", F.sum("words").over(upto))
    cut = hist.where("upto > budget").orderBy("bin").limit(1).collect()
    if not cut:
        return float("inf")
    at, base, budget = cut[0]["bin"], cut[0]["upto"] - cut[0]["words"], cut[0]["budget"]
    inside = items.where(F.col("bin") == F.lit(at)).groupBy("finish").agg(F.sum("size").alias("words"))
    inside = inside.withColumn("upto", F.sum("words").over(Window.orderBy("finish").rowsBetween(Window.unboundedPreceding, 0)))
    last = inside.where(F.col("upto") + F.lit(base) <= F.lit(budget)).agg(F.max("finish").alias("f")).first()["f"]
    return last if last is not None else float(at) / bins - 1e-12
