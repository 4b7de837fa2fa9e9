"""Point in time and invalidation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.schema import INVALIDATING


def invalidated(records: DataFrame) -> DataFrame:
    """chain_key, id: targets of relations that supersede, correct or invalidate."""
    r = records.select("chain_key", F.explode("relations").alias("r")).where(F.col("r.kind").isin(*INVALIDATING))
    return r.select("chain_key", F.col("r.target_id").alias("id")).distinct()


def as_of(records: DataFrame, when: datetime | None = None, upto: int | None = None, edge_validity: bool = False) -> DataFrame:
    """Records up to a time (or index), without those that records up to then supersede, correct or invalidate.

    edge_validity also asks that the relation itself was valid at the time.
    """
    past = records.where(F.col("timestamp") <= F.lit(when)) if upto is None else records.where(F.col("index") <= upto)
    source = past
    if edge_validity and when is not None:
        w = F.lit(when)
        live = F.filter("relations", lambda r: (r["valid_at"].isNull() | (r["valid_at"] <= w)) & (r["invalid_at"].isNull() | (r["invalid_at"] > w)))
        source = past.withColumn("relations", live)
    return past.join(invalidated(source), ["chain_key", "id"], "left_anti")
