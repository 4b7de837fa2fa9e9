"""Making the package importable in Python workers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Adds the folder of this package to the path of Python workers, wherever the session was started."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([*paths, root])
    return spark
