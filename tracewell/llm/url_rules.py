"""URL filter: host-suffix and path-prefix expressions, joined with the rules on short hash prefixes.

Every url is expanded into the expressions suffix-of-host + prefix-of-path that some rule could be written as: suffixes
of as many labels, and prefixes of as many characters, as some rule has. A url thus gives as many expressions as there are
pairs of those numbers, however long it is. Their SHA-256 digests are joined with those of the rules on the first bytes only, and full digests then confirm. DataFrame
functions only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import steady

PREFIX_BYTES = 4
#: Rules beyond this number are not broadcast but shuffled, salted on the side of the urls.
BROADCAST_RULES = 100_000
SALTS = 32
UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: then up to `?` or `#`. Both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER_AZ, LOWER_AZ)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) tuples as a table."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url", keep: Iterable[str] = ("page_id",), broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """keep columns, host, path, rule, verdict: one row per row of pages, repeated rows included.

    A rule fits its own host and all subdomains if the path starts with the rule's path; of those that fit, the longest
    host + path wins, then the longer host, then block before allow. No rule: null and `default`. Null url and url
    without `://`: empty host and path. Rules with null parts are ignored; a rule given twice counts once. Empty tables:
    no rows, or `default` for all.
    """
    keep = list(keep)
    rules = rules.where("host is not null and path is not null and verdict is not null")
    rules = rules.select(F.translate("host", UPPER_AZ, LOWER_AZ).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    text = F.concat("r_host", F.lit("\n"), "r_path")
    rules = rules.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
    rules = rules.select("*", F.sha2(text, 256).alias("r_digest")).withColumn("r_short", F.substring("r_digest", 1, 2 * PREFIX_BYTES))
    n_labels = lambda h: F.length(h) - F.length(F.replace(h, F.lit("."), F.lit(""))) + 1
    shapes = rules.groupBy(n_labels(F.col("r_host")).alias("labels"), F.length("r_path").alias("chars")).agg(F.count("*").alias("n")).collect()  # as many as hosts have labels times paths characters at most
    n_rules = sum(r["n"] for r in shapes)

    host, path = host_and_path(F.col(url_col))
    base = pages.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)], host.alias("host"), path.alias("path"))
    base = steady(base, "url-input").withColumn("row_key", F.monotonically_increasing_id())
    forms = F.array(*[F.struct(F.lit(r["labels"]).alias("labels"), F.lit(r["chars"]).alias("chars")) for r in shapes]) if shapes else F.array().cast("array<struct<labels:int,chars:int>>")
    forms = F.filter(forms, lambda r: (F.col("labels") >= r["labels"]) & (F.length("path") >= r["chars"]))
    pairs = F.transform(forms, lambda r: F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -r["labels"]), F.lit("\n"), F.left(F.col("path"), r["chars"])))
    base = base.withColumn("labels", n_labels(F.col("host")))
    wide = base.select("*", F.explode_outer(pairs).alias("expression")).withColumn("digest", F.sha2("expression", 256)).drop("expression")
    wide = wide.withColumn("short", F.substring("digest", 1, 2 * PREFIX_BYTES))
    if n_rules <= broadcast_rules:
        met = wide.join(F.broadcast(rules), F.col("short") == F.col("r_short"), "left")
    else:
        salted = rules.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = wide.withColumn("salt", F.pmod(F.xxhash64("row_key"), F.lit(SALTS)).cast("int")).join(salted, (F.col("short") == F.col("r_short")) & (F.col("salt") == F.col("r_salt")), "left")
    fits = F.col("digest") == F.col("r_digest")
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), F.col("r_verdict").alias("verdict"), F.concat("r_host", "r_path").alias("rule"))
    best = F.max(F.when(fits, rank)).alias("best")
    out = met.groupBy("row_key").agg(*[F.first(c).alias(c) for c in base.columns if c != "row_key"], best)
    return out.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
