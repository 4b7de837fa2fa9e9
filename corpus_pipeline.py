"""Corpus pipeline: documents in, token files out. Each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import decontam, mixing, near_dup, quality_fm, token_files
from tracewell.llm.common import steady, stored, table, tidy

#: Numbers of rows that the mix takes are broadcast up to this many; more are shuffled to the texts.
BROADCAST_ROWS = 1_000_000


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name in docs.columns:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labels of the documents given, scores at 0.5 or more.

    Null and empty texts are scored by their statistics like any other; a null doc_id has no label. No usable label:
    every score is 0.5 and all stay. Repeated rows share a fate. Empty table: no rows.
    """
    tidy(spark)
    name = _unused(docs, "score")
    scored = quality_fm.score(docs, quality_fm.fit(docs, table(spark, sf_dir, "labels")), name)
    return scored.where(F.col(name) >= 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id. Similarity 0.8, shingles of five words.

    Of rows that repeat doc_id and text one stays; rows that share a doc_id but not the text are documents of their own.
    Documents without words and rows without doc_id link with nothing and stay. Empty table: no rows.
    """
    tidy(spark)
    found = near_dup.near_duplicates(docs, percent=80)
    mark, n, row = _unused(docs, "mark"), _unused(docs, "n"), _unused(docs, "row")
    keep = stored(found.where("first and doc_id is not null").groupBy("doc_id", F.col("mark").alias(mark)).agg(F.count("*").alias(n)), "dedup-kept")
    key = ["doc_id", mark]
    marked = docs.where("doc_id is not null").withColumn(mark, F.xxhash64("text"))
    once = marked.join(keep.where(F.col(n) == 1).select(*key), key, "left_semi").select(*docs.columns)
    repeated = stored(keep.where(F.col(n) > 1).select(*key), "dedup-repeated")
    if repeated.take(1):  # map-side, only one of each key of a partition moves
        others = F.struct(*[c for c in docs.columns if c != "doc_id"])
        one = marked.join(repeated, key, "left_semi").groupBy(*key).agg(F.min_by(others, F.xxhash64(F.to_json(others))).alias(row))
        once = once.unionByName(one.select("doc_id", f"{row}.*").select(*docs.columns))
    return once.unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of the benchmark (or a whole shorter item).

    Null and empty texts have no words and stay, null doc_ids and repeated rows are judged like any other. Items without
    words match nothing. Empty tables: no rows, or all stay.
    """
    tidy(spark)
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice.

    Null and empty texts have size 0 and are not taken; a null source is a source; repeated rows are rows of their own.
    Empty table: no rows.
    """
    tidy(spark)
    docs = steady(docs, "mix-input")
    row, copies = _unused(docs, "row"), _unused(docs, "copies")
    place = docs.withColumn(row, F.monotonically_increasing_id())
    taken = mixing.mix(docs, row=F.monotonically_increasing_id()).where("copies > 0").select(F.col("row_key").alias(row), F.col("copies").alias(copies))
    few = taken.count() <= BROADCAST_ROWS
    out = place.join(F.broadcast(taken) if few else taken, row).withColumn(_unused(place, "copy"), F.explode(F.sequence(F.lit(1), F.col(copies))))
    return out.select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, described document by document from what was read back."""
    tidy(spark)
    return token_files.token_output(docs)


STAGES = [("quality classifier", quality), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("source mixing", mix_sources), ("token output", token_output)]
#: Trained models, sketches and tokenizers are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
