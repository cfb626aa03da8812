"""The parquet tables of one data folder, each with repeated deliveries counted once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The stored rows, repeated deliveries included."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row a key: the first by order. The order must be total where the result depends on it."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def latest_apart(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The same for rows that are large and seldom delivered twice: the keys of those that are, found without the rest of
    the rows and written, so that their size is known, are joined with the rows; rows delivered once aren't shuffled. A null
    key is no key: each such row stays."""
    several = materialize(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key), "repeated")
    return df.join(several, key, "left_anti").unionByName(latest(df.join(several, key, "left_semi"), key, *order))


def ref_docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = table(spark, sf_dir, "ref_docs")
    keep = columns or tuple(df.columns)
    return latest(df.select(*dict.fromkeys(("ref_id", "loaded_ts", *keep))), "ref_id", F.desc("loaded_ts")).select(*keep)


def chunks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Chunks once a chunk_id, as delivered last; source is filled from any delivery that has it."""
    df = table(spark, sf_dir, "chunks")
    keep = columns or tuple(df.columns)
    df = df.select(*dict.fromkeys(("chunk_id", "loaded_ts", *keep)))
    return latest_apart(df, "chunk_id", F.desc("loaded_ts")).select(*keep)


def checks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Claims once a claim_id, as checked last (on equal times the larger status by code points)."""
    df = table(spark, sf_dir, "checklist_result")
    keep = columns or tuple(df.columns)
    df = df.select(*dict.fromkeys(("claim_id", "checked_ts", "status", *keep)))
    return latest(df, "claim_id", F.desc("checked_ts"), F.desc_nulls_last("status")).select(*keep)


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts once a claim_id, as answered last (on equal times the larger verdict)."""
    return latest(table(spark, sf_dir, "llm_verdicts"), "claim_id", F.desc("answered_ts"), F.desc_nulls_last("verdict"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "gold_annotations")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "category_words")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = table(spark, sf_dir, "documents")
    return df.select(*columns) if columns else df
