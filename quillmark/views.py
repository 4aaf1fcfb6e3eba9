"""Evaluation-warehouse views over the star-schema tables.

Each view exists twice, as a DataFrame and as SQL text with the same meaning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def eval_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    k = F.regexp_extract("props", '"k": ([0-9]+)', 1)
    return e.select(
        F.col("ts").cast("date").cast("string").alias("run_id"),
        F.col("event_id").alias("question_id"),
        (F.col("user_id") % 5).alias("model_id"),
        F.col("event_type").alias("pipeline"),
        (F.col("user_id") % 4).alias("source_type"),
        F.when(k == "", -1).otherwise(k.try_cast("int") % 6).alias("category"),
        F.least(F.col("value") / 500, F.lit(1.0)).alias("overall_score"),
        F.col("value").alias("latency_ms"),
        (F.col("value") > 100).alias("answer_correct"),
        (F.col("value") / 1000).alias("cost_usd"),
        F.col("user_id"),
        F.col("ts"),
    )


EV = """ev AS (
  SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, event_id AS question_id, user_id % 5 AS model_id,
    event_type AS pipeline, user_id % 4 AS source_type,
    CASE WHEN regexp_extract(props, '"k": ([0-9]+)', 1) = '' THEN -1
      ELSE TRY_CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) % 6 END AS category,
    least(value / 500, 1.0::DOUBLE) AS overall_score, value AS latency_ms, value > 100 AS answer_correct,
    value / 1000 AS cost_usd, user_id, ts
  FROM events)"""


def cost_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("model_id"),
        F.col("l_linestatus").alias("stage"),
        F.col("l_quantity").cast("int").alias("input_tokens"),
        (F.col("l_quantity") * 2).cast("int").alias("output_tokens"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("cost_usd"),
        F.col("l_extendedprice").alias("latency_ms"),
    )


COST = """cost AS (
  SELECT l_returnflag AS model_id, l_linestatus AS stage, CAST(l_quantity AS INTEGER) AS input_tokens,
    CAST(l_quantity * 2 AS INTEGER) AS output_tokens, l_extendedprice * (1 - l_discount) AS cost_usd,
    l_extendedprice AS latency_ms
  FROM lineitem)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the engine's shape; ids are those of the table."""
    d = load(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("source_type"), "lang")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").alias("source_type"))
