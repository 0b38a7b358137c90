"""Scans with pruned columns, and the conversation view of the synthetic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet scan; the columns that a query selects are the only ones it reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, records: int = 512) -> None:
    """Arrow batches of at most 512 rows and 16 MB for the session, as a lazy plan runs under what holds then; smaller values of the caller stay.

    By default a batch holds 10,000 rows: of texts, hundreds of MB for each task, in the JVM and in its Python worker.
    """
    for name, most in (("maxRecordsPerBatch", records), ("maxBytesPerBatch", 16 << 20)):
        have = str(spark.conf.get(f"spark.sql.execution.arrow.{name}")).removesuffix("b")
        if not (have.isdigit() and 0 < int(have) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", most)


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as a reply chain: id is conversation.turn, each turn replies to the one before."""
    c = table(spark, sf_dir, "conversations")
    dot = lambda t: F.concat_ws(".", F.col("conv_id").cast("string"), t.cast("string"))
    return c.select("conv_id", "turn", dot(F.col("turn")).alias("id"), F.when(F.col("turn") > 0, dot(F.col("turn") - 1)).alias("reply_to"), "role", "text")


#: The same view for the oracle.
UTTERANCES = """utt AS (
  SELECT conv_id, turn, conv_id::VARCHAR || '.' || turn::VARCHAR AS id,
         CASE WHEN turn > 0 THEN conv_id::VARCHAR || '.' || (turn - 1)::VARCHAR END AS reply_to, role, text
  FROM conversations)"""
