"""Sinks (S4–S8, S10): Parquet stage boundaries, CSV output, JSON side-cars.

Everything is written with ``mode("overwrite")`` — a rerun replaces, never
appends.  Scratch locations live under the cluster's checkpoint folder.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..session import ensure_checkpoint_dir


def scratch_dir(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Feature tables; partition by window for pruning by horizon."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with header; one file only when asked (coalesce(1) funnels the
    output through one task, so it is opt-in for small outputs)."""
    if single_file:
        df = df.coalesce(1)
    df.write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Re-read an output CSV keeping blanks as '' and coercing numbers."""
    raw = spark.read.option("header", "true").schema(
        ", ".join(f"`{c}` string" for c in S.OUTPUT_COLUMNS)).csv(path)
    out = raw.na.fill("", ["channel", "campaign_type", "campaign"])
    return out.select(
        "level", "channel", "campaign_type", "campaign",
        F.col("window_days").try_cast("int").alias("window_days"),
        *[F.col(c).try_cast("double").alias(c) for c in S.REVENUE_Q + S.ROAS_Q],
    )


def write_json(df: DataFrame, path: str) -> None:
    """Profile and guard report side-cars (one small row)."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A side-car with the columns of ``like``."""
    return spark.read.schema(like.schema).json(path)


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """S4 stage boundary: write ``df`` as Parquet under the shared checkpoint
    folder and read it back (survives executor loss, cuts lineage)."""
    path = scratch_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
