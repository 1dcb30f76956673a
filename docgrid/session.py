"""What the engine needs from a session: code on the workers, and a folder that all executors share."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a default only where none is set."""
    return (spark.conf.get("spark.checkpoint.dir", None) or "/tmp/docgrid-checkpoints").rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: a table that is read several times is computed once, and a lost executor takes nothing with it."""
    path = f"{shared_dir(df.sparkSession)}/docgrid-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
