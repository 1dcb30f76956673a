"""Helpers shared by the corpus operators: shared folders, shipping code, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker turns into arrays at a time.
CHUNK_BYTES = 1 << 20


#: Workers live on between tasks: blocks of 1 MB and more go back to the system as they are freed, in Arrow too.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(1 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and give memory back."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    env.update(WORKER_MEMORY)
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a default only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "/tmp/docgrid-checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


#: With this a query's shuffle files go when it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written in here leaves no shuffle files behind: nothing reads them again, as the table is read back."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def materialise(df: DataFrame, name: str, compression: str = "lz4") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/docgrid-{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.select("*").write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `limit` bytes of `column`, one row at least."""
    for batch in batches:
        at, size, sizes = 0, 0, pc.binary_length(batch.column(column)).to_pylist()
        for i, n in enumerate(sizes):
            if i > at and size + (n or 0) > limit:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += n or 0
        if at < batch.num_rows:
            yield batch.slice(at)


def map_text(df: DataFrame, text: str, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """Apply `f` to Arrow batches of bounded text."""
    importable(df.sparkSession)

    def run(batches):
        for part in sliced(batches, text, limit):
            yield f(part)

    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that `df` does not have yet (names compare without case)."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def row_key(text: str = "text", doc_id: str = "doc_id") -> F.Column:
    """Rows with the same key have the same id and text, so any verdict on the text holds for both."""
    return F.struct(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("a"), F.crc32(F.encode(F.col(text), "UTF-8")).alias("b"))


def without_columns(df: DataFrame, *names: str) -> DataFrame:
    """Room for new columns: those that have their names (without case) go."""
    gone = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in gone)) if gone & {c.lower() for c in df.columns} else df


#: Keys up to this number (some MB) are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 200_000


def without_rows(df: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of `df` whose (doc_id, text) is not in dropped(id, a, b); null ids and texts compare equal."""
    k = free_name(df, "row_key")
    left = df.withColumn(k, row_key())
    right = materialise(dropped.select(F.col("id").cast("long").alias("drop_id"), F.col("a").alias("drop_a"), F.col("b").alias("drop_b")), "dropped")
    right = F.broadcast(right) if right.count() <= BROADCAST_KEYS else right.hint("shuffle_hash")
    on = left[k]["id"].eqNullSafe(right["drop_id"]) & left[k]["a"].eqNullSafe(right["drop_a"]) & left[k]["b"].eqNullSafe(right["drop_b"])
    return left.join(right, on, "left_anti").drop(k)
