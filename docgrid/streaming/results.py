"""Reader results as a stream: each file is one whole page, so items need no state and no watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.operators import boxes, items, rows
from docgrid.operators.boxes import RESULT
from docgrid.session import stored


def result_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """doc_id, res of `*_res.json` files as they arrive, one JSON object per file."""
    files = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*_res.json").option("maxFilesPerTrigger", files_per_batch).load(path)
    name = F.substring_index(F.substring_index(F.col("_metadata.file_path"), "/", -1), "_", 1)
    return files.select(name.alias("doc_id"), F.coalesce(F.from_json("value", f"struct<res:{RESULT}>")["res"], F.from_json("value", RESULT)).alias("res"))


def items_of_batch(results: DataFrame) -> DataFrame:
    """(doc_id, items, avisos) of a batch of whole pages."""
    return items.extract(stored(rows.group_rows(boxes.result_boxes(results)), "rows"))


def write_items(results: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Start the stream: every batch goes through the engine to the sink, once by batch number."""
    return results.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: sink(items_of_batch(df), n)).trigger(availableNow=True).start()
