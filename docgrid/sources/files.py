"""Readers: saved reader results, hand-made truth, images. Paths are anything that Spark reads."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.operators.boxes import RESULT
from docgrid.operators.truth import EXCLUDED


def _stem(path: str = "path"):
    return F.regexp_replace(F.substring_index(F.col(path), "/", -1), r"\.[^.]*$", "")


def ocr_results(spark: SparkSession, path: str, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """doc_id (name before the first `_`), rec_polys, rec_texts, rec_scores of `*_res.json`; results wrapped in `res` are unwrapped; a file without one of the three is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_res.json").load(path)
    t = files.select(F.substring_index(_stem(), "_", 1).alias("doc_id"), F.decode("content", "UTF-8").alias("text")).where(~F.col("doc_id").isin(*excluded))
    parsed = t.select("doc_id", F.from_json("text", RESULT).alias("bare"), F.from_json("text", f"struct<res:{RESULT}>").alias("wrapped"))
    keys = ("rec_polys", "rec_texts", "rec_scores")
    got = parsed.select("doc_id", *(F.coalesce(F.col(f"wrapped.res.{k}"), F.col(f"bare.{k}")).alias(k) for k in keys))
    missing = F.concat_ws(", ", *(F.when(F.col(k).isNull(), F.lit(k)) for k in keys))
    whole = F.when(missing == "", F.col("rec_polys")).otherwise(F.raise_error(F.concat(F.lit("the result of "), F.col("doc_id"), F.lit(" lacks "), missing)).cast("array<array<array<double>>>"))
    return got.select("doc_id", whole.alias("rec_polys"), "rec_texts", "rec_scores")


def truth_files(spark: SparkSession, path: str, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """doc_id (stem), archivo, text of `*.json` that are not empty."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).where("length > 0")
    t = files.select(_stem().alias("doc_id"), F.substring_index("path", "/", -1).alias("archivo"), F.decode("content", "UTF-8").alias("text"))
    return t.where(~F.col("doc_id").isin(*excluded)) if excluded else t


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, content."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def decoded_images(spark: SparkSession, path: str) -> DataFrame:
    """path, height, width, n_channels, data: decoded in the JVM."""
    return spark.read.format("image").load(path).select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("n_channels"), "image.data").withColumnRenamed("origin", "path")


def crops(spark: SparkSession, path: str) -> DataFrame:
    """Saved crops, the newest first; empty if there is no such folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "path string, modificationTime timestamp")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)
    return files.select("path", "modificationTime").orderBy(F.col("modificationTime").desc(), "path")


def folders() -> dict[str, str]:
    """Where results, truth and output lie, from the environment."""
    return {k: os.environ.get(k, d) for k, d in (("DIR_OCR", "../imagenes/respuestaGenerada1"), ("DIR_GT", "../imagenes/respuestaEsperada"), ("DIR_SALIDA", "../imagenes/respuestaPipeline"))}
