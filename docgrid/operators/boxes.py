"""Text boxes from a reader's polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "struct<rec_polys:array<array<array<double>>>,rec_texts:array<string>,rec_scores:array<double>>"


def boxes(results: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, box_id, x0, x1, y (mean of the corners), height, score, txt of results(doc_id, rec_polys, rec_texts, rec_scores). Lists of unequal length stop at the shortest."""
    n = F.least(F.size("rec_polys"), F.size("rec_texts"), F.size("rec_scores"))
    cut = [F.slice(c, F.lit(1), n).alias(c) for c in ("rec_polys", "rec_texts", "rec_scores")]
    rows = results.select(F.col(doc_id).cast("string").alias("doc_id"), F.posexplode(F.arrays_zip(*cut)).alias("box_id", "b"))
    xs, ys = (F.transform(F.col("b.rec_polys"), lambda p: p[0]), F.transform(F.col("b.rec_polys"), lambda p: p[1]))
    return rows.select(
        "doc_id",
        "box_id",
        F.array_min(xs).alias("x0"),
        F.array_max(xs).alias("x1"),
        (F.aggregate(ys, F.lit(0.0), lambda a, y: a + y) / F.size(ys)).alias("y"),
        (F.array_max(ys) - F.array_min(ys)).alias("height"),
        F.col("b.rec_scores").alias("score"),
        F.col("b.rec_texts").alias("txt"),
    )


def result_boxes(results: DataFrame) -> DataFrame:
    """boxes of results(doc_id, res)."""
    return boxes(results.select("doc_id", "res.*"))


def edge_boxes(results: DataFrame, near: int = 3) -> DataFrame:
    """Boxes that touch the border of results(doc_id, width, height, rec_polys, rec_texts): first characters may be cut off there."""
    rows = results.select("doc_id", "width", "height", F.posexplode(F.arrays_zip("rec_polys", "rec_texts")).alias("box_id", "b"))
    xs, ys = F.transform(F.col("b.rec_polys"), lambda p: p[0]), F.transform(F.col("b.rec_polys"), lambda p: p[1])
    rows = rows.select("doc_id", "box_id", "width", "height", F.col("b.rec_texts").alias("texto"), *(f(v).alias(n) for f, v, n in ((F.array_min, xs, "x0"), (F.array_max, xs, "x1"), (F.array_min, ys, "y0"), (F.array_max, ys, "y1"))))
    sides: list[tuple[str, Column]] = [
        ("izq", F.col("x0") <= near),
        ("arriba", F.col("y0") <= near),
        ("der", F.col("x1") >= F.col("width") - near),
        ("abajo", F.col("y1") >= F.col("height") - near),
    ]
    touched = F.array_compact(F.array(*(F.when(c, s) for s, c in sides)))
    return rows.withColumn("touched", touched).where(F.size("touched") > 0).select("doc_id", "box_id", "texto", F.array_join("touched", ",").alias("toca"), F.col("x0").cast("int").alias("x0"), F.col("x1").cast("int").alias("x1"))


def texts_by_score(box_table: DataFrame) -> DataFrame:
    """What was read, the least certain first."""
    return box_table.select("doc_id", F.col("txt").alias("texto"), "score").orderBy("score", "doc_id", "box_id")
