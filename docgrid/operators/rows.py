"""Boxes to rows: residual tilt, row pitch, running-mean chaining.

A page's boxes are gathered once, by doc_id; all that follows works on that array, so there is one exchange.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrid.session import importable

HEIGHT_SHARE = 0.6
PITCH_SHARE = 0.65
SLOPE_MAX, SLOPE_STEP = 0.02, 0.0002
LAG_MIN, LAG_MAX = 8, 400
BOX = ("box_id", "x0", "x1", "y", "height", "score", "txt")


def pages(boxes: DataFrame) -> DataFrame:
    """doc_id, b (boxes by box_id), median_height."""
    return boxes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*BOX))).alias("b"), F.percentile("height", F.lit(0.5)).alias("median_height"))


def compact_slope(x: np.ndarray, y: np.ndarray, tol: float, top: float = SLOPE_MAX, step: float = SLOPE_STEP) -> float:
    """The slope on a grid that leaves the rows of `chain` most compact (least sum of their spreads); the first of equal ones. All slopes go through the boxes together."""
    grid = np.arange(-top, top + step / 2, step)
    levels = np.sort(y[None, :] - grid[:, None] * (x - x.mean())[None, :], axis=1)
    total, n, low, high = levels[:, 0].copy(), np.ones(len(grid)), levels[:, 0], levels[:, 0]
    cost = np.zeros(len(grid))
    for v in levels[:, 1:].T:
        joins = np.abs(v - total / n) <= tol
        cost += np.where(joins, 0.0, high - low)
        total, n, low, high = np.where(joins, total + v, v), np.where(joins, n + 1, 1.0), np.where(joins, low, v), v
    return float(grid[int(np.argmin(cost + (high - low)))])


def row_distance(level: np.ndarray, least: int = LAG_MIN, most: int = LAG_MAX) -> int | None:
    """The lag with the largest autocorrelation of the histogram of centres, the least of equal ones; None if there is too little to see.
    In whole numbers: with length L and N boxes, L^2 times the mean-centred value, so equal lags are equal."""
    at = np.rint(level - level.min()).astype(np.int64)
    height, boxes = int((level - level.min()).max()) + 1, len(at)
    length = height + 2
    end = min(most, length - 1)
    if height < 2 * least or end <= least:
        return None
    lags = np.arange(least, end)
    values, counts = np.unique(at, return_counts=True)
    apart = (values[None, :] - values[:, None]).ravel()
    together = np.zeros(length, np.int64)
    np.add.at(together, apart[apart > 0], np.outer(counts, counts).ravel()[apart > 0])
    sides = np.searchsorted(np.sort(at), length - lags) + boxes - np.searchsorted(np.sort(at), lags)
    return int(lags[np.argmax(length**2 * together[lags] - boxes * length * sides + boxes**2 * (length - lags))])


def slope(b: Column, tol: Column, top: float = SLOPE_MAX, step: float = SLOPE_STEP) -> Column:
    """compact_slope of an array of boxes. As nested folds of expressions it costs some ten times as much."""

    @F.pandas_udf("double")
    def estimate(xs: pd.Series, ys: pd.Series, tols: pd.Series) -> pd.Series:
        return pd.Series([compact_slope(np.asarray(x, float), np.asarray(y, float), t, top, step) for x, y, t in zip(xs, ys, tols, strict=True)])

    return estimate(F.transform(b, lambda c: (c["x0"] + c["x1"]) / 2), F.transform(b, lambda c: c["y"]), tol)


def pitch(yp: Column, least: int = LAG_MIN, most: int = LAG_MAX) -> Column:
    """row_distance of an array of centres."""

    @F.pandas_udf("int")
    def estimate(levels: pd.Series) -> pd.Series:
        return pd.Series([row_distance(np.asarray(v, float), least, most) for v in levels], dtype="Int32")

    return estimate(yp)


def chain(yp: Column, tol: Column) -> Column:
    """Row number of each of ascending values."""
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(-1).alias("row"), F.array().cast("array<int>").alias("rows"))

    def step(a: Column, v: Column) -> Column:
        joins = (a["n"] > 0) & (F.abs(v - a["sum"] / a["n"]) <= tol)
        row = F.when(joins, a["row"]).otherwise(a["row"] + 1)
        return F.struct(F.when(joins, a["sum"] + v).otherwise(v).alias("sum"), F.when(joins, a["n"] + 1).otherwise(F.lit(1)).alias("n"), row.alias("row"), F.concat(a["rows"], F.array(row)).alias("rows"))

    return F.aggregate(yp, zero, step, lambda a: a["rows"])


def measured(boxes: DataFrame, tol: float | None = None, b: float | None = None) -> DataFrame:
    """Pages with slope, pitch and tol. b=None estimates the slope, b=0.0 leaves it out."""
    importable(boxes.sparkSession)
    p = pages(boxes).withColumn("by_height", F.lit(HEIGHT_SHARE) * F.col("median_height"))
    p = p.withColumn("slope", F.lit(float(b)) if b is not None else slope(F.col("b"), F.col("by_height")))
    level = F.array_sort(F.transform("b", lambda x: F.struct((x["y"] - F.col("slope") * (x["x0"] + x["x1"]) / 2).alias("yp"), x["box_id"].alias("box_id"), x["x0"].alias("x0"), x["x1"].alias("x1"), x["y"].alias("y"), x["height"].alias("height"), x["score"].alias("score"), x["txt"].alias("txt"))))
    p = p.withColumn("level", level).drop("b")
    p = p.withColumn("pitch", pitch(F.transform("level", lambda x: x["yp"])))
    fitted = F.when(F.col("pitch") > 0, F.least("by_height", F.lit(PITCH_SHARE) * F.col("pitch"))).otherwise(F.col("by_height"))
    return p.withColumn("tol", F.lit(float(tol)) if tol is not None else fitted)


def group_rows(boxes: DataFrame, tol: float | None = None, b: float | None = None) -> DataFrame:
    """Boxes with row_id (from the top) and pos (from the left)."""
    p = measured(boxes, tol, b)
    p = p.withColumn("rows", chain(F.transform("level", lambda x: x["yp"]), F.col("tol")))
    flat = p.select("doc_id", F.explode(F.arrays_zip("level", "rows")).alias("z")).select("doc_id", "z.level.*", F.col("z.rows").alias("row_id"))
    w = Window.partitionBy("doc_id", "row_id").orderBy("x0", "yp", "box_id")
    return flat.withColumn("pos", F.row_number().over(w) - 1)


def row_cells(rows: DataFrame) -> DataFrame:
    """doc_id, row_id, cells: the texts of each row from the left. As many cells as the row has boxes."""
    g = rows.groupBy("doc_id", "row_id").agg(F.array_sort(F.collect_list(F.struct("pos", "txt"))).alias("c"))
    return g.select("doc_id", "row_id", F.transform("c", lambda x: x["txt"]).alias("cells"))


def row_grid(rows: DataFrame, columns: int) -> DataFrame:
    """row_cells as columns c0, c1, ..; missing cells are null."""
    return row_cells(rows).select("doc_id", "row_id", *(F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(columns)))


def row_text(rows: DataFrame) -> DataFrame:
    return row_cells(rows).select("doc_id", "row_id", F.array_join("cells", " | ").alias("texto"))
