"""The column grid, found in the data: where no row has text.

Bands are arrays of (left, right) per page, few and ordered, so boxes find theirs without a join of boxes to bands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_GAP = 3.0
COVERAGE_SHARE = 0.15
TITLE_SHARE = 0.15
SPLIT_SHARE, SPLIT_DEVIATION = 0.7, 0.05
BANDS = "array<struct<left:double,right:double>>"


def coverage(rows: DataFrame) -> DataFrame:
    """doc_id, start, end (inclusive pixels), n: runs of pixels and in how many rows they are covered. A sweep over the ends of each row's merged intervals."""
    cells = rows.select("doc_id", "row_id", F.col("x0").cast("long").alias("a"), F.col("x1").cast("long").alias("b")).where("b >= a")
    w = Window.partitionBy("doc_id", "row_id").orderBy("a", "b")
    reached = cells.withColumn("reach", F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    runs = reached.withColumn("run", F.sum(F.when(F.col("a") <= F.col("reach") + 1, 0).otherwise(1)).over(w))
    merged = runs.groupBy("doc_id", "row_id", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    ends = merged.select("doc_id", F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("d")), F.struct((F.col("b") + 1).alias("x"), F.lit(-1).alias("d")))).alias("e")).groupBy("doc_id", F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy("doc_id").orderBy("x")
    return ends.select("doc_id", F.col("x").alias("start"), (F.lead("x").over(w) - 1).alias("end"), F.sum("d").over(w).alias("n")).where("end is not null")


def data_bands(rows: DataFrame, min_gap: float = MIN_GAP, share: float = COVERAGE_SHARE) -> DataFrame:
    """doc_id, band_id, left, right: runs covered in more rows than the threshold (none for one or two rows, else a share of them), put together over gaps that are too thin."""
    n = rows.groupBy("doc_id").agg(F.countDistinct("row_id").alias("rows"))
    least = F.when(F.col("rows") <= 2, 0).otherwise(F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("rows")).cast("int")))
    full = coverage(rows).join(n, "doc_id").where(F.col("n") > least)
    w = Window.partitionBy("doc_id").orderBy("start")
    gap = F.col("start") - F.lag("end").over(w)
    part = full.withColumn("new", F.when(gap.isNull() | (gap >= max(min_gap, 2.0)), 1).otherwise(0))
    part = part.withColumn("band_id", F.sum("new").over(w) - 1)
    return part.groupBy("doc_id", "band_id").agg(F.min("start").cast("double").alias("left"), F.max("end").cast("double").alias("right"))


def split_bands(bands: DataFrame, rows: DataFrame, share: float = SPLIT_SHARE, deviation: float = SPLIT_DEVIATION) -> DataFrame:
    """Bands that are two or more columns whose boxes touch are cut. k is the usual number of a row's boxes in the band; of the rows with two or more, the share with k must be large, and each of their k - 1 cuts must lie about where it lies in the others."""
    over = F.least(F.col("x1"), F.col("right")) - F.greatest(F.col("x0"), F.col("left"))
    inside = rows.select("doc_id", "row_id", "pos", "x0", "x1").join(bands, "doc_id").where(over > 0)
    w = Window.partitionBy("doc_id", "band_id", "row_id").orderBy("x0", "pos")
    inside = inside.withColumn("next", F.lead("x0").over(w)).withColumn("cut", F.row_number().over(w) - 1).withColumn("boxes", F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    by_row = inside.where("cut = 0").groupBy("doc_id", "band_id").agg(F.mode("boxes", True).alias("k"), F.count_if(F.col("boxes") >= 2).alias("several"), F.collect_list("boxes").alias("counts"))
    by_row = by_row.withColumn("useful", F.size(F.filter("counts", lambda x: x == F.col("k"))))
    fit = by_row.where((F.col("k") >= 2) & (F.col("useful") >= F.lit(share) * F.col("several"))).select("doc_id", "band_id", "k")
    cuts = inside.join(fit, ["doc_id", "band_id"]).where((F.col("boxes") == F.col("k")) & F.col("next").isNotNull()).groupBy("doc_id", "band_id", "left", "right", "cut").agg(F.avg((F.col("x1") + F.col("next")) / 2).alias("at"), F.stddev_pop((F.col("x1") + F.col("next")) / 2).alias("sd"))
    stable = cuts.groupBy("doc_id", "band_id").agg(F.array_sort(F.collect_list(F.struct("cut", "at"))).alias("cuts"), F.max(F.col("sd") > deviation * (F.col("right") - F.col("left"))).alias("loose")).where("not loose")
    edges = bands.join(stable, ["doc_id", "band_id"], "left").withColumn("e", F.concat(F.array("left"), F.coalesce(F.transform("cuts", lambda c: c["at"]), F.array().cast("array<double>")), F.array("right")))
    pieces = edges.select("doc_id", "band_id", F.posexplode(F.arrays_zip(F.slice("e", F.lit(1), F.size("e") - 1).alias("left"), F.slice("e", F.lit(2), F.size("e") - 1).alias("right"))).alias("piece", "p"))
    w = Window.partitionBy("doc_id").orderBy("band_id", "piece")
    return pieces.select("doc_id", (F.row_number().over(w) - 1).alias("band_id"), F.col("p.left").alias("left"), F.col("p.right").alias("right"))


def band_arrays(bands: DataFrame) -> DataFrame:
    """doc_id, bands in order."""
    g = bands.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("band_id", "left", "right"))).alias("b"))
    return g.select("doc_id", F.transform("b", lambda x: F.struct(x["left"].alias("left"), x["right"].alias("right"))).alias("bands"))


def header_bands(titles: Column) -> Column:
    """Bands from a header row (array of structs with x0, by x0): each from its start to the next one's, the outer ones open."""
    inf = F.lit(float("inf"))
    return F.transform(titles, lambda t, i: F.struct(F.when(i == 0, -inf).otherwise(t["x0"]).alias("left"), F.coalesce(F.get(titles, i + 1)["x0"], inf).alias("right")))


def nearest_band(x0: Column, x1: Column, bands: Column) -> Column:
    """struct(overlap, back): the band with the largest overlap, negative in a gap; the first of equal ones. The band is -back; null without bands."""
    return F.array_max(F.transform(bands, lambda b, i: F.struct((F.least(x1, b["right"]) - F.greatest(x0, b["left"])).alias("overlap"), (-i).alias("back"))))


def touched_bands(x0: Column, x1: Column, bands: Column, share: float = TITLE_SHARE) -> Column:
    """The bands that a title rests on with a fair share of its own width."""
    least = F.greatest(F.lit(1.0), F.lit(share) * (x1 - x0))
    on = F.transform(bands, lambda b, i: F.when(F.least(x1, b["right"]) - F.greatest(x0, b["left"]) >= least, i))
    return F.array_compact(on)


def edge_text(v: Column) -> Column:
    whole = F.bround(v, 0).cast("long").cast("string")
    return F.when(F.abs(v) == float("inf"), "·").otherwise(whole)


def readable_map(bands: Column, names: Column) -> Column:
    """`k [left,right]` to field; names is an array of fields by band."""
    keys = F.transform(bands, lambda b, i: F.concat(i.cast("string"), F.lit(" ["), edge_text(b["left"]), F.lit(","), edge_text(b["right"]), F.lit("]")))
    return F.map_from_arrays(keys, F.transform(bands, lambda b, i: F.get(names, i)))
