"""Items against the truth: lines are paired by code, then in order; fields are judged."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgrid.functions.text import folded_upper
from docgrid.functions.values import round2
from docgrid.schema import ESSENTIAL, ITEM_FIELDS, ITEM_NUMBERS


def _side(items: DataFrame, side: int) -> DataFrame:
    code = F.nullif(folded_upper(F.col("codigo")), F.lit(""))
    return items.select("doc_id", F.lit(side).alias("side"), F.struct("i", F.struct(*ITEM_FIELDS).alias("x")).alias("line"), code.alias("code"))


def pairs(read: DataFrame, truth: DataFrame) -> DataFrame:
    """doc_id, i_read, i_truth, read, truth, por: the k-th line of a code with the k-th true line of it, then the leftovers of both sides in order. Lines that find no partner have nulls on the other side (por is null).
    Both sides are one table that is dealt by page once; a line's partner is found by its place within its code, or within the leftovers."""
    t = _side(read, 0).unionByName(_side(truth, 1)).repartition("doc_id")
    t = t.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "side", "code").orderBy("line.i")))
    same = Window.partitionBy("doc_id", "code", "k")
    t = t.withColumn("coded", F.col("code").isNotNull() & (F.min("side").over(same) != F.max("side").over(same)))
    place = F.row_number().over(Window.partitionBy("doc_id", "side", "coded").orderBy("line.i"))
    t = t.withColumn("place", F.when(F.col("coded"), F.col("k")).otherwise(place)).withColumn("of", F.when(F.col("coded"), F.col("code")))
    both = t.groupBy("doc_id", "of", "place").agg(*(F.first(F.when(F.col("side") == n, F.col("line")), ignorenulls=True).alias(name) for n, name in enumerate(("r", "t"))))
    por = F.when(F.col("of").isNotNull(), "codigo").when(F.col("r").isNotNull() & F.col("t").isNotNull(), "orden")
    return both.select("doc_id", F.col("r.i").alias("i_read"), F.col("t.i").alias("i_truth"), F.col("r.x").alias("read"), F.col("t.x").alias("truth"), por.alias("por"))


def unmatched(paired: DataFrame) -> DataFrame:
    """Lines by page: matched, and without partner on either side."""
    return paired.groupBy("doc_id").agg(
        F.count_if(F.col("por").isNotNull()).alias("emparejados"), F.count_if(F.col("truth").isNull()).alias("sin_emparejar_pipeline"), F.count_if(F.col("read").isNull()).alias("sin_emparejar_truth")
    )


def judged(paired: DataFrame, fields: tuple[str, ...] = ESSENTIAL) -> DataFrame:
    """One row per matched line and field with a true value: ok, contiene (the truth with something around it), mal, or faltante. A pair's fields are exploded, so the pairing is computed once."""

    def cell(f: str):
        read, truth = F.col(f"read.{f}"), F.col(f"truth.{f}")
        number, text = (lambda c: c.cast("double") if f in ITEM_NUMBERS else F.lit(None).cast("double")), (lambda c: F.lit(None).cast("string") if f in ITEM_NUMBERS else c)
        return F.struct(F.lit(f).alias("campo"), number(read).alias("n_read"), number(truth).alias("n_truth"), text(read).alias("s_read"), text(truth).alias("s_truth"), truth.cast("string").alias("esperado"), read.cast("string").alias("leido"))

    p = paired.where("por is not null and truth is not null and read is not null")
    t = p.select("doc_id", "i_read", "i_truth", F.col("truth.codigo").alias("codigo"), F.explode(F.array(*map(cell, fields))).alias("c")).select("doc_id", "i_read", "i_truth", "codigo", "c.*")
    t = t.where("esperado is not null")
    t = t.withColumns({"a": round2("n_read"), "b": round2("n_truth"), "f": folded_upper(F.col("s_read")), "g": folded_upper(F.col("s_truth"))})
    numeric = F.col("n_truth").isNotNull()
    missing = F.when(numeric, F.col("a").isNull()).otherwise(F.col("f").isNull())
    equal = F.when(numeric, F.col("a") == F.col("b")).otherwise(F.col("f") == F.col("g"))
    verdict = F.when(missing, "faltante").when(equal, "ok").when(~numeric & F.contains(F.col("f"), F.col("g")), "contiene").otherwise("mal")
    return t.select("doc_id", "i_read", "i_truth", "campo", "esperado", "leido", "codigo", verdict.alias("juicio"))


def accuracy(verdicts: DataFrame, docs: DataFrame, fields: tuple[str, ...] = ESSENTIAL) -> DataFrame:
    """Counts and shares by page and field; every page of docs(doc_id) has every field."""
    n = {k: F.count_if(F.col("juicio") == k).alias(k) for k in ("ok", "contiene", "mal", "faltante")}
    counted = verdicts.groupBy("doc_id", "campo").agg(*n.values())
    every = docs.select("doc_id").distinct().withColumn("campo", F.explode(F.array(*map(F.lit, fields))))
    t = every.join(counted, ["doc_id", "campo"], "left").na.fill(0, list(n))
    total = F.greatest(F.lit(1), F.col("ok") + F.col("contiene") + F.col("mal") + F.col("faltante"))
    return t.withColumn("exacta", F.round(F.col("ok") / total, 3)).withColumn("laxa", F.round((F.col("ok") + F.col("contiene")) / total, 3))


def errors(verdicts: DataFrame) -> DataFrame:
    """Fields that were read wrong; missing ones are not errors."""
    return verdicts.where(F.col("juicio").isin("contiene", "mal")).select("doc_id", "campo", "esperado", "leido", "codigo")
