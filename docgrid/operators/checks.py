"""Arithmetic of item lines, which needs no truth to compare with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def arithmetic(items: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """quantity times price, less the discount, against the amount: ok, falla, or incompleta."""
    discount = F.when((F.col("descuento_pct") == 0) | F.col("descuento_pct").isNull(), F.lit(1.0)).otherwise(1 - F.col("descuento_pct") / 100)
    due = F.col("cantidad") * F.col("precio_unitario") * discount
    t = items.withColumn("esperado", due).withColumn("dif", F.col("importe") - F.col("esperado"))
    # NaN compares as the largest number here: it must not pass
    allowed = F.lit(tolerance) * F.abs("importe")
    near = ~F.isnan("dif") & (F.abs("dif") <= F.when(F.isnan(allowed) | (allowed < 0.02), F.lit(0.02)).otherwise(allowed))
    state = F.when(F.col("dif").isNull(), "incompleta").when(near, "ok").otherwise("falla")
    return t.select("doc_id", "i", "codigo", "cantidad", F.col("precio_unitario").alias("precio"), "importe", "esperado", "dif", state.alias("estado"))


def state_counts(checked: DataFrame) -> DataFrame:
    return checked.groupBy("estado").agg(F.count(F.lit(1)).alias("n"))
