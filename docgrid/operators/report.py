"""Reports: what came out, how right it is, and what to look at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.schema import ESSENTIAL, SECTIONS


def summary(extracted: DataFrame, row_counts: DataFrame, checked: DataFrame, compared: DataFrame, truth_counts: DataFrame) -> DataFrame:
    """By page: rows(doc_id, filas_ocr), items, expected items(doc_id, esperados), conflicts, lines that add up, and of each essential field the exact and lax share and both as text."""
    ok = checked.groupBy("doc_id").agg(F.count_if(F.col("estado") == "ok").alias("arit_ok"))
    wide = compared.groupBy("doc_id").pivot("campo", list(ESSENTIAL)).agg(F.first("exacta").alias("exacta"), F.first("laxa").alias("laxa"))
    base = extracted.select("doc_id", F.size("items").alias("items"), F.size("avisos.conflictos").alias("conflictos"))
    t = base.join(row_counts, "doc_id", "left").join(truth_counts, "doc_id", "left").join(ok, "doc_id", "left").join(wide, "doc_id", "left").na.fill(0, ["arit_ok"])

    def shown(f: str):
        e, x = F.col(f"{f}_exacta"), F.col(f"{f}_laxa")
        return F.when(e == x, e.cast("string")).otherwise(F.concat(e.cast("string"), F.lit(" ("), x.cast("string"), F.lit(")"))).alias(f)

    return t.select("doc_id", "filas_ocr", "items", "esperados", "conflictos", "arit_ok", *(shown(f) for f in ESSENTIAL), *(f"{f}_{k}" for f in ESSENTIAL for k in ("exacta", "laxa")))


def notices(extracted: DataFrame, most: int = 8, width: int = 140) -> DataFrame:
    """The lines of a page's diagnosis, in order; an error stands alone."""
    a = F.col("avisos")
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, ESSENTIAL)), a["esenciales"]))

    def some(c, line):
        return F.when(F.size(c) > 0, F.array(line)).otherwise(F.array().cast("array<string>"))

    grid = F.transform(F.map_entries(a["mapa"]), lambda e: F.concat(F.lit("   "), F.lpad(e["key"], 22, " "), F.lit("  "), F.coalesce(e["value"], F.lit("(columna sin nombre)"))))
    lines = F.concat(
        F.array(F.concat(F.lit("títulos leídos: "), listed(a["encabezado"])), F.concat(F.lit("columnas según "), a["origen_grilla"], F.lit(" — nombres según "), a["origen_mapa"])),
        grid,
        some(missing, F.concat(F.lit("faltan columnas para: "), listed(missing))),
        F.coalesce(F.transform(a["titulos_partidos"], lambda t: F.concat(F.lit("un título por varias columnas: '"), t["texto"], F.lit("' -> "), listed(t["en"]))), F.array().cast("array<string>")),
        some(a["titulos_sin_datos"], F.concat(F.lit("títulos de columnas vacías: "), listed(a["titulos_sin_datos"]))),
        some(a["titulos_sin_columna"], F.concat(F.lit("títulos sin columna propia: "), listed(a["titulos_sin_columna"]))),
        some(a["conflictos"], F.concat(F.lit("filas con celdas dobles ("), F.size(a["conflictos"]).cast("string"), F.lit("), quizá unidas:"))),
        F.transform(F.slice(a["conflictos"], 1, most), lambda c: F.concat(F.lit("   fila "), c["fila"].cast("string"), F.lit(" -> "), F.array_join(c["detalle"], "; "))),
        some(a["descartadas"], F.concat(F.lit("renglones que no son items ("), F.size(a["descartadas"]).cast("string"), F.lit("):"))),
        F.transform(F.slice(a["descartadas"], 1, most), lambda d: F.concat(F.lit("    "), F.substring(d, 1, width))),
    )
    return extracted.select("doc_id", F.when(a["error"].isNotNull(), F.array(F.concat(F.lit("error: "), a["error"]))).otherwise(lines).alias("lineas"))


def documents(extracted: DataFrame) -> DataFrame:
    """doc_id and the canonical document as JSON, nulls kept: pages give items, the sections stay empty."""
    sections = {s: F.struct(*(F.lit(None).cast("double" if s == "totales" else "string").alias(f) for f in fs)).alias(s) for s, fs in SECTIONS.items()}
    doc = F.struct(*sections.values(), F.col("items"))
    return extracted.select("doc_id", F.to_json(doc, {"ignoreNullFields": "false", "pretty": "true"}).alias("value"))


def write_documents(extracted: DataFrame, path: str) -> None:
    """One JSON document per row, beside its doc_id: as many files as tasks, however many the documents. Compressed: most of a document are names of fields without values."""
    documents(extracted).write.mode("overwrite").option("compression", "gzip").json(path)
