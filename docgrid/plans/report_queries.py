"""Queries over reports, tilted pages, band cuts, crops and titles named by a model, with their SQL; as in queries, the SQL finds the answer from the tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.functions import bbox
from docgrid.operators import boxes, checks, compare, grid, pages, report, rows
from docgrid.plans import synth
from docgrid.plans.pipeline import item_table
from docgrid.plans.queries import ALL_JUDGED, LINES, MONEY, _cents, _pairs, _parts
from docgrid.plans.synth import table
from docgrid.schema import ESSENTIAL
from docgrid.session import shared_dir, stored


def accuracy_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and shares of every page and field, pages without a matched line too."""
    docs = synth.true_lines(synth.order_lines(spark, sf_dir)).select("doc_id")
    return compare.accuracy(compare.judged(_pairs(spark, sf_dir)), docs)


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report by page over all invoices, read and compared with their lines."""
    found = stored(pages.pages(_parts(spark, sf_dir), "filas", "items", "conflictos", b=0.0), "items")
    read, true = item_table(found), synth.true_lines(synth.order_lines(spark, sf_dir))
    scores = compare.accuracy(compare.judged(compare.pairs(read, true)), found)
    n_rows = found.select("doc_id", F.col("filas").alias("filas_ocr"))
    n_true = true.groupBy("doc_id").agg(F.count(F.lit(1)).alias("esperados"))
    t = report.summary(found.select("doc_id", "items", F.struct("conflictos").alias("avisos")), n_rows, checks.arithmetic(read), scores, n_true)
    return t.select("doc_id", "filas_ocr", F.col("items").cast("bigint").alias("items"), "esperados", F.col("conflictos").cast("bigint").alias("conflictos"), "arit_ok", *ESSENTIAL)


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every page's diagnosis."""
    found = pages.pages(_parts(spark, sf_dir), "avisos", "descartadas", "conflictos", b=0.0)
    t = report.notices(found.select("doc_id", F.struct("avisos.*", "descartadas", "conflictos").alias("avisos")))
    return t.select("doc_id", F.posexplode("lineas").alias("k", "linea"))


def readable_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = pages.pages(_parts(spark, sf_dir), "avisos", b=0.0)
    return g.select("doc_id", F.explode(F.map_entries("avisos.mapa")).alias("e")).select("doc_id", F.col("e.key").alias("banda"), F.col("e.value").alias("campo"))


def documents_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical documents written as JSON and read back: lines, the first code, the sum of amounts; sections are there and empty."""
    path = f"{shared_dir(spark)}/docgrid-documents-{uuid.uuid4().hex}"
    report.write_documents(pages.pages(_parts(spark, sf_dir), "items", b=0.0), path)
    t = spark.read.schema("doc_id string, value string").json(path)
    d = F.from_json("value", "struct<emisor:struct<cuit:string>,items:array<struct<codigo:string,importe:double>>>")
    t = t.select("doc_id", d.alias("d"), F.contains("value", F.lit('"cuit"')).alias("sections"))
    total = F.aggregate("d.items", F.lit(0).cast("bigint"), lambda s, x: s + _cents(x["importe"]))
    return t.select("doc_id", F.size("d.items").cast("bigint").alias("items"), F.get("d.items", F.lit(0))["codigo"].alias("first"), total.alias("cents"), (F.col("sections") & F.col("d.emisor.cuit").isNull()).alias("sections"))


def row_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the tilted pages as text and by column."""
    t = stored(rows.group_rows(boxes.boxes(synth.supplier_results(spark, sf_dir)), tol=13.0, b=0.0), "rows")
    return rows.row_text(t).join(rows.row_grid(t, 4), ["doc_id", "row_id"]).select("doc_id", F.col("row_id").cast("bigint").alias("row_id"), "texto", "c0", "c1", "c2", "c3")


def items_tilted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of invoices that are tilted by up to 0.004, read with the estimated tilt."""
    slope = (F.pmod(F.col("doc_id").cast("bigint"), F.lit(9)) - 4) / 1000
    t = _parts(spark, sf_dir).withColumn("b", F.transform("b", lambda c: c.withField("y", c["y"] + slope * ((c["x0"] + c["x1"]) / 2 - 760))))
    got = item_table(pages.pages(t, "items"))
    return got.select("doc_id", F.col("i").cast("bigint").alias("i"), "codigo", "descripcion", F.col("cantidad").cast("bigint").alias("cantidad"), _cents(F.col("importe")).alias("cents"))


#: Titles that no list knows, and what a model says they are.
UNKNOWN = {"DETALLE": ("Q2", "descripcion"), "P. UNITARIO": ("Q3", "precio_unitario"), "BONIF. %": ("Q4", "descuento_pct"), "TOTAL": ("Q5", "importe")}
KNOWN = {"CODIGO": "codigo", "CANTIDAD": "cantidad"}


def standardise_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices with four titles that only a model can name; the model is a fixed table. A text across each line hides the gaps, so the grid comes from the header (where it comes from the data, a model's names do not count)."""
    marks = F.create_map(*(F.lit(x) for title, (mark, _) in UNKNOWN.items() for x in (title, mark)))
    across = {"box_id": ((F.col("n") + 1) * 8 + 7).cast("int"), "x0": F.lit(30.0), "x1": F.lit(1390.0), "y": synth.FIRST_Y + synth.PITCH * (F.col("n") - 1), "height": F.lit(synth.HEIGHT), "txt": F.lit("glued")}
    marked = F.transform("b", lambda c: c.withField("txt", F.coalesce(F.try_element_at(marks, c["txt"]), c["txt"])))
    t = _parts(spark, sf_dir).withColumn("b", F.concat(marked, F.array(F.struct(*(v.alias(c) for c, v in across.items())))))
    named = {**KNOWN, **dict(UNKNOWN.values())}

    def model() -> Callable:
        return lambda titles: [named.get(x) for x in titles]

    found = pages.pages(t, "items", "avisos", b=0.0, make_mapper=model)
    got = found.select("doc_id", "avisos.origen_mapa", F.posexplode("items").alias("i", "x"))
    return got.select("doc_id", "origen_mapa", F.col("i").cast("bigint").alias("i"), "x.codigo", "x.descripcion", _cents(F.col("x.importe")).alias("cents"))


# ---- bands and rectangles

def band_subdivide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose first two columns make one band: it is cut unless the places of the cuts differ too much (odd nations, where every second text starts later)."""
    t = rows.group_rows(boxes.boxes(synth.supplier_results(spark, sf_dir)), tol=13.0, b=0.0)
    late = (F.col("x0") == 300) & (F.substring("doc_id", 2, 9).cast("int") % 2 == 1)
    t = stored(t.withColumn("x0", F.when(late, F.col("x0") + 200 * (F.col("row_id") % 2)).otherwise(F.col("x0"))), "rows")
    wide = t.select("doc_id").distinct().select("doc_id", F.inline(F.array(*(F.struct(F.lit(i).alias("band_id"), F.lit(a).alias("left"), F.lit(b).alias("right")) for i, (a, b) in enumerate(((40.0, 640.0), (900.0, 1010.0)))))))
    got = grid.split_bands(wide, t)
    return got.select("doc_id", F.col("band_id").cast("bigint").alias("band_id"), F.round("left", 6).alias("x_left"), F.round("right", 6).alias("x_right"))


TOUCH_BANDS = ((30, 150), (250, 270), (340, 830), (900, 1010), (1250, 1390))


def title_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bands under titles of many places and widths."""
    bands = F.array(*(F.struct(F.lit(float(a)).alias("left"), F.lit(float(b)).alias("right")) for a, b in TOUCH_BANDS))
    t = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 1400).cast("double").alias("x0"), (F.col("p_partkey") % 7 * 90 + 10).cast("double").alias("w"))
    return t.select("p_partkey", F.array_join(grid.touched_bands(F.col("x0"), F.col("x0") + F.col("w"), bands).cast("array<string>"), ",").alias("bands"))


def crop_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of crops with a margin of their own on each side, and the crops' names."""
    k = F.col("p_partkey")
    b = F.struct((k % 400).cast("double").alias("x_min"), (k % 37).cast("double").alias("y_min"), (k % 700 + 300).cast("double").alias("x_max"), (k % 900 + 100).cast("double").alias("y_max"))
    r = bbox.crop_rectangle(b, F.lit(1240), F.lit(1754), (0.01, 0.02, 0.03, 0.04))
    path = F.concat(F.lit("store/page."), k.cast("string"), F.when(k % 2 == 0, "_derecha").otherwise(""), F.lit(".JPG"))
    t = table(spark, sf_dir, "part").select("p_partkey", r.alias("r"), bbox.crop_name(path).alias("name"), bbox.data_url(path, F.encode(k.cast("string"), "UTF-8")).alias("url"))
    return t.select("p_partkey", *(F.round(F.col(f"r.{c}"), 3).alias(c) for c in ("x0", "y0", "x1", "y1")), "name", "url")


QUERIES = {f.__name__: f for f in (accuracy_ratios, summary, notices, readable_map, documents_json, row_text, items_tilted, standardise_model, band_subdivide, title_touches, crop_rectangles)}

_ITEMS = "CAST(o AS VARCHAR) AS doc_id, n - 1 AS i, lpad(CAST(partkey AS VARCHAR), 7, '0') AS codigo, name AS descripcion"
_SUPPLIERS = "p AS (SELECT s_nationkey AS k, s_suppkey, s_name, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS r FROM supplier)"
#: A page of one line has two rows below its header: the total's label counts for the grid.
_MAP = """SELECT o, v.b, CASE WHEN v.b = 3 AND lines = 1 THEN '3 [900,1050]' ELSE v.banda END AS banda, v.campo FROM full_lines, (VALUES (0, '0 [30,150]', 'codigo'), (1, '1 [250,270]', 'cantidad'), (2, '2 [340,830]', 'descripcion'),
  (3, '3 [900,1010]', 'precio_unitario'), (4, '4 [1060,1110]', 'descuento_pct'), (5, '5 [1250,1390]', 'importe')) v(b, banda, campo) WHERE n = 1"""

ORACLE = {
    "accuracy_ratios": f"""WITH {ALL_JUDGED}, pages AS (SELECT DISTINCT doc_id FROM truth), c AS (SELECT doc_id, campo, count_if(juicio = 'ok') AS ok, count_if(juicio = 'contiene') AS contiene, count_if(juicio = 'mal') AS mal, count_if(juicio = 'faltante') AS faltante, count(*) AS n FROM q GROUP BY ALL)
        SELECT pages.doc_id, f.campo, coalesce(ok, 0) AS ok, coalesce(contiene, 0) AS contiene, coalesce(mal, 0) AS mal, coalesce(faltante, 0) AS faltante, coalesce(round(ok / n, 3), 0) AS exacta, coalesce(round((ok + contiene) / n, 3), 0) AS laxa
        FROM pages CROSS JOIN (VALUES ('codigo'), ('descripcion'), ('cantidad'), ('precio_unitario'), ('importe')) f(campo) LEFT JOIN c ON c.doc_id = pages.doc_id AND c.campo = f.campo""",
    "summary": """SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, count(*) + 2 + CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END AS filas_ocr, count(*) AS items, count(*) AS esperados, CAST(0 AS BIGINT) AS conflictos, count(*) AS arit_ok,
        '1.0' AS codigo, '1.0' AS descripcion, '1.0' AS cantidad, '1.0' AS precio_unitario, '1.0' AS importe FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""",
    "readable_map": f"WITH {LINES}, m AS ({_MAP}) SELECT CAST(o AS VARCHAR) AS doc_id, banda, campo FROM m",
    "documents_json": f"WITH {LINES} SELECT CAST(o AS VARCHAR) AS doc_id, count(*) AS items, min_by(lpad(CAST(partkey AS VARCHAR), 7, '0'), n) AS first, CAST(sum(cents) AS BIGINT) AS cents, true AS sections FROM full_lines GROUP BY o",
    "row_text": f"WITH {_SUPPLIERS}, x AS (SELECT k, r, CAST(s_suppkey AS VARCHAR) AS c0, s_name AS c1, format('{{:,.2f}}', s_acctbal) AS c2 FROM p) SELECT 'n' || k AS doc_id, r AS row_id, c0 || ' | ' || c1 || ' | ' || c2 AS texto, c0, c1, c2, CAST(NULL AS VARCHAR) AS c3 FROM x",
    "items_tilted": f"WITH {LINES} SELECT {_ITEMS}, quantity AS cantidad, cents FROM full_lines",
    "standardise_model": f"WITH {LINES} SELECT * REPLACE ('glued ' || descripcion AS descripcion) FROM (SELECT {_ITEMS}, 'llm' AS origen_mapa, cents FROM full_lines)",
    "band_subdivide": f"""WITH {_SUPPLIERS}, x AS (SELECT k, avg(mid) AS mid, stddev_pop(mid) > 30 AS loose FROM (SELECT k, (440 + 200 * (r % 2) * (k % 2)) / 2.0::DOUBLE AS mid FROM p) GROUP BY k)
        SELECT 'n' || k AS doc_id, CAST(b AS BIGINT) AS band_id, CASE WHEN b = 0 THEN 40.0::DOUBLE WHEN b = 1 AND NOT loose THEN round(mid, 6) ELSE 900.0::DOUBLE END AS x_left, CASE WHEN b = 0 AND NOT loose THEN round(mid, 6) WHEN b = 0 OR b = 1 AND NOT loose THEN 640.0::DOUBLE ELSE 1010.0::DOUBLE END AS x_right
        FROM x, (VALUES (0), (1), (2)) v(b) WHERE b < 2 OR NOT loose""",
    "title_touches": f"""SELECT p_partkey, coalesce(string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) FILTER (WHERE least(x1, r) - greatest(x0, l) >= greatest(1, 0.15::DOUBLE * (x1 - x0))), '') AS bands
        FROM (SELECT p_partkey, (p_partkey % 1400)::DOUBLE AS x0, (p_partkey % 1400 + p_partkey % 7 * 90 + 10)::DOUBLE AS x1 FROM part), (VALUES {', '.join(f'({i}, {a}.0::DOUBLE, {b}.0::DOUBLE)' for i, (a, b) in enumerate(TOUCH_BANDS))}) v(b, l, r) GROUP BY p_partkey""",
    "crop_rectangles": """SELECT p_partkey, round(greatest(0, k % 400 / 1000.0::DOUBLE - 0.01::DOUBLE) * 1240, 3) AS x0, round(greatest(0, k % 37 / 1000.0::DOUBLE - 0.02::DOUBLE) * 1754, 3) AS y0, round(least(1, (k % 700 + 300) / 1000.0::DOUBLE + 0.03::DOUBLE) * 1240, 3) AS x1, round(least(1, (k % 900 + 100) / 1000.0::DOUBLE + 0.04::DOUBLE) * 1754, 3) AS y1,
        'page.' || k || '_tabla.png' AS name, 'data:image/jpeg;base64,' || base64(encode(CAST(k AS VARCHAR))) AS url FROM (SELECT p_partkey, p_partkey AS k FROM part)""",
    "notices": f"""WITH {LINES}, m AS ({_MAP}), foot AS (SELECT o, CAST(sum(cents) AS BIGINT) AS cents FROM full_lines GROUP BY o),
        x AS (SELECT o, 0 AS k, 'títulos leídos: [''CODIGO'', ''CANTIDAD'', ''DETALLE'', ''P. UNITARIO'', ''BONIF. %'', ''TOTAL'', ''ALICUOTA'']' AS linea FROM foot UNION ALL SELECT o, 1, 'columnas según datos (6 columnas) — nombres según alias' FROM foot
          UNION ALL SELECT o, 2 + b, '   ' || lpad(banda, 22, ' ') || '  ' || campo FROM m UNION ALL SELECT o, 8, 'títulos de columnas vacías: [''ALICUOTA'']' FROM foot
          UNION ALL SELECT o, 9, 'renglones que no son items (1):' FROM foot UNION ALL SELECT o, 10, '    SUMA Y SIGUE | ' || {MONEY} FROM foot)
        SELECT CAST(o AS VARCHAR) AS doc_id, k, linea FROM x""",
}
