"""Rows to items: the header names the grid, boxes fall into bands, cells become fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrid.functions.text import clean
from docgrid.functions.values import loose_number, number
from docgrid.operators.grid import BANDS, band_arrays, data_bands, header_bands, nearest_band, readable_map, split_bands
from docgrid.operators.naming import header_rows, name_bands, split_titles, titles_without_column, titles_without_data, with_parts, with_titles
from docgrid.session import stored
from docgrid.schema import ATOMIC, ESSENTIAL, ITEM_FIELDS, ITEM_NUMBERS

NO_HEADER = "no encontré la fila de encabezados"
NAMES = "array<string>"


def is_item(codigo: Column, cantidad: Column, importe: Column) -> Column:
    """A line is an item if it has a code, or quantity and amount."""
    return F.coalesce(codigo != "", F.lit(False)) | (cantidad.isNotNull() & importe.isNotNull())


def _by_place(named: Column, n: Column) -> Column:
    """Fields in an array by place."""
    at = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    found = F.transform(at, lambda i: F.get(F.filter(named, lambda x: x["at"] == i), F.lit(0))["field"])
    return F.slice(found, F.lit(1), n)


def page_grids(rows: DataFrame, mode: str = "x", forced: DataFrame | None = None) -> DataFrame:
    """One row per page: header, titles, bands, names (fields by band, or by place in positional mode), and what there is to tell.
    forced(doc_id, names): fields by title, from elsewhere; they count where the grid comes from the header."""
    heads = header_rows(rows)
    if forced is not None:
        first = with_titles(rows, 1).select("doc_id", with_parts(F.col("titles")).alias("first_titles"))
        heads = heads.join(forced.select("doc_id", F.col("names").cast(NAMES).alias("forced")), "doc_id", "left").join(first, "doc_id", "left")
        heads = heads.withColumn("named", F.when(F.col("forced").isNull(), F.col("named")).otherwise(F.filter(F.transform("forced", lambda f, i: F.struct(i.alias("at"), i.alias("title"), f.alias("field"), F.lit(None).cast("double").alias("score"))), lambda x: x["field"].isNotNull())))
        use = F.col("header").isNull() & F.col("forced").isNotNull()
        heads = heads.withColumn("titles", F.when(use, F.col("first_titles")).otherwise(F.col("titles"))).withColumn("header", F.when(use, 0).otherwise(F.col("header")))
    heads = stored(heads, "heads")  # one row per page, read by every step of the grid
    data = rows.join(heads.select("doc_id", "header"), "doc_id").where(F.col("row_id") > F.col("header"))
    found = band_arrays(split_bands(data_bands(data), data))
    p = heads.join(found, "doc_id", "left")
    n = F.coalesce(F.size("titles"), F.lit(0))
    from_data = F.coalesce(F.size("bands") >= 2, F.lit(False)) & F.lit(mode != "posicional")
    p = p.withColumn("from_data", from_data).withColumn("title_names", F.when(F.col("titles").isNotNull(), _by_place(F.col("named"), n)))
    p = p.withColumn("grid", F.when(F.col("titles").isNull(), F.lit(None)).when(F.col("from_data"), F.col("bands")).otherwise(header_bands(F.col("titles"))).cast(BANDS))
    p = p.withColumn("band_named", F.when(F.col("from_data"), name_bands(F.col("titles"), F.col("grid"))))
    p = p.withColumn("names", F.when(F.col("from_data"), _by_place(F.col("band_named"), F.size("grid"))).otherwise(F.col("title_names")))
    empty = F.array().cast("array<string>")
    p = p.withColumn("titulos_sin_datos", F.when(F.col("from_data"), titles_without_data(F.col("titles"), F.col("grid"))).otherwise(empty))
    numbered = F.transform("names", lambda f, i: F.when(f.isNull(), i))
    return p.select(
        "doc_id", "header", "titles", "grid", "names", "from_data",
        F.struct(
            F.when(F.col("titles").isNull(), NO_HEADER).alias("error"),
            F.transform("titles", lambda t: t["txt"]).alias("encabezado"),
            F.when(F.col("titles").isNotNull(), readable_map(F.col("grid"), F.col("names"))).alias("mapa"),
            F.when(F.col("titles").isNotNull(), F.filter(F.transform("titles", lambda t, i: F.struct(t["txt"].alias("texto"), F.get("title_names", i).alias("campo"))), lambda x: x["campo"].isNotNull())).alias("mapa_alias"),
            F.array_compact(F.transform("titles", lambda t, i: F.when(F.get("title_names", i).isNull(), t["txt"]))).alias("sin_nombre"),
            F.col("titulos_sin_datos"),
            F.when(F.col("from_data"), split_titles(F.col("titles"), F.col("grid"))).alias("titulos_partidos"),
            F.when(F.col("from_data"), titles_without_column(F.col("titles"), F.col("band_named"), F.col("titulos_sin_datos"))).otherwise(empty).alias("titulos_sin_columna"),
            F.when(F.col("from_data"), F.array_compact(numbered)).otherwise(F.array().cast("array<int>")).alias("columnas_sin_titulo"),
            F.lit(mode).alias("modo"),
            F.lit("alias" if forced is None else "forzado").alias("origen_mapa"),
            F.when(F.col("titles").isNull(), F.lit(None)).when(F.col("from_data"), F.concat(F.lit("datos ("), F.size("grid").cast("string"), F.lit(" columnas)"))).otherwise("encabezado").alias("origen_grilla"),
            F.array_sort(F.array_intersect(F.array_distinct(F.coalesce("names", empty)), F.array(*map(F.lit, ESSENTIAL)))).alias("esenciales"),
        ).alias("avisos"),
    )


def lines(rows: DataFrame, grids: DataFrame, mode: str = "x") -> DataFrame:
    """Every data row of pages that have a header: fields, texto, conflicts, es_item."""
    b = rows.join(grids.where("header is not null").select("doc_id", "header", "grid", "names"), "doc_id").where(F.col("row_id") > F.col("header"))
    place = F.col("pos") if mode == "posicional" else F.coalesce(-nearest_band(F.col("x0"), F.col("x1"), F.col("grid"))["back"], F.lit(0))
    b = b.withColumn("place", place).withColumn("campo", F.get("names", F.col("place").cast("int")))
    per_row = b.groupBy("doc_id", "row_id").agg(F.array_sort(F.collect_list(F.struct("pos", "txt", "campo"))).alias("cells"))
    read = number if mode == "posicional" else loose_number

    def mine(field: str) -> Column:
        return F.filter("cells", lambda c: c["campo"] == field)

    def value(field: str) -> Column:
        own = mine(field)
        text = F.when(F.size(own) > 0, F.array_join(F.transform(own, lambda c: c["txt"]), " "))
        return (read(text) if field in ITEM_NUMBERS else clean(text)).alias(field)

    def conflict(field: str) -> Column:
        own = mine(field)
        listed = F.concat(F.lit(f"{field}: ["), F.array_join(F.transform(own, lambda c: F.concat(F.lit("'"), c["txt"], F.lit("'"))), ", "), F.lit("]"))
        return F.when(F.size(own) > 1, F.struct(F.get(own, F.lit(0))["pos"].alias("pos"), listed.alias("text")))

    clashes = F.transform(F.array_sort(F.array_compact(F.array(*map(conflict, ATOMIC)))), lambda c: c["text"]) if mode != "posicional" else F.array().cast("array<string>")
    out = per_row.select("doc_id", "row_id", *map(value, ITEM_FIELDS), F.array_join(F.transform("cells", lambda c: c["txt"]), " | ").alias("texto"), clashes.alias("conflicto"))
    out = out.withColumn("es_item", is_item(F.col("codigo"), F.col("cantidad"), F.col("importe")))
    before = F.count_if("es_item").over(Window.partitionBy("doc_id").orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("i", F.coalesce(before, F.lit(0)).cast("int"))


def items(line_table: DataFrame) -> DataFrame:
    """doc_id, i (from 0), the item fields."""
    return line_table.where("es_item").select("doc_id", "i", *ITEM_FIELDS)


def discarded(line_table: DataFrame) -> DataFrame:
    """Lines that are no items: kept apart, never dropped."""
    return line_table.where("not es_item").select("doc_id", "row_id", "texto")


def conflicts(line_table: DataFrame) -> DataFrame:
    """Cells with two values where one belongs: rows that ran together. fila: items before."""
    return line_table.where(F.size("conflicto") > 0).select("doc_id", F.col("i").alias("fila"), F.col("conflicto").alias("detalle"))


def extract(rows: DataFrame, mode: str = "x", forced: DataFrame | None = None) -> DataFrame:
    """One row per page: items and avisos. `rows` is read several times: give a stored table. Mode x: a box belongs to the band it overlaps most; posicional: the k-th box is the k-th column."""
    grids = stored(page_grids(rows, mode, forced), "grids")
    got = lines(rows, grids, mode)
    item = F.struct(*ITEM_FIELDS)
    per_page = got.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("es_item"), F.struct("i", item.alias("item"))))).alias("items"),
        F.array_sort(F.collect_list(F.when(~F.col("es_item"), F.struct("row_id", "texto")))).alias("descartadas"),
        F.array_sort(F.collect_list(F.when(F.size("conflicto") > 0, F.struct("row_id", F.struct(F.col("i").alias("fila"), F.col("conflicto").alias("detalle")).alias("c"))))).alias("conflictos"),
    )
    p = grids.join(per_page, "doc_id", "left")
    item_type = "array<struct<" + ",".join(f"{f}:{'double' if f in ITEM_NUMBERS else 'string'}" for f in ITEM_FIELDS) + ">>"
    return p.select(
        "doc_id",
        F.coalesce(F.transform("items", lambda x: x["item"]), F.array().cast(item_type)).alias("items"),
        F.struct(
            "avisos.*",
            F.coalesce(F.transform("descartadas", lambda x: x["texto"]), F.array().cast("array<string>")).alias("descartadas"),
            F.coalesce(F.transform("conflictos", lambda x: x["c"]), F.array().cast("array<struct<fila:int,detalle:array<string>>>")).alias("conflictos"),
        ).alias("avisos"),
    )


def standardise(rows: DataFrame, map_titles=None, least_essential: int = 3) -> DataFrame:
    """extract, and for pages with too few essential columns once more with fields from `map_titles`: a function of titles(doc_id, titles array<string>) that gives (doc_id, names array<string>)."""
    first = extract(rows)
    if map_titles is None:
        return first
    poor = first.where(F.col("avisos.error").isNotNull() | (F.size("avisos.esenciales") < least_essential)).select("doc_id")
    again = rows.join(poor, "doc_id", "left_semi")
    heads = header_rows(again, least=1)
    top = with_titles(again, 1).select("doc_id", with_parts(F.col("titles")).alias("first_titles"))
    asked = heads.join(top, "doc_id", "left").select("doc_id", F.transform(F.coalesce("titles", "first_titles"), lambda t: t["txt"]).alias("titles"))
    names = map_titles(asked).where(F.exists("names", lambda f: f.isNotNull()))
    second = extract(again.join(names.select("doc_id"), "doc_id", "left_semi"), forced=names)
    second = second.withColumn("avisos", F.col("avisos").withField("origen_mapa", F.lit("llm")))
    return first.join(second.select("doc_id"), "doc_id", "left_anti").unionByName(second)


