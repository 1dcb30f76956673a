"""The canonical document: sections, item fields, and Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

# The canonical fields in their order.
SECTIONS = {
    "comprobante": ["clase", "letra", "codigo", "punto_venta", "numero", "fecha", "hora", "hoja"],
    "emisor": ["razon_social", "nombre_fantasia", "domicilio", "localidad", "cuit", "iibb", "condicion_iva", "inicio_actividades", "telefono", "email", "fax", "web", "codigo_postal"],
    "cliente": ["nombre", "domicilio", "localidad", "cuit", "codigo", "condicion_iva", "condicion_venta"],
    "totales": ["neto", "descuento", "subtotal", "iva", "iva_10_5", "iva_pct", "percepciones", "total"],
    "cae": ["numero", "vencimiento"],
    "otros": ["vendedor", "codigo_barras", "observaciones", "total_en_letras"],
}
ITEM_FIELDS = ["codigo", "descripcion", "cantidad", "unidad", "precio_unitario", "descuento_pct", "importe", "codigo_barras", "codigo_proveedor"]
ITEM_NUMBERS = ("cantidad", "precio_unitario", "descuento_pct", "importe")
ESSENTIAL = ("codigo", "descripcion", "cantidad", "precio_unitario", "importe")
#: Item fields whose cell holds one value.
ATOMIC = ("codigo", "cantidad", "precio_unitario", "importe")
NUMBER_SECTION = "totales"
DATE_FIELDS = ("fecha", "vencimiento", "inicio_actividades")
TAX_ID = "cuit"


def item_type() -> T.StructType:
    return T.StructType([T.StructField(f, T.DoubleType() if f in ITEM_NUMBERS else T.StringType()) for f in ITEM_FIELDS])


def section_type(section: str) -> T.StructType:
    kind = T.DoubleType() if section == NUMBER_SECTION else T.StringType()
    return T.StructType([T.StructField(f, kind) for f in SECTIONS[section]])


def document_type() -> T.StructType:
    return T.StructType([*(T.StructField(s, section_type(s)) for s in SECTIONS), T.StructField("items", T.ArrayType(item_type()))])


def box_type() -> T.StructType:
    """A text box on a page; box_id is its place in the reader's output and settles ties."""
    return T.StructType(
        [T.StructField("doc_id", T.StringType()), T.StructField("box_id", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in ("x0", "x1", "y", "height", "score")), T.StructField("txt", T.StringType())]
    )
