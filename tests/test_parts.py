"""Functions, truth documents, rectangles, images, providers, sources, streaming."""

import json

import numpy as np
from pyspark.sql import functions as F

from docgrid.functions import bbox, text, vocabulary
from docgrid.operators import image, truth
from docgrid.plans.pipeline import replay
from docgrid.sources import files, providers
from docgrid.streaming.results import result_stream, write_items

from .fixtures import LAMPS, SCREWS


def test_keys(spark):
    cases = {"Cód. Barras": "codbarras", "% Bonif.": "bonif", "P. Unit.": "punit", "PRECIO UNIT.": "preciounit", "Ñandú Ü": "nanduu", "İ": "i", "": "", "ﬁ": "", "K": "k"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.k for r in df.select("t", text.key(F.col("t")).alias("k")).collect()} == cases == {k: text.plain_key(k) for k in cases}
    sample = "".join(chr(c) for c in [*range(0x20, 0x600), *range(0x1E00, 0x2200), *range(0xFF00, 0xFFF0)])
    r = spark.createDataFrame([(sample, "a\xa0 b\x1c\n c ", None)], "a string, b string, c string").select(text.key(F.col("a")).alias("k"), text.clean(F.col("b")).alias("b"), text.clean(F.col("c")).alias("c"), text.strip_accents("a").alias("s")).first()
    assert r.k == text.plain_key(sample) and r.b == "a b c" and r.c is None and r.s == text.fold(sample)


def test_titles():
    assert dict(vocabulary.field_scores("% Desc.")) == {"descuento_pct": 5.0} and vocabulary.field_scores("###") == ()
    assert 1.0 < dict(vocabulary.field_scores("DESCRIPCICN"))["descripcion"] < 1.2
    assert vocabulary.glued_fields("% Bonif. Neto Unit Neto Total") == ("descuento_pct", "precio_unitario", "importe")


def test_rectangles():
    assert bbox.parse('x {"xmin": 1, "Y_MIN": "2", "x-max": 1200, "ymax": 900, "contene_tabla": false} y') == {"contiene_tabla": False, "x_min": 1.0, "y_min": 2.0, "x_max": 1000.0, "y_max": 900.0}
    assert bbox.parse('{"x_min": 1, "y_min": 2, "y_max": 3}') is None and bbox.parse("none") is None and bbox.parse(None) is None and bbox.parse("{bad}") is None


DOC = {
    "factura": {"Número": "0012-00004186", "fecha": "1/2/2012", "cod": "x", "cae": "77"}, "tipo_comprobante": "FACTURA A", "empresa": {"nombre": "Uno", "CUIT": 20206014645, "raro": {"a": [1, {"b": None}]}},
    "cliente": {"nombre": " Dos  Tres ", "vendedor": "V"}, "pie": {"neto": 1.234, "total": "1.234,50", "descuento": True}, "items": [{"articulo": "a1", "cant": 1, "cantidad": 2, "total": "5,00", "total_final": "6,00", "despacho": "d"}, "no"],
}


def test_truth(spark):
    rows = [("a", json.dumps(DOC)), ("b", "{}"), ("c", "not json"), ("d", '{"cae": "123", "emisor": {"Cuit": "1", "cuit": "2"}, "cuit": "9"}'), ("e", None)]
    got = {r.doc_id: r for r in truth.normalise(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    a = got["a"]
    assert (a.comprobante.punto_venta, a.comprobante.numero, a.comprobante.fecha, a.comprobante.clase, a.comprobante.letra) == ("0012", "00004186", "01/02/2012", "FACTURA", "A")
    assert a.emisor.razon_social == "Uno" and a.emisor.cuit == "20-20601464-5" and a.cliente.nombre == "Dos Tres" and a.otros.vendedor == "V"
    assert (a.totales.neto, a.totales.total, a.totales.descuento) == (1.234, 1234.5, None) and a.cae.numero == "77"
    assert [(i.codigo, i.cantidad, i.importe) for i in a["items"]] == [("a1", 2.0, 6.0), (None, None, None)]
    assert a.sin_mapear == ["empresa.raro.a[]", "empresa.raro.a[].b", "factura.cod", "items[]", "items[].cant", "items[].despacho", "items[].total"]
    assert got["b"].ok and len(got["b"].vacios) == 42 and not got["c"].ok and not got["e"].ok
    assert got["d"].cae.numero == "123" and got["d"].emisor.cuit == "2" and got["d"].cliente.cuit == "9"
    assert truth.report(truth.normalise(spark.createDataFrame(rows[:1], "doc_id string, text string"))).first().items == 2


def lines_image(b: float) -> np.ndarray:
    a = np.full((400, 600, 3), 255, np.uint8)
    x = np.arange(20, 580)
    for k in range(12):
        for t in range(4):
            a[np.clip(np.rint(40 + 28 * k + t + b * x).astype(int), 0, 399), x] = 0
    return a


def test_tilt():
    for b in (0.0, -0.0087, 0.02):
        assert abs(image.tilt(lines_image(b)) - b) <= 0.0012
    level, used = image.deskew(lines_image(-0.02))
    assert used != 0 and abs(image.tilt(level)) < 0.003 and image.deskew(level, 0.0007)[1] == 0.0
    assert image.tilt(np.full((50, 50, 3), 255, np.uint8)) == 0.0


def test_crops(spark, tmp_path):
    a = lines_image(0.0)
    (tmp_path / "one_derecha.png").write_bytes(image.png(a))
    df = files.decoded_images(spark, str(tmp_path))
    r = df.first()
    assert (image.pixels(bytes(r.data), r.height, r.width, r.n_channels) == a).all()
    box = F.struct(F.lit(True).alias("contiene_tabla"), *(F.lit(v).alias(k) for k, v in (("x_min", 100.0), ("y_min", 100.0), ("x_max", 900.0), ("y_max", 500.0))))
    assert bytes(image.table_crops(df.withColumn("bbox", box)).first().crop)[:4] == b"\x89PNG"
    assert image.crop_zoom(a, {"x_min": 100, "y_min": 100, "x_max": 900, "y_max": 500}, margin=0.0, level=False).shape == (2 * 160 + 60, 2 * 480 + 60, 3)
    assert df.select(bbox.crop_name(F.col("path")).alias("n")).first().n == "one_tabla.png" and abs(image.tilts(df).first().b) <= 0.0012
    assert files.crops(spark, str(tmp_path)).count() == 1 and files.crops(spark, str(tmp_path / "none")).count() == 0
    assert image.upright(a, 6)[0].shape == (600, 400, 3) and image.upright(a, 3)[1] is False and image.upright(a, 1, 90)[1] and image.exif_orientation(b"\x89PNG") == 1


def test_model_retries():
    said = []

    def model(replies):
        it = iter(replies)
        return lambda prompt, image: (said.append(prompt), next(it))[1]

    good = '{"x_min": 10, "y_min": 10, "x_max": 500, "y_max": 300}'
    whole = '{"x_min": 0, "y_min": 0, "x_max": 1000, "y_max": 1000}'
    assert providers.find_table(model(["?", good]), None)["x_max"] == 500 and said[-1].endswith(providers.KEYS_HINT)
    assert providers.find_table(model([whole, good]), None) and said[-1].endswith(providers.WHOLE_HINT)
    assert providers.find_table(model([whole, whole]), None) is None
    n = len(said)
    assert providers.find_table(model(['{"contiene_tabla": false, "x_min": 1, "y_min": 1, "x_max": 2, "y_max": 2}']), None) is None and len(said) == n + 1
    assert providers.named_by_model('x {"0": "Código", "1": "codigo", "a": "importe", "2": "IMPORTE", "9": "unidad"}', 3) == ["codigo", None, "importe"]
    assert providers.named_by_model("{bad", 2) == [None, None]


def result(page):
    polys = [[[a, y - 11], [b, y - 11], [b, y + 11], [a, y + 11]] for y, cells in page for _, a, b in cells]
    return {"rec_polys": polys, "rec_texts": [t for _, cells in page for t, _, _ in cells], "rec_scores": [0.99] * len(polys)}


def fake_reader(**options):
    return lambda content: result(LAMPS)


def test_providers(spark):
    df = spark.createDataFrame([("p1", bytearray(b"x")), ("p2", bytearray(b"y"))], "path string, content binary")
    got = providers.read_images(df, fake_reader).collect()
    assert len(got) == 2 and all(r.res.rec_texts == result(LAMPS)["rec_texts"] for r in got)
    turned = spark.createDataFrame([("p", a, ([], [], s)) for a, s in ((0, [0.5]), (90, [0.9, 0.9]), (180, [0.9, 0.9]), (270, []))], "path string, angle int, res struct<rec_polys:array<array<array<double>>>,rec_texts:array<string>,rec_scores:array<double>>")
    assert providers.best_rotation(turned).first().rotacion == 90
    readings = spark.createDataFrame([("p", "a", ([], ["12345", "x"], [])), ("p", "b", ([], ["777", "12345", "9999"], []))], "path string, variant string, res struct<rec_polys:array<array<array<double>>>,rec_texts:array<string>,rec_scores:array<double>>")
    assert sorted((r.a, r.b) for r in providers.compare_variants(readings, ["a", "b"], r"\d{4,8}").collect()) == [("", "9999"), ("12345", "12345")]


def test_replay_and_stream(spark, tmp_path):
    ocr, gt, out = tmp_path / "ocr", tmp_path / "gt", []
    ocr.mkdir()
    gt.mkdir()
    (ocr / "factura2_tabla_res.json").write_text(json.dumps(result(LAMPS)))
    (ocr / "factura5_tabla_res.json").write_text(json.dumps({"res": result(SCREWS)}))
    (ocr / "factura3_tabla_res.json").write_text(json.dumps(result(SCREWS)))
    (gt / "factura2.json").write_text(json.dumps({"items": [{"codigo": c, "descripcion": "x", "cantidad": 1, "importe": "3.751,50"} for c in ("K-100", "K-205", "9")]}))
    (gt / "factura5.json").write_text("")
    r = replay(files.ocr_results(spark, str(ocr)), files.truth_files(spark, str(gt)))
    got = {x.doc_id: x for x in r.summary.collect()}
    assert set(got) == {"factura2", "factura5"} and got["factura2"].filas_ocr == 5 and got["factura2"]["items"] == 3 and got["factura2"].esperados == 3 and got["factura2"].arit_ok == 3
    assert got["factura2"].importe_exacta == 0.333 and got["factura2"].codigo == "0.667"
    q = write_items(result_stream(spark, str(ocr)), lambda df, n: out.extend(df.collect()), str(tmp_path / "ck"))
    q.awaitTermination()
    assert {x.doc_id: len(x["items"]) for x in out} == {"factura2": 3, "factura3": 3, "factura5": 3}


def test_bad_result_is_an_error(spark, tmp_path):
    (tmp_path / "a_res.json").write_text('{"rec_texts": []}')
    try:
        files.ocr_results(spark, str(tmp_path)).collect()
    except Exception as e:
        assert "rec_polys" in str(e)
    else:
        raise AssertionError
