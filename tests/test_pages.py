"""Boxes that come by page give what the operators on tables of boxes give, on odd pages."""

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import fixtures  # noqa: E402

from docgrid.functions import values  # noqa: E402
from docgrid.operators import items, pages, rows  # noqa: E402
from docgrid.plans import queries, synth  # noqa: E402
from docgrid.session import stored  # noqa: E402

WORDS = ["Codigo", "Cantidad", "Detalle", "P. Unit.", "Total", "% Dto", "Precio", "Importe", "EAN", "10,00", "3", "K-1", "1.250,50", "LAMPARA  X", "Codigo Producto", "% Bonif. Neto Total", "a b", "$ 5", "SUMA", "2 u", "IVA", "Unidad", " ", "ñandú"]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def boxes(spark):
    """The pages of the fixtures, and pages with random cells: tilted ones, cells in two boxes, boxes of several heights, overlaps."""
    r = random.Random(5)
    data = [(name, k, a, b, y, h, s, t) for name, k, _, _, a, b, y, h, s, t in fixtures.page_rows()]
    for d in range(40):
        k, header, lefts = 0, r.randint(0, 3), [20 + 150 * i for i in range(r.randint(1, 8))]
        for i in range(r.randint(1, 9)):
            for x in (float(c + q * 60 + r.choice([0, 0, 0, 3, -5])) for c in lefts if r.random() < 0.85 for q in range(1 if r.random() < 0.8 else 2)):
                y = 40.0 + 30 * i + r.choice([0, 0, 1, -1, 2, 6.5]) + 0.003 * x * (d % 3 == 0)
                data.append((f"r{d}", k, x, x + r.choice([40.0, 55.0, 59.0, 100.0, 170.0]), y, r.choice([20.0, 22.0, 22.0, 24.0]), 0.9, WORDS[r.randint(0, 7)] if i == header else r.choice(WORDS)))
                k += 1
    r.shuffle(data)
    return spark.createDataFrame(data, "doc_id string, box_id int, x0 double, x1 double, y double, height double, score double, txt string")


def normal(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return {k: normal(x) for k, x in v.items()}
    return [normal(x) for x in v] if isinstance(v, list) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("mode, b, tol", [("x", 0.0, None), ("x", None, None), ("x", 0.0, 8.0), ("posicional", 0.0, None)])
def test_same_as_operators(spark, boxes, mode, b, tol):
    want = {r.doc_id: normal(r) for r in items.extract(stored(rows.group_rows(boxes, tol=tol, b=b), "rows"), mode).collect()}
    got = {r.doc_id: normal(r) for r in pages.extract(pages.parts(boxes), tol=tol, b=b, mode=mode).collect()}
    assert len(want) == 47 and got == want


def test_numbers(spark):
    r = random.Random(3)
    odd = ["".join(r.choice("0123456789.,.,-+%$ _eE") for _ in range(r.randint(1, 9))) for _ in range(500)]
    odd += ["nan", "-nan", "INF", "+inf", "1_0", "١٢,5", "\xa01,5\xa0", "5,0000 U", "x 3 y", "", "1.234.567", "1,234,567", "12\n", None]
    got = spark.createDataFrame([(v,) for v in odd], "v string").select("v", values.number(F.col("v")).alias("n"), values.loose_number(F.col("v")).alias("l")).collect()
    assert [repr((r.n, r.l)) for r in got] == [repr((values.plain_number(v), values.plain_loose_number(v))) for v in odd]


def test_pages_across_batches(spark, boxes):
    """A page in many parts, over more than one batch, is one page."""
    parts = boxes.repartition(1, "doc_id").sortWithinPartitions("doc_id").select("doc_id", F.array(F.struct(*pages.BOX)).alias("b"))
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(map(str, pages.extract(parts, b=0.0).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert got == sorted(map(str, pages.extract(pages.parts(boxes), b=0.0).collect()))


@pytest.mark.parametrize("jitter", [True, False])
def test_invoice_parts(spark, jitter):
    lines = synth.order_lines(spark, SF)
    a = synth.invoice_boxes(lines, jitter).select("doc_id", *pages.BOX)
    b = synth.invoice_parts(lines, jitter).select("doc_id", F.inline("b"))
    assert a.count() == b.count() and not a.exceptAll(b).count()


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("docgrid-")


#: Queries that deal lines by page once and store nothing.
ONCE = ["box_to_column", "column_bands_header", "column_naming", "items_positional", "items_conflicts", "items_discarded", "items_extract", "items_tilted", "notices", "readable_map"]


@pytest.mark.parametrize("name", ONCE)
def test_dealt_once(spark, name):
    found = queries.QUERIES.get(name) or __import__("docgrid.plans.report_queries", fromlist=["QUERIES"]).QUERIES[name]
    assert exchanges(found(spark, SF)) == (1, 0)


def test_standardise(spark, boxes):
    """Titles named where the page is read: as items.standardise does it, for pages with a header, without one, and whose names are not enough."""
    extra = [(80, [("Codigo", 20, 120), ("Q1", 180, 260), ("Q2", 300, 400)]), (120, [("K-1", 20, 110), ("3", 200, 215), ("DOS", 300, 390), ("glued", 20, 400)]), (150, [("K-2", 20, 400)])]
    odd = {"weak": [(40, [("zz", 20, 60), ("Q4", 90, 130)]), *extra], "poor": [(80, [("Codigo", 20, 120), ("Cantidad", 180, 260), ("Q2", 300, 400)]), *extra[1:]], "alone": [(80, [("Q1", 20, 120), ("Q2", 180, 260)])], "nothing": [(80, [("??", 20, 120)]), *extra[1:]]}
    more = [(name, k, a, b, y, h, s, t) for name, k, _, _, a, b, y, h, s, t in fixtures.page_rows(odd)]
    t = boxes.unionByName(spark.createDataFrame(more, boxes.schema))
    names = {"Codigo": "codigo", "Cantidad": "cantidad", "Q1": "cantidad", "Q2": "descripcion", "Q4": "importe", "Detalle": "iva", "K-1": "codigo", "10,00": "importe"}

    def asked(titles):
        known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
        return titles.select("doc_id", F.transform("titles", lambda x: F.try_element_at(known, x)).alias("names"))

    want = {r.doc_id: normal(r) for r in items.standardise(stored(rows.group_rows(t, b=0.0), "rows"), asked).collect()}
    got = {r.doc_id: normal(r) for r in pages.standardise(pages.parts(t), lambda: lambda titles: [names.get(x) for x in titles], b=0.0).collect()}
    named = {d for d, r in want.items() if r["avisos"]["origen_mapa"] == "llm"}
    assert got == want and len(want) == 51 and {"weak", "poor", "alone"} <= named and "nothing" not in named and "lamps" not in named


def test_standardise_asks_for_poor_pages_only(spark, boxes):
    def refuse():
        def f(titles):
            raise AssertionError(titles)

        return f

    rich = pages.parts(boxes.where("doc_id in ('lamps', 'screws')"))
    assert {r.avisos.origen_mapa for r in pages.standardise(rich, refuse, b=0.0).collect()} == {"alias"}
    short = pages.parts(boxes.where("doc_id = 'unreadable'"))
    none = pages.standardise(short, lambda: lambda titles: None, b=0.0).first()
    few = pages.standardise(short, lambda: lambda titles: ["codigo"], b=0.0).first()
    assert none.avisos.error and few.avisos.origen_mapa == "llm" and few.avisos.error is None


def test_standardise_model_dealt_once(spark):
    from docgrid.plans import report_queries

    assert exchanges(report_queries.standardise_model(spark, SF)) == (1, 0)
