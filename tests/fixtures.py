"""Small pages with known answers: rows of (y, cells), a cell is (text, x0, x1)."""

#: Two titles without data, a description in two boxes, a last row that is no item.
LAMPS = [
    (80, [("Código", 20, 120), ("Cantidad", 180, 260), ("Detalle", 300, 500), ("P. Unit.", 820, 930), ("Bonif. %", 980, 1060), ("Total", 1150, 1260), ("Alicuota", 1320, 1400)]),
    (120, [("K-100", 20, 110), ("3", 200, 215), ("LAMPARA DE MESA NEGRA", 300, 760), ("1.250,50", 830, 930), ("3.751,50", 1160, 1265)]),
    (155, [("K-205", 20, 110), ("12", 200, 215), ("SOPORTE METALICO", 300, 560), ("PARA ESTANTE 30 CM", 572, 800), ("99,90", 830, 930), ("1.198,80", 1160, 1265)]),
    (190, [("M-310", 20, 110), ("1", 200, 215), ("ESPEJO OVAL", 300, 720), ("7.400,00", 830, 930), ("7.400,00", 1160, 1265)]),
    (225, [("SUMA Y SIGUE", 820, 960), ("12.350,30", 1160, 1265)]),
]
#: The code in the third column, discounts of zero, a note as last row.
SCREWS = [
    (90, [("Cant.", 20, 90), ("Unidad", 120, 200), ("Articulo", 240, 330), ("Concepto", 380, 520), ("% Dto", 800, 870), ("Precio", 930, 1010), ("Importe", 1130, 1220)]),
    (130, [("10,00", 25, 90), ("KG", 150, 175), ("T-4410", 240, 325), ("TORNILLO ZINCADO 5X40", 380, 690), ("0,00", 810, 870), ("1.320,5000", 920, 1015), ("13.205,00", 1120, 1225)]),
    (165, [("3,00", 25, 90), ("KG", 150, 175), ("T-5521", 240, 325), ("ARANDELA PLANA M8", 380, 700), ("0,00", 810, 870), ("845,2500", 920, 1015), ("2.535,75", 1120, 1225)]),
    (200, [("25,00", 25, 90), ("KG", 150, 175), ("T-6600", 240, 325), ("TUERCA M8", 380, 640), ("0,00", 810, 870), ("12,00", 920, 1015), ("300,00", 1120, 1225)]),
    (235, [("ENTREGA: DEPOSITO 4", 380, 690)]),
]
#: A loose text above the header, two titles for the price, a discount.
SOAP = [
    (50, [("Duplicado", 20, 120)]),
    (95, [("Codigo", 20, 110), ("EAN", 150, 280), ("Detalle", 330, 480), ("Cantidad", 760, 850), ("Precio", 900, 1030), ("% Bonif.", 1080, 1200), ("Neto Unitario", 1250, 1400), ("Importe", 1450, 1570)]),
    (140, [("88120", 20, 100), ("7790011223344", 150, 285), ("JABON LIQUIDO 1 L", 330, 700), ("4,00", 770, 850), ("250,00", 910, 1030), ("10,00", 1090, 1200), ("225,00", 1260, 1400), ("900,00", 1460, 1570)]),
]
#: Two lines that ran together.
FUSED = [*LAMPS[:-1], (225, [("K-411", 20, 60), ("K-412", 64, 110), ("5", 200, 207), ("6", 209, 215), ("PORTARRETRATO DE MADERA", 300, 700), ("310,00", 830, 930), ("3.410,00", 1160, 1265)])]
UNREADABLE = [(80, [("~~~~", 20, 110), ("@@", 180, 260)]), (120, [("K-100", 20, 110), ("3", 200, 215)])]
#: One box with three titles over three columns, and two columns whose boxes touch.
GLUED = [
    (100, [("Codigo", 30, 130), ("Producto", 150, 420), ("Cant.", 500, 560), ("P. Unit.", 600, 700), ("% Bonif. Neto Total", 720, 1000)]),
    *((140 + 30 * k, [(f"{k}00", 30, 130), ("COSA", 150, 420), ("2,00", 500, 560), ("10,00", 600, 700), ("0,00", 720, 800), ("20,00", 850, 1000)]) for k in range(4)),
]
TOUCHING = [(100, [("Codigo", 0, 100), ("Producto", 100, 400), ("Importe", 500, 600)]), *((140 + 30 * k, [(f"{k}1", 0, 100), ("COSA BUENA", 100, 400), ("5,00", 500, 600)]) for k in range(5))]
PAGES = {"lamps": LAMPS, "screws": SCREWS, "soap": SOAP, "fused": FUSED, "unreadable": UNREADABLE, "glued": GLUED, "touching": TOUCHING}


def page_rows(pages=None):
    """(doc_id, box_id, row_id, pos, x0, x1, y, height, score, txt)."""
    for name, page in (pages or PAGES).items():
        k = 0
        for i, (y, cells) in enumerate(page):
            for p, (t, a, b) in enumerate(cells):
                yield name, k, i, p, float(a), float(b), float(y), 22.0, 0.99, t
                k += 1


ROWS = "doc_id string, box_id int, row_id int, pos int, x0 double, x1 double, y double, height double, score double, txt string"
