"""Readers and models outside the engine. They are given as functions, made once per worker; nothing here calls a network.

make_reader() gives read(content, **options) -> {rec_polys, rec_texts, rec_scores}; make_model() gives ask(prompt, image or None) -> text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.functions.bbox import BBOX, CORNERS, FLAG, parse
from docgrid.functions.text import plain_key
from docgrid.operators.boxes import RESULT
from docgrid.schema import ITEM_FIELDS
from docgrid.session import importable

READER_OPTIONS = {"lang": "es", "unwarping": False, "rotacion": False, "unclip": 2.5}
# What a model is told again after a useless answer.
KEYS_HINT = "\nUse exactly the keys contiene_tabla, x_min, y_min, x_max, y_max."
WHOLE_HINT = "\nThe last answer was the whole image. Give only the rectangle of the item rows, or contiene_tabla false."
SMALL_HINT = "\nThe last rectangle was too small. Give the whole item table."
BBOX_PROMPT = "Give the bounding box of the item table of this invoice, 0-1000, with its header row, as JSON: contiene_tabla, x_min, y_min, x_max, y_max. Not the whole image; contiene_tabla false if there is no item table."
TITLES_PROMPT = "Column titles of an invoice's item table, numbered. Answer with JSON only: index to one of {fields}; leave out what fits none.\n\n{titles}"


@lru_cache(8)
def engine(make: Callable, options: tuple = ()) -> Callable:
    """One engine per worker and options."""
    return make(**dict(options))


def read_images(images: DataFrame, make_reader: Callable, **options) -> DataFrame:
    """path, res of images(path, content)."""
    importable(images.sparkSession)
    chosen = tuple(sorted((READER_OPTIONS | options).items()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = engine(make_reader, chosen)
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "res": [read(c) for c in b["content"]]})

    return images.select("path", "content").mapInPandas(run, f"path string, res {RESULT}")


def find_table(ask: Callable, image: bytes | None, retries: int = 1) -> dict | None:
    """The table's rectangle from a model: what it is told again depends on what was wrong; a plain no ends it."""
    hint = ""
    for _ in range(retries + 1):
        box = parse(ask(BBOX_PROMPT + hint, image))
        if box is None:
            hint = KEYS_HINT
            continue
        if not box[FLAG]:
            return None
        wide, high = box["x_max"] - box["x_min"], box["y_max"] - box["y_min"]
        whole = max(0.0, wide / 1000) * max(0.0, high / 1000) > 0.90
        if wide >= 150 and high >= 15 and not whole:
            return box
        hint = WHOLE_HINT if whole else SMALL_HINT
    return None


def find_tables(images: DataFrame, make_model: Callable, retries: int = 1) -> DataFrame:
    """path, bbox (null corners where no table was found) of images(path, content)."""
    importable(images.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = engine(make_model)
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "bbox": [find_table(ask, c, retries) or dict.fromkeys((FLAG, *CORNERS)) for c in b["content"]]})

    return images.select("path", "content").mapInPandas(run, f"path string, bbox {BBOX}")


def named_by_model(reply: str | None, n: int) -> list:
    """Fields by title from a reply: digits as keys, known fields, each once."""
    found = re.search(r"\{.*\}", (reply or "").replace("```json", "").replace("```", ""), re.S)
    out: list = [None] * n
    try:
        entries = json.loads(found[0]).items() if found else ()
    except (ValueError, AttributeError):
        return out
    known = {plain_key(f): f for f in ITEM_FIELDS}
    for k, v in entries:
        field = known.get(plain_key(v))
        if str(k).strip().isdigit() and field and field not in out and int(k) < n:
            out[int(k)] = field
    return out


def title_mapper(make_model: Callable) -> Callable[[DataFrame], DataFrame]:
    """For operators.items.standardise: titles(doc_id, titles) to (doc_id, names), one short question per page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = engine(make_model)
        for b in batches:
            names = [named_by_model(ask(TITLES_PROMPT.format(fields=", ".join(ITEM_FIELDS), titles="\n".join(f"{i}: {t}" for i, t in enumerate(ts))), None), len(ts)) for ts in b["titles"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "names": names})

    return lambda titles: titles.mapInPandas(run, "doc_id string, names array<string>")


def best_rotation(turned: DataFrame) -> DataFrame:
    """path, rotacion from readings of each turn(path, angle, res): mean score times the root of the number of boxes; the first angle of equal ones."""
    scores = F.col("res.rec_scores")
    n = F.size(scores)
    mean = F.aggregate(scores, F.lit(0.0), lambda a, s: a + s) / F.greatest(n, F.lit(1))
    t = turned.select("path", "angle", F.when(n > 0, mean * F.sqrt(n)).otherwise(0.0).alias("score"))
    return t.groupBy("path").agg(F.max(F.struct("score", (-F.col("angle")).alias("back"))).alias("best")).select("path", (-F.col("best.back")).alias("rotacion"), F.col("best.score").alias("score"))


def compare_variants(readings: DataFrame, variants: list[str], pattern: str | None = None) -> DataFrame:
    """Texts of readings(path, variant, res) side by side in reading order, those that match the whole pattern; shorter columns end in empty texts."""
    texts = F.col("res.rec_texts")
    kept = texts if pattern is None else F.filter(texts, lambda t: t.rlike(f"^(?:{pattern})$"))
    t = readings.select("path", "variant", F.posexplode(kept).alias("pos", "txt"))
    return t.groupBy("path", "pos").pivot("variant", variants).agg(F.first("txt")).na.fill("", variants)
