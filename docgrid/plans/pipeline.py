"""The whole way: images to items, or saved reader results to an accuracy report."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.operators import boxes, checks, compare, items, report, rows, truth
from docgrid.session import stored


class Replay(NamedTuple):
    rows: DataFrame
    extracted: DataFrame
    checked: DataFrame
    pairs: DataFrame
    verdicts: DataFrame
    accuracy: DataFrame
    summary: DataFrame


def item_table(extracted: DataFrame) -> DataFrame:
    """doc_id, i, the item fields of extract's pages."""
    return extracted.select("doc_id", F.posexplode("items").alias("i", "x")).select("doc_id", "i", "x.*")


def images_to_items(images: DataFrame, find: Callable, crop: Callable, read: Callable, map_titles: Callable | None = None) -> DataFrame:
    """images(path, content) to (doc_id, items, avisos): find gives (path, bbox), crop cuts (path, content, bbox) to (path, content), read gives (path, res)."""
    found = find(images)
    cut = crop(images.join(found, "path"))
    results = read(cut).select(F.col("path").alias("doc_id"), "res")
    return items.standardise(stored(rows.group_rows(boxes.result_boxes(results)), "rows"), map_titles)


def replay(results: DataFrame, truth_files: DataFrame, mode: str = "x") -> Replay:
    """Saved reader results and hand-made truth to everything that is reported. Both sides are kept by doc_id."""
    grouped = stored(rows.group_rows(boxes.boxes(results)), "rows")
    extracted = stored(items.extract(grouped, mode), "items")
    documents = stored(truth.normalise(truth_files), "truth")
    read, true = item_table(extracted), truth.truth_items(documents)
    paired = compare.pairs(read, true)
    verdicts = compare.judged(paired)
    scores = compare.accuracy(verdicts, extracted)
    checked = checks.arithmetic(read)
    n_rows = grouped.groupBy("doc_id").agg(F.countDistinct("row_id").alias("filas_ocr"))
    n_true = documents.select("doc_id", F.size("items").alias("esperados"))
    return Replay(grouped, extracted, checked, paired, verdicts, scores, report.summary(extracted, n_rows, checked, scores, n_true))
