"""Corpus pipeline: documents through five stages, each written as Parquet and read back by the next.

langid: documents without letters, or whose language is uncertain, go. near_duplicates: one document of each
class stays. decontaminate: documents contaminated by the benchmark go. secrets: spans are replaced by a mark, n_chars follows.
byte_bpe: ids are added and decoded back. Each stage judges every row it gets, by text and not by place; nulls in other
columns do not matter. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.llm import bpe, decontaminate, langid, ngram_join, secrets
from docgrid.llm.common import free_name, materialise, table, without_rows


def stage_langid(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a learned language of at least MIN_SCORE."""
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    found = langid.predict(docs, langid.fit(langid.training_rows(docs)), lang=lang, score=score)
    return found.where((F.col(lang) != "und") & (F.col(score) >= langid.MIN_SCORE)).select(*docs.columns)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each class."""
    return ngram_join.first_of_each(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated documents. Proximity matches are looked for as well; the verdict counts exact hits, so that clean documents stay."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return without_rows(docs, found.where("contaminated").select("id", "a", "b"))


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the text."""
    spans = free_name(docs, "secret_spans")
    found = secrets.scan(docs, out=spans)
    found = found.withColumn("text", secrets.redact(found, secrets=spans)).drop(spans)
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else found


def stage_byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the ids, their number, and a checksum of what they decode to."""
    ids, decoded = free_name(docs, "ids"), free_name(docs, "decoded")
    both = bpe.decode(bpe.encode(docs, ids=ids), ids=ids, out=decoded)
    return both.withColumn("n_tokens", (F.octet_length(ids) / 4).cast("long")).withColumn("decoded_sha256", F.sha2(decoded, 256)).drop(decoded)


STAGES = [
    ("langid", stage_langid),
    ("near_duplicates", stage_near_duplicates),
    ("decontaminate", stage_decontaminate),
    ("secrets", stage_secrets),
    ("byte_bpe", stage_byte_bpe),
]

#: SQL cannot express the first two stages; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
