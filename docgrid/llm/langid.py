"""Operator 4: language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of character n-grams (1 to 3, of the lower-cased text with every run of
characters that are not letters made one blank), hashed to `buckets`. The term frequency is the share of
the text's n-grams, so a text's score is a mean of weights over its n-grams and whole texts of any length
are read in bounded memory. Document frequencies are counted over all training rows. Weights are fitted by
follow-the-regularised-leader (FTRL-proximal) with L1 and L2 penalties, on at most `per_class` distinct training texts
of each language: those with the least hashes, so every language has some; a text weighs as many copies as it has, as far as `per_class` goes. That is the documented bound of what
reaches the driver: `per_class` x languages texts as n-gram shares, and at most `max_langs` languages, the most frequent ones.
A part of these texts, never used to fit weights, calibrates the softmax by one temperature.

Training rows: non-null lang, and crc32(doc_id as text) mod 3 is not 1; a null doc_id is neither held out nor learned from.
Null texts and texts without letters are `und` with score 0. With nothing to learn from, every text is `und`. An empty table gives no rows.
Ties go to the first language in alphabetical order. Extra columns pass through; those
that have the names of added columns are replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgrid.llm.common import importable, map_text, materialise, sliced, table, without_columns

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
FIT_PER_CLASS = 600
MAX_LANGS = 500
TEXT_BYTES = 1 << 20
#: Scores under this are not sure enough for the pipeline.
MIN_SCORE = 0.4


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # buckets x langs, with inverse document frequencies multiplied in
    bias: np.ndarray
    temperature: float


_LETTER = np.zeros(0, bool)


def _letters() -> np.ndarray:
    """By code point: is it a letter."""
    global _LETTER
    if not len(_LETTER):
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def grams(text: str, buckets: int) -> tuple[np.ndarray, int]:
    """The buckets of a text's n-grams, one for each place, and the number of its letters."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    n = int(letter.sum())
    if not n:
        return np.zeros(0, np.int64), 0
    c = np.where(letter, c, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.concatenate([np.array([32], np.uint32), c[keep], np.array([32], np.uint32)])
    out = []
    for k in ORDERS:
        h = np.full(len(c) - k + 1, 0x9E3779B9 * k & 0xFFFFFFFF, np.uint32)
        for j in range(k):
            h ^= c[j : len(c) - k + 1 + j]
            h *= np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        if k == 1:
            h = h[c != 32]
        out.append(h & np.uint32(buckets - 1))
    return np.concatenate(out), n


def document_frequency(train: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and the number of texts. Summed in Spark; as many rows as buckets at most come back."""

    def count(batches):
        seen, total, docs = np.zeros(buckets, bool), np.zeros(buckets, np.int64), 0
        for part in sliced(batches, "text", TEXT_BYTES):
            for t in part.column(0).to_pylist():
                g, n = grams(t or "", buckets)
                if n:
                    seen[g] = True
                    total += seen
                    seen[g] = False
                    docs += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], docs))], names=["bucket", "n"])

    importable(train.sparkSession)
    out = np.zeros(buckets, np.int64)
    docs = 0
    for r in train.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if r.bucket < 0:
            docs = r.n
        else:
            out[r.bucket] = r.n
    return out, docs


def sample_texts(train: DataFrame, per_class: int, max_langs: int = MAX_LANGS) -> DataFrame:
    """(text, lang): of each language the `per_class` distinct texts with the least hashes. Hashes are made distinct before they are ranked, so a text with many copies is one row."""
    hashed = train.select("lang", F.xxhash64(F.lit(4), "text").alias("h"), "text")
    langs = hashed.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(max_langs).select("lang")
    distinct = materialise(hashed.select("lang", "h").distinct(), "lang-hashes")
    # of n even hashes the per_class least lie far below four times that share: no task ranks more than about so many of a language
    sizes = distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("n_lang"))
    share = (F.col("h").cast("double") + 2.0**63) * 2.0**-64
    near = distinct.join(F.broadcast(sizes.join(F.broadcast(langs), "lang")), "lang").where(share * F.col("n_lang") <= 4 * per_class + 100)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    least = near.select("lang", "h").withColumn("rank", rank).where(F.col("rank") <= per_class).drop("rank")
    chosen = F.broadcast(least)  # per_class x max_langs rows at most
    return hashed.join(chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("copies")).select("text", "lang", "copies")


def sample_features(train: DataFrame, per_class: int, buckets: int, max_langs: int = MAX_LANGS) -> list:
    """Rows (lang, buckets, shares) of sample_texts, in an order that depends on nothing but them."""
    part = sample_texts(train, per_class, max_langs)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t, lang, copies in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            g, n = grams(t or "", buckets)
            if n:
                at, c = np.unique(g, return_counts=True)
                rows.append((lang, at.astype(np.int32), (c / len(g)).astype(np.float32), copies))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1].tolist() for r in rows], pa.list_(pa.int32())), pa.array([r[2].tolist() for r in rows], pa.list_(pa.float32())), pa.array([r[3] for r in rows], pa.int64())],
            names=["lang", "at", "share", "copies"],
        )

    rows = map_text(part, "text", make, "lang string, at array<int>, share array<float>, copies bigint", TEXT_BYTES).toPandas()
    return sorted(((r.lang, np.asarray(r.at, np.int64), np.asarray(r.share, np.float64), int(r.copies)) for r in rows.itertuples()), key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list, langs: list[str], buckets: int, idf: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, epochs: int = 4, seed: int = 4):
    """Weights and bias by FTRL-proximal with an elastic net."""
    k = len(langs)
    z, n = np.zeros((buckets + 1, k)), np.zeros((buckets + 1, k))
    of = {x: i for i, x in enumerate(langs)}
    rng = np.random.default_rng(seed)

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) <= l1, 0.0, w)

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            lang, at, share = rows[i]
            x = np.append(share * idf[at], 1.0)
            at = np.append(at, buckets)
            w = weights(at)
            p = softmax(x @ w)
            p[of[lang]] -= 1
            g = x[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    every = weights(np.arange(buckets + 1))
    return every[:-1], every[-1]


def calibrate(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its logarithm."""
    if not len(logits):
        return 1.0

    def loss(t):
        p = softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-300)).mean()

    lo, hi, r = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(train: DataFrame, per_class: int = FIT_PER_CLASS, buckets: int = BUCKETS) -> Model:
    """Learn from train(text, lang)."""
    train = train.select("text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    df, docs = document_frequency(train, buckets)
    found = sample_features(train, per_class, buckets)
    texts = Counter(r[0] for r in found)
    # a text counts as often as it occurs, as far as the language's bound goes; the arrays are shared
    rows = [r[:3] for r in found for _ in range(min(r[3], max(1, per_class // texts[r[0]])))]
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros(0), 1.0)
    idf = np.log((1 + docs) / (1 + df)) + 1
    check = [r for i, r in enumerate(rows) if i % 5 == 4]
    learn = [r for i, r in enumerate(rows) if i % 5 != 4]
    # shares are small numbers: bring the mean length of a text's vector to 10
    scale = 10 / max(np.mean([np.linalg.norm(r[2] * idf[r[1]]) for r in rows]), 1e-9)
    w, b = ftrl(learn, langs, buckets, idf * scale)
    w = w * (idf * scale)[:, None]
    logits = np.array([r[2] @ w[r[1]] + b for r in check]).reshape(-1, len(langs))
    return Model(langs, w.astype(np.float32), b, calibrate(logits, np.array([langs.index(r[0]) for r in check], np.int64)))


def identify(texts: list, model: Model) -> tuple[list[str], list[float]]:
    langs, scores = [], []
    for t in texts:
        g, n = grams(t or "", len(model.weights))
        if not n or not model.langs:
            langs.append("und")
            scores.append(0.0)
            continue
        p = softmax((model.weights[g].mean(axis=0, dtype=np.float64) + model.bias) / model.temperature)
        i = int(p.argmax())
        langs.append(model.langs[i])
        scores.append(float(p[i]))
    return langs, scores


def predict(df: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language and its calibrated probability."""
    importable(df.sparkSession)
    df = without_columns(df, lang, score)
    sent = df.sparkSession.sparkContext.broadcast(model)  # buckets x languages, whatever the size of the data

    def run(batches):
        for part in sliced(batches, text, TEXT_BYTES):
            a, b = identify(part.column(part.schema.get_field_index(text)).to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(a, pa.string()), pa.array(b, pa.float64())], names=[*part.schema.names, lang, score])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("text", "lang")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of documents."""
    docs = table(spark, sf_dir, "documents")
    model = fit(training_rows(docs))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
