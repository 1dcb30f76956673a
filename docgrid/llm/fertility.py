"""Operator 1: quality rules from tokeniser fertility.

A public SentencePiece vocabulary with byte fallback splits each word of a text. Per text this gives characters
per token, the share of byte-fallback tokens, and the Shannon entropy (bits) of its token ids. A second vocabulary, byte-level BPE for many
languages, splits the lower-cased words without ASCII signs and digits and gives letters per token. Base counts of words, symbols and
repetition go with them, and texts that fail the base rules are not kept.

Bands are fitted to the corpus: of all texts that pass the base rules, by script, language label and length class (doublings of the number of tokens, as
short texts scatter more), each measure's quartiles are read from counts of its values in steps, summed in Spark over all rows. A band reaches
from the median WIDTH robust deviations down and up (each side by its own quartile, and no less than LEAST_SPREAD). A group of fewer than LEAST_GROUP texts has the
band of its language, else of its script. Beside them hold the fixed bands of the script (BANDS, FLOORS), which stand alone where there is too little to
fit; their least entropy grows with the logarithm of the number of tokens up to FULL_TOKENS. A text outside a band is rejected.

Words are `[^\\x20\\x09-\\x0D]+` of the whole text. A word's tokens are those that it has after one blank, so white space itself never counts as a token and each
distinct word of a batch is split once, however long the text. The main script is the one with the most letters (of equal ones the first in
SCRIPTS); a text without letters has the script `none`. Null and empty texts have no words: all counts are 0,
the measures null, and they fail the base rules. Null labels are a language of their own. Every row is judged by itself, so
repeated rows and ties give equal results; an empty table gives none. Extra columns pass through; those that have the
names of MEASURES are replaced.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from operator import and_

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgrid.llm import bpe
from docgrid.llm.common import free_name, importable, materialise, sliced, table, without_columns
from docgrid.llm.words import NON_SPACE, Words, mix, ngram_hash

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
FULL_TOKENS = 200
#: Fitted bands: robust deviations to each side, fewest texts of a group.
WIDTH, LEAST_GROUP = 6.0, 100
#: Fitted measures: (step in which values are counted, least deviation).
FITTED = {"chars_per_token": (0.005, 0.04), "byte_share": (0.002, 0.02), "token_entropy": (0.01, 0.1), "letters_per_token": (0.005, 0.04)}
#: Bytes of text at a time: the more, the fewer words are split twice.
CHUNK_BYTES = 2 << 20
#: Script: ranges of code points.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "tamil": [(0xB80, 0xBFF)],
    "indic": [(0x980, 0xB7F), (0xC00, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}
#: Script: (least and most characters per token, largest share of byte tokens, least entropy in bits).
BANDS = {
    "latin": (1.0, 12.0, 0.20, 2.0),
    "greek": (0.6, 10.0, 0.20, 2.0),
    "cyrillic": (0.9, 12.0, 0.20, 2.0),
    "hebrew": (0.6, 12.0, 0.20, 1.5),
    "arabic": (0.6, 12.0, 0.30, 1.5),
    "devanagari": (0.5, 12.0, 0.30, 1.5),
    "tamil": (0.5, 12.0, 0.50, 1.5),
    "thai": (0.6, 12.0, 0.30, 1.5),
    "hangul": (0.4, 12.0, 0.50, 1.5),
    "kana": (0.5, 12.0, 0.40, 1.5),
    "han": (0.5, 12.0, 0.50, 1.5),
    "none": (0.3, 30.0, 0.90, 0.0),
}
#: For scripts that neither vocabulary covers (indic): prose and random letters are both mostly bytes there, and cannot be told apart.
OTHER_BAND = (0.2, 12.0, 1.0, 1.5)
#: Script: least letters per token of the second vocabulary. Random letters lie below, prose above.
FLOORS = {
    "latin": 1.68, "greek": 1.3, "cyrillic": 1.28, "hebrew": 1.3, "arabic": 1.05, "devanagari": 0.65, "tamil": 0.85,
    "thai": 0.85, "hangul": 0.75, "kana": 0.87, "han": 0.63,
}
_SIGNS = {i: None for i in range(0x80) if not chr(i).isalpha()}
MEASURES = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "base_failed": "boolean", "kept": "boolean", "script": "string", "n_tokens": "long", "chars_per_token": "double", "byte_share": "double", "token_entropy": "double",
    "letters_per_token": "double",
}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_loaded: dict = {}


@lru_cache(1)
def _script_of() -> np.ndarray:
    t = np.zeros(0x110000, np.uint8)
    for i, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            t[a : b + 1] = i
    return t


def main_script(text: str) -> str:
    n = np.bincount(_script_of()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=len(SCRIPTS) + 1)[1:]
    return list(SCRIPTS)[int(n.argmax())] if n.any() else "none"


def vocabulary(model: bytes):
    """The processor of a model file's bytes, and which of its ids are bytes; one per process."""
    key = hash(model)
    if key not in _loaded:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=model)
        _loaded[key] = p, np.array([p.is_byte(i) for i in range(p.vocab_size())])
    return _loaded[key]


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between neighbours of at."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[at[1:]] - sums[at[:-1]]


def repeated_words(w: Words) -> np.ndarray:
    """By text: words in runs of three that the text holds twice or more."""
    hit = np.zeros(len(w.hash), bool)
    if len(w.hash) >= 3:
        doc = w.doc_of()
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        key = ngram_hash(w.hash, 3)[inside] ^ mix(doc[inside].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(key), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        for k in range(3):
            hit[inside[again] + k] = True
    return per_text(hit, w.doc)


def token_measures(w: Words, model: bytes):
    """By text: tokens, byte tokens, entropy of token ids."""
    n = len(w.doc) - 1
    if not len(w.hash):
        return np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    processor, is_byte = vocabulary(model)
    _, first, place = np.unique(w.hash, return_index=True, return_inverse=True)
    raw = w.buf.tobytes()
    split = processor.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(w.start[first], w.end[first], strict=True)], num_threads=1)
    size = np.array([len(s) for s in split], np.int64)
    flat = np.fromiter((i for s in split for i in s), np.int64, int(size.sum()))
    start = np.cumsum(size) - size
    bytes_in = np.add.reduceat(np.append(is_byte[flat], False).astype(np.int64), np.minimum(start, len(flat))) * (size > 0)
    tokens, byte_tokens = per_text(size[place], w.doc), per_text(bytes_in[place], w.doc)
    # token ids of all words in order
    own = size[place]
    at = np.repeat(start[place] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
    doc = np.repeat(np.arange(n), tokens)
    key = np.sort(doc * len(is_byte) + flat[at])
    if not len(key):
        return tokens, byte_tokens, np.zeros(n)
    run = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    c = np.diff(np.append(run, len(key)))
    weighted = np.bincount(key[run] // len(is_byte), weights=c * np.log2(c), minlength=n)
    entropy = np.where(tokens > 0, np.log2(np.maximum(tokens, 1)) - weighted / np.maximum(tokens, 1), 0.0)
    return tokens, byte_tokens, np.maximum(entropy, 0.0)


def wide_measures(w: Words, ranks: bytes):
    """By text: letters, and tokens of the second vocabulary."""
    n = len(w.doc) - 1
    if not len(w.hash):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    enc = bpe.encoding(ranks, public_tokenizers.PATTERN)
    _, first, place = np.unique(w.hash, return_index=True, return_inverse=True)
    raw = w.buf.tobytes()
    words = [raw[a:b].decode("utf-8", "replace").lower().translate(_SIGNS) for a, b in zip(w.start[first], w.end[first], strict=True)]
    letters = np.array([len(x) for x in words], np.int64)
    tokens = np.array([len(enc.encode_ordinary(f" {x}")) if x else 0 for x in words], np.int64)
    return per_text(letters[place], w.doc), per_text(tokens[place], w.doc)


def measure(texts: pa.Array, model: bytes, ranks: bytes, bands: dict = BANDS, other: tuple = OTHER_BAND, floors: dict = FLOORS) -> list[pa.Array]:
    """The columns of MEASURES; kept says whether the base rules and the fixed bands hold."""
    w = Words(texts, NON_SPACE, lower=False)
    words = w.counts()
    strings = [t or "" for t in texts.to_pylist()]
    chars = per_text(NON_SPACE[w.buf] & ((w.buf & 0xC0) != 0x80), w.at)
    symbols = per_text(_SYMBOL[w.buf], w.at)
    repeats = repeated_words(w)
    failed = (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)
    tokens, in_bytes, entropy = token_measures(w, model)
    letters, wide = wide_measures(w, ranks)
    scripts = [main_script(t) for t in strings]
    some = tokens > 0
    per_token, share = chars / np.maximum(tokens, 1), in_bytes / np.maximum(tokens, 1)
    low, high, most, least = (np.array(x) for x in zip(*[bands.get(s, other) for s in scripts], strict=True))
    least = least * np.minimum(1.0, np.log2(np.maximum(tokens, 1)) / np.log2(FULL_TOKENS))
    fits = (per_token >= low) & (per_token <= high) & (share <= most) & (entropy >= least)
    letters_per_token = letters / np.maximum(wide, 1)
    fits &= letters_per_token >= np.array([floors.get(s, 0.0) for s in scripts])
    doubles = [*(pa.array(x, pa.float64(), mask=~some) for x in (per_token, share, entropy)), pa.array(letters_per_token, pa.float64(), mask=wide == 0)]
    counts = [pa.array(x, pa.int64()) for x in (words, chars, symbols, [duplicate_lines(t) for t in strings], repeats)]
    return [*counts, pa.array(failed), pa.array(~failed & fits & some), pa.array(scripts, pa.string()), pa.array(tokens, pa.int64()), *doubles]


def measured(df: DataFrame, text: str = "text", model: str | None = None, bands: dict = BANDS, other: tuple = OTHER_BAND, ranks: str | None = None, floors: dict = FLOORS, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add the columns of MEASURES to every row, `kept` by the base rules and the fixed bands; leave out columns in `drop`."""
    importable(df.sparkSession)
    df = without_columns(df, *MEASURES)
    left = [f for f in df.schema.fields if f.name not in drop]
    with open(model or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file
    with open(ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        wide = df.sparkSession.sparkContext.broadcast(f.read())
    names = [f.name for f in left]

    def run(batches):
        for part in sliced(batches, text, CHUNK_BYTES):
            made = measure(part.column(part.schema.get_field_index(text)), sent.value, wide.value, bands, other, floors)
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), *made], names=[*names, *MEASURES])

    types = {"long": T.LongType(), "boolean": T.BooleanType(), "string": T.StringType(), "double": T.DoubleType()}
    return df.mapInArrow(run, T.StructType([*left, *(T.StructField(k, types[v]) for k, v in MEASURES.items())]))


def length_class() -> Column:
    return F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int")


def fit_bands(rows: DataFrame, lang: Column, width: float = WIDTH, least_group: int = LEAST_GROUP) -> DataFrame:
    """of_script, of_lang, of_class, n (texts of the group that the band is from), and for each of FITTED low_ and high_: one row for each group that has a band."""
    values = F.array(*(F.struct(F.lit(m).alias("m"), F.round(F.col(m) / step).cast("long").alias("v")) for m, (step, _) in FITTED.items()))
    good = rows.where(~F.col("base_failed") & (F.col("n_tokens") > 0))
    keyed = good.select(F.col("script").alias("of_script"), lang.alias("of_lang"), length_class().alias("of_class"), F.explode(values).alias("x"))
    keys = ["of_script", "of_lang", "of_class"]
    counted = materialise(keyed.where("x.v is not null").groupBy(*keys, "x.m", "x.v").agg(F.count(F.lit(1)).alias("n")), "fertility-counts")

    def level(name: str, by: list[str]) -> DataFrame:
        """By group: low and high of each measure, where the group is large enough."""
        c = counted.groupBy(*by, "m", "v").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*by, "m")
        c = c.withColumn("all", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("v"))).where(F.col("all") >= least_group)
        quarter = [F.min(F.when(4 * F.col("upto") >= k * F.col("all"), F.col("v"))).alias(f"q{k}") for k in (1, 2, 3)]
        q = c.groupBy(*by, "m").agg(*quarter, F.first("all").alias("all"))
        step, least = (F.element_at(F.create_map(*(x for m, v in FITTED.items() for x in (F.lit(m), F.lit(v[i])))), F.col("m")) for i in (0, 1))
        sides = [F.greatest((F.col(a) - F.col(b)) * step / 0.6745, least) * width for a, b in (("q2", "q1"), ("q3", "q2"))]
        q = q.select(*by, "m", "all", (F.col("q2") * step - sides[0]).alias("low"), (F.col("q2") * step + sides[1]).alias("high"))
        one = [F.max(F.when(F.col("m") == m, F.struct(*(F.col(x) for x in ("low", "high", "all"))))).alias(f"{name}_{m}") for m in FITTED]
        return q.groupBy(*by).agg(*one)

    groups = counted.select(*keys).distinct()
    for name, by in (("a", keys), ("b", keys[:2]), ("c", keys[:1])):
        found = level(name, by)
        found = found.select(*(F.col(k).alias(f"{name}_{k}") for k in by), *(f"{name}_{m}" for m in FITTED))
        on = [F.col(k).eqNullSafe(F.col(f"{name}_{k}")) for k in by]
        groups = groups.join(found, reduce(and_, on), "left")
    best = {m: F.coalesce(*(F.col(f"{x}_{m}") for x in "abc")) for m in FITTED}
    return materialise(groups.select(*keys, *(c[x].alias(f"{x}_{m}") for m, c in best.items() for x in ("low", "high"))), "fertility-bands")


def judge(df: DataFrame, text: str = "text", lang: str | None = "lang", drop: tuple[str, ...] = (), width: float = WIDTH, least_group: int = LEAST_GROUP, **fixed) -> DataFrame:
    """Add the columns of MEASURES to every row, with the verdict in `kept`; leave out columns in `drop`."""
    label = next((c for c in df.columns if lang and c.lower() == lang.lower()), None)
    rows = materialise(measured(df, text, drop=drop, **fixed), "fertility", "zstd")
    own = F.col(f"`{label}`").cast("string") if label in rows.columns else F.lit(None).cast("string")
    k = free_name(rows, "band")
    bands = fit_bands(rows, own, width, least_group).select(F.struct("*").alias(k))  # a row per script, language and length class
    band = F.col(k)
    key = F.col("script").eqNullSafe(band["of_script"]) & own.eqNullSafe(band["of_lang"]) & length_class().eqNullSafe(band["of_class"])
    fits = F.lit(True)
    for m in FITTED:
        fits = fits & F.coalesce((F.col(m) >= band[f"low_{m}"]) & (F.col(m) <= band[f"high_{m}"]), F.lit(True))
    return rows.join(bands, key, "left").withColumn("kept", F.col("kept") & fits).drop(k)


def op1_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures of every text of documents."""
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), drop=("text",)).drop("lang")
