"""Operator 3: secret scans, with DataFrame functions only.

Base spans come from three patterns (assign, access, hex), leftmost and non-overlapping per kind. The method
adds `entropy` spans: candidate strings are runs of at least `window` characters of a base64 alphabet.
Each candidate belongs to a character class (hex, base32 or base64) with a threshold of its own. A window slides over the
candidate; the sum of n log2 n over its counts is kept up to date from the count of the character that comes in and of the one that
goes out, in whole numbers, so it does not drift. The span is the candidate, if it holds letters and digits and the best of its windows reaches the class's threshold.

Allow-list: a candidate that is as a whole a UUID, a path of words, digits and dashes, a published checksum or a documentation key is
suppressed (ALLOW). Words like `example` and runs of one character suppress only the windows that overlap them (ALLOW_PART): windows slide over the
pieces between, so a key joined to such a part is still found. Base spans are never suppressed.

Positions are code points, ends exclusive. Null and empty texts have no spans; an empty table gives no rows. Texts of any length are scanned whole: folds
over matches go in blocks, so their cost is about linear in the number of matches. Each row is judged by itself;
ties (kinds that start together) are ordered assign, access, hex, entropy. Extra columns pass through; one with the name
of the added column is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.llm.common import free_name, table

#: Kind: (pattern, group whose length counts, least length). Fixed by the contract; a look at the first letter spares the alternatives at most places.
BASE = {
    "assign": (r"""(?=[AaPpSsTt])(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
WINDOW = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}"
#: Class: (pattern of the whole candidate, least entropy of a window in bits). The first that fits holds.
CLASSES = {"hex": (r"^[0-9a-fA-F]+$", 3.0), "base32": (r"^[A-Z2-7]+=*$", 3.3), "base64": (r"^[A-Za-z0-9+/_=-]+$", 3.6)}
#: Candidates that match any of these are not secrets.
ALLOW = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^.{1,33}EXAMPLE(?:KEY)?$",
    r"^/?(?:[A-Za-z_-]{2,}/)+[A-Za-z_-]*$",
    r"^[0-9-]+$",
    r"^sha(?:256|512)-",
)
#: Windows that overlap a match of this do not count.
ALLOW_PART = r"(?i:example|placeholder|changeme|your[_-])|(.)\1{7,}"
#: Matches, and spans to replace, in a block of a fold: a fold copies what it has gathered at each step.
BLOCK, REDACT_BLOCK = 32, 1024
#: Entropy sums are whole numbers of this part of a bit.
UNIT = 1 << 32


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value evaluated once. It is copied: only for small ones."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def cut(items: Column, size: int) -> Column:
    """An array, not empty, cut into arrays of `size`."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int")), lambda k: F.slice(items, k * size + 1, F.lit(size)))


def blocks(items: Column, size: int) -> Column:
    """An array, not empty, cut into arrays of `size`. In two steps: a slice walks over all of the array that it is taken from."""
    return F.flatten(F.transform(let(items, lambda x: cut(x, size * 64)), lambda part: cut(part, size)))


def before(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of numbers, what `add` makes of those before it, from 0 on."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, start, lambda acc, v: F.struct(add(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of a pattern's leftmost non-overlapping matches. It never matches nothing."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
    steps = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("value")), lambda x: x["value"].isNotNull())
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.char_length(x["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    def whole(cuts: Column) -> Column:
        length = F.transform(cuts, lambda of: F.aggregate(of, F.lit(0), lambda n, x: n + x["gap"] + F.char_length(x["value"])))
        starts = before(length, lambda at, n: at + n)
        return F.flatten(F.zip_with(cuts, starts, lambda of, at: F.aggregate(of, F.struct(at.alias("at"), none.alias("out")), step)["out"]))

    return F.when(F.size(found) > 0, let(blocks(steps, BLOCK), whole)).otherwise(none)


def window_entropy(value: Column, window: int) -> Column:
    """Largest Shannon entropy, in bits, of a string's windows; null if it is shorter than one. The window moves by one character out and one in."""
    terms = [round(UNIT * n * math.log2(n)) if n else 0 for n in range(window + 1)]
    grows = F.array(*(F.lit(b - a) for a, b in pairwise(terms)))  # by count before

    def count(s: Column, c: Column) -> Column:
        return F.char_length(s) - F.char_length(F.replace(s, c))

    def step(acc: Column, c: Column) -> Column:
        full = F.char_length(acc["window"]) == window
        rest = F.when(full, F.substring(acc["window"], 2, window - 1)).otherwise(acc["window"])

        def moved(rest: Column) -> Column:
            left = F.when(full, acc["sum"] - F.get(grows, count(rest, F.substring(acc["window"], 1, 1)))).otherwise(acc["sum"])
            return F.struct(F.concat(rest, c).alias("window"), (left + F.get(grows, count(rest, c))).alias("sum"))

        def better(m: Column) -> Column:
            least = F.when(F.char_length(m["window"]) == window, F.least(acc["least"], m["sum"])).otherwise(acc["least"])
            return F.struct(m["window"].alias("window"), m["sum"].alias("sum"), least.alias("least"))

        return let(let(rest, moved), better)

    zero = F.struct(F.lit("").alias("window"), F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("least"))
    least = F.aggregate(F.filter(F.split(value, ""), lambda c: c != ""), zero, step)["least"]
    return F.lit(math.log2(window)) - least / (window * UNIT)


def entropy_spans(text: Column, window: int) -> Column:
    def secret(x: Column) -> Column:
        v = x["value"]
        least = F.lit(None).cast("double")
        for pattern, bits in reversed(CLASSES.values()):
            least = F.when(v.rlike(pattern), F.lit(bits)).otherwise(least)
        fits = v.rlike("[0-9]") & v.rlike("[A-Za-z]")
        for pattern in ALLOW:
            fits = fits & ~v.rlike(pattern)
        pieces = F.filter(F.split(v, ALLOW_PART), lambda p: F.char_length(p) >= window)
        best = F.array_max(F.transform(pieces, lambda p: window_entropy(p, window)))
        return F.when(fits, F.coalesce(best >= least, F.lit(False))).otherwise(F.lit(False))

    return F.filter(matches(text, CANDIDATE % window), secret)


def scan(df: DataFrame, text: str = "text", out: str = "secrets", window: int = WINDOW) -> DataFrame:
    """Add an array of (start, kind order, kind, end, value), sorted by start and kind."""
    body = free_name(df, "body")
    df = df.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    t = F.col(body)
    kinds = []
    for order, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        kinds.append(_named(_long_enough(matches(t, pattern), pattern, group, least), order, kind))
    kinds.append(_named(entropy_spans(t, window), len(BASE), "entropy"))
    return df.withColumn(out, F.array_sort(F.concat(*kinds))).drop(body)


def _long_enough(spans: Column, pattern: str, group: int, least: int) -> Column:
    return F.filter(spans, lambda x: F.char_length(F.regexp_extract(x["value"], pattern, group) if group else x["value"]) >= least)


def _named(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text", secrets: str = "secrets", mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by a mark; spans that overlap or touch become one."""
    whole = F.col(text)

    def step(a: Column, x: Column) -> Column:
        new = (x["start"] > a["at"]) | ~a["any"]
        kept = F.substring(a["part"], a["at"] - a["first"] + 1, F.greatest(x["start"] - a["at"], F.lit(0)))
        out = F.when(new, F.concat(a["out"], kept, F.lit(mark))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.lit(True).alias("any"), out.alias("out"), a["first"].alias("first"), a["part"].alias("part"))

    def replaced(of: Column, first: Column) -> Column:
        """The text from `first` to the block's last end, done on that part alone."""
        part = F.substring(whole, first + 1, F.greatest(last(of) - first, F.lit(0)))
        return F.aggregate(of, F.struct(first.alias("at"), (first > 0).alias("any"), F.lit("").alias("out"), first.alias("first"), part.alias("part")), step)["out"]

    def last(of: Column) -> Column:
        return F.array_max(F.transform(of, lambda x: x["end"]))

    def joined(cuts: Column) -> Column:
        return F.array_join(F.zip_with(cuts, before(F.transform(cuts, last), F.greatest), replaced), "")

    tail = F.substring(whole, last(F.col(secrets)) + 1, F.char_length(whole))
    return F.when(F.size(secrets) > 0, F.concat(let(blocks(F.col(secrets), REDACT_BLOCK), joined), tail)).otherwise(whole)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text of documents."""
    docs = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return docs.select(
        "doc_id",
        *(count_kind(F.col("secrets"), k).alias(f"n_{k}") for k in BASE),
        F.sha2(span_list(F.filter("secrets", lambda x: x["kind"] != "entropy")).cast("binary"), 256).alias("base_sha256"),
        span_list(F.col("secrets")).alias("spans"),
        count_kind(F.col("secrets"), "entropy").alias("n_entropy"),
    )
