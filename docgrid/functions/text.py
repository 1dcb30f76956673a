"""Text made comparable: accents, keys, white space."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python's str knows it.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def fold(s: str) -> str:
    """Without nonspacing marks, after canonical decomposition."""
    return "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")


@lru_cache(1)
def _single_folds() -> tuple[str, str]:
    """BMP characters that fold to one other character, and those."""
    pairs = [(c, f) for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]) if len(f := fold(c)) == 1 and f != c]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@F.pandas_udf(T.StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(fold, na_action="ignore")


def strip_accents(text: Column | str) -> Column:
    """Exact for all of Unicode; Spark has no decomposition of its own. ASCII texts do not leave the JVM."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(_fold(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def key(c: Column) -> Column:
    """Comparable key: no accents, lower case, only a-z and 0-9. Native: what folds to several characters is dropped here anyway."""
    plain = F.regexp_replace(F.translate(c, *_single_folds()), r"\p{Mn}+", "")
    return F.regexp_replace(F.lower(plain), "[^a-z0-9]", "")


@lru_cache(100_000)
def plain_key(s) -> str:
    """`key` of one string, for use inside Python functions."""
    return "".join(c for c in fold(str(s)).lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")


def clean(c: Column) -> Column:
    """White space to single blanks, trimmed; empty is null."""
    return F.nullif(F.trim(F.regexp_replace(c, SPACE, " ")), F.lit(""))


def folded_upper(c: Column) -> Column:
    """For comparing texts: no accents, upper case, single blanks; empty stays empty."""
    return F.trim(F.regexp_replace(F.upper(strip_accents(c)), SPACE, " "))
