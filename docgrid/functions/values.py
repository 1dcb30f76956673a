"""Values read from paper: numbers with unknown separators, dates, tax ids, document numbers. All native expressions."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgrid.functions.text import SPACE, clean

_DIGITS = r"\d(?:_?\d)*"
#: What can be read as a floating-point number, underscores between digits included.
_FLOAT = rf"^[+-]?(?:(?:{_DIGITS})(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$|(?i)^[+-]?(?:inf|infinity|nan)$"


@lru_cache(1)
def _digit_table() -> tuple[str, str]:
    """Decimal digits of other scripts (BMP), and the ASCII ones."""
    found = [(chr(c), str(unicodedata.digit(chr(c)))) for c in range(0x80, min(0x10000, sys.maxunicode)) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def _count(c: Column, sep: str) -> Column:
    return F.char_length(c) - F.char_length(F.replace(c, F.lit(sep)))


def _last_is_decimal(c: Column, sep: str) -> Column:
    """One separator several times: the last is the decimal point."""
    head = F.regexp_extract(c, rf"(?s)^(.*)\{sep}[^{sep}]*$", 1)
    return F.concat(F.replace(head, F.lit(sep)), F.lit("."), F.substring_index(c, sep, -1))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def number(c: Column) -> Column:
    """Text to double whatever the separators. With both, the later one is the decimal point; one alone parts thousands only if it parts exact groups of three."""
    ends = rf"^{SPACE[4:]}|{SPACE[4:]}$"

    def plain(s: Column) -> Column:
        dots, commas = _count(s, "."), _count(s, ",")
        later_dot = F.instr(F.reverse(s), ".") < F.instr(F.reverse(s), ",")
        return (
            F.when((dots > 0) & (commas > 0), F.when(later_dot, F.replace(s, F.lit(","))).otherwise(F.replace(F.replace(s, F.lit(".")), F.lit(","), F.lit("."))))
            .when(commas > 1, _last_is_decimal(s, ","))
            .when(commas == 1, F.when(s.rlike(r"^-?\d{1,3}(,\d{3})+$"), F.replace(s, F.lit(","))).otherwise(F.replace(s, F.lit(","), F.lit("."))))
            .when(dots > 1, _last_is_decimal(s, "."))
            .when(s.rlike(r"^-?\d{1,3}(\.\d{3})+$"), F.replace(s, F.lit(".")))
            .otherwise(s)
        )

    trimmed = F.translate(F.translate(F.regexp_replace(c, "(?U)" + ends, ""), "%$ ", ""), *_digit_table())
    text = F.regexp_replace(let(trimmed, plain), "(?U)" + ends, "")
    return let(text, lambda s: F.when(s.rlike(_FLOAT), F.replace(s, F.lit("_")).try_cast("double")))


def loose_number(c: Column) -> Column:
    """`number`, or the first word that is one."""
    words = F.split(F.trim(F.regexp_replace(c, SPACE, " ")), " ")
    return F.coalesce(number(c), F.get(F.filter(F.transform(words, number), lambda x: x.isNotNull()), F.lit(0)))


_PLAIN_FLOAT = re.compile(rf"[+-]?(?:(?:{_DIGITS})(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?|[+-]?(?i:inf|infinity)|(?i:nan)", re.ASCII)
_GROUPS = {s: re.compile(rf"-?\d{{1,3}}(\{s}\d{{3}})+", re.ASCII) for s in ".,"}


def plain_number(text: str | None) -> float | None:
    """`number` of one string, for use inside Python functions."""
    if text is None:
        return None
    s = text.strip().translate(_strokes())
    dots, commas = s.count("."), s.count(",")
    if dots and commas:
        s = s.replace(",", "") if s.rfind(".") > s.rfind(",") else s.replace(".", "").replace(",", ".")
    elif dots or commas:
        sep = "," if commas else "."
        if dots + commas > 1:  # the last is the decimal point
            head, _, tail = s.rpartition(sep)
            s = head.replace(sep, "") + "." + tail
        elif _GROUPS[sep].fullmatch(s):
            s = s.replace(sep, "")
        else:
            s = s.replace(sep, ".")
    s = s.strip()
    return float(s.replace("_", "")) if _PLAIN_FLOAT.fullmatch(s) else None


@lru_cache(1)
def _strokes() -> dict:
    return str.maketrans(dict(zip(*_digit_table(), strict=True)) | dict.fromkeys("%$ ", ""))


def plain_loose_number(text: str | None) -> float | None:
    """`loose_number` of one string."""
    whole = plain_number(text)
    if whole is not None or text is None:
        return whole
    return next((x for w in text.split() if (x := plain_number(w)) is not None), None)


_DATE = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})$"


def date(c: Column) -> Column:
    """d/m/y to DD/MM/ and the year as it stands; anything else passes."""
    s = clean(c)
    part = [F.regexp_extract(s, _DATE, i) for i in (1, 2, 3)]
    return F.when(s.rlike(_DATE), F.concat_ws("/", F.lpad(part[0], 2, "0"), F.lpad(part[1], 2, "0"), part[2])).otherwise(s)


def tax_id(c: Column) -> Column:
    """Eleven digits as 99-99999999-9; anything else passes."""
    s = clean(c)
    d = F.regexp_replace(s, r"\D", "")
    return F.when(F.char_length(d) == 11, F.concat_ws("-", F.substring(d, 1, 2), F.substring(d, 3, 8), F.substring(d, 11, 1))).otherwise(s)


def split_number(numero: Column, punto_venta: Column) -> Column:
    """struct(punto_venta, numero): `A-B` of digits is cut at its last dash; a point of sale that is there stays."""
    left, right = (F.regexp_extract(numero, r"(?s)^(.*)-([^-]*)$", i) for i in (1, 2))
    cut = F.coalesce(left.rlike(r"^\d+$") & right.rlike(r"^\d+$"), F.lit(False))
    return F.struct(
        F.when(cut, F.coalesce(F.nullif(punto_venta, F.lit("")), left)).otherwise(punto_venta).alias("punto_venta"),
        F.when(cut, right).otherwise(numero).alias("numero"),
    )


def arrange_type(clase: Column, letra: Column) -> Column:
    """struct(clase, letra): a letter that is none is the class; a letter at the end of the class comes off."""
    no_letter = F.coalesce((letra != "") & ~letra.rlike("^[A-Ma-m]$"), F.lit(False))
    c1 = F.when(no_letter, F.coalesce(F.nullif(clase, F.lit("")), letra)).otherwise(clase)
    l1 = F.when(no_letter, F.lit(None)).otherwise(F.nullif(letra, F.lit("")))
    tail = r"^(.*?)\s+([A-M])$"
    cut = F.coalesce(l1.isNull() & c1.rlike(tail), F.lit(False))
    return F.struct(
        clean(F.when(cut, F.regexp_extract(c1, tail, 1)).otherwise(c1)).alias("clase"),
        F.upper(F.when(cut, F.regexp_extract(c1, tail, 2)).otherwise(l1)).alias("letra"),
    )


@F.pandas_udf(T.DoubleType())
def round2(s: pd.Series) -> pd.Series:
    """Two decimals, correctly rounded from the binary value: Spark's own rounding works on the decimal text."""
    return s.map(lambda v: round(v, 2), na_action="ignore")
