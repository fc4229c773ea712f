"""Normalising names and codes; string similarity."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _accents() -> tuple[str, str]:
    """Letters up to U+024F that decompose into an ASCII letter and marks, and these letters."""
    pairs = [(chr(cp), base) for cp in range(0xC0, 0x250) if (base := unicodedata.normalize("NFKD", chr(cp))[0]) != chr(cp) and base.isascii() and base.isalpha() and all(unicodedata.combining(c) for c in unicodedata.normalize("NFKD", chr(cp))[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def normalize_text(column: Column) -> Column:
    """Lower case without accents: other characters outside ASCII go, runs of white space become one space.

    A native expression, exact for Latin letters with marks; ``normalize_text_exact`` decomposes everything.
    """
    plain = F.regexp_replace(F.translate(column, ACCENTED, PLAIN), r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(F.lower(plain), r"\s+", " "))


@F.pandas_udf(T.StringType())
def normalize_text_exact(column: pd.Series) -> pd.Series:
    """``normalize_text`` with full compatibility decomposition."""
    return column.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().lower().split()))


def normalize_code(column: Column, width: int = 7) -> Column:
    """The digits of a code (a trailing ``.0`` aside), padded with zeros to ``width``; never cut; '' without digits."""
    digits = F.regexp_replace(F.regexp_replace(F.coalesce(column.cast("string"), F.lit("")), r"\.0$", ""), "[^0-9]", "")
    return F.when(digits == "", "").when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)


def optional_int(column: Column) -> Column:
    """The digits as an integer, or null."""
    return F.nullif(F.regexp_replace(column.cast("string"), "[^0-9]", ""), F.lit("")).try_cast("int")


def split_list(column: Column, separator: str = ";") -> Column:
    """Trimmed parts that aren't blank; null gives an empty array."""
    parts = F.transform(F.split(F.coalesce(column, F.lit("")), separator), lambda x: F.trim(x))  # trim takes two arguments
    return F.filter(parts, lambda x: x != "")


@F.pandas_udf(T.DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two strings, to 6 decimals; null is empty. The order of the arguments matters."""
    pairs = zip(left.fillna(""), right.fillna(""))
    return pd.Series([round(difflib.SequenceMatcher(None, a, b).ratio(), 6) for a, b in pairs], dtype="float64")


def similarity_bound(left: Column, right: Column) -> Column:
    """No pair's ratio is larger: 2 min / (sum of the lengths). Native, to spare the exact ratio."""
    a, b = F.length(left), F.length(right)
    return F.coalesce(F.try_divide(2.0 * F.least(a, b), a + b), F.lit(1.0))


def canonical_key(entity: Column, year: Column, month: Column, turn: Column) -> Column:
    """``id:year:mm:turn``, 00 and 0 for a null month and turn; null without an id or a year."""
    key = F.concat_ws(":", entity, year.cast("string"), F.lpad(F.coalesce(month, F.lit(0)).cast("string"), 2, "0"), F.coalesce(turn, F.lit(0)).cast("string"))
    return F.when((F.trim(entity.cast("string")) != "") & year.isNotNull(), key)
