"""Similarities that Spark has no expression for, in Arrow batches."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package


@F.pandas_udf(T.DoubleType())
def _matching_blocks(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each sign of ``a``."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        u = row & where.get(ch, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    """0 .. 100: twice the longest common subsequence over both lengths."""
    return 100.0 * 2 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


@F.pandas_udf(T.DoubleType())
def _indel(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StringType())
def _nfc(a: pd.Series) -> pd.Series:
    return a.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def _strip_marks(a: pd.Series) -> pd.Series:
    return a.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def ratio(a: Column, b: Column) -> Column:
    """Similarity of two texts by matching blocks, 0 .. 1; not symmetric."""
    ship_package()
    return _matching_blocks(a, b)


def indel_ratio(a: Column, b: Column) -> Column:
    ship_package()
    return _indel(a, b)


def nfc(a: Column) -> Column:
    ship_package()
    return _nfc(a)


def strip_marks(a: Column) -> Column:
    """Without combining marks."""
    ship_package()
    return _strip_marks(a)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null where one is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.try_divide(dot, norm(a) * norm(b))
