"""Ratcliff-Obershelp similarity as an Arrow UDF, for pairs that survived the
exact and length filters."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxweave.refdata import corpus


def ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of each pair; equal pairs inside a batch are computed once."""
    seen: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a, b):
        if None in pair:
            out.append(None)
            continue
        if pair not in seen:
            seen[pair] = ratio(*pair)
        out.append(seen[pair])
    return pd.Series(out, dtype="float64")


def tidy(value: Column) -> Column:
    return F.lower(F.btrim(F.coalesce(value.cast("string"), F.lit("")), F.lit(" \t\n\r\x0b\x0c")))


def contains_either(a: Column, b: Column) -> Column:
    """Equal, or one inside the other; both must be non-empty."""
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def fuzzy_match(a: Column, b: Column, score: Column, threshold: float = corpus.SET_RATIO) -> Column:
    """Containment, or a ratio of at least the threshold."""
    return contains_either(a, b) | ((a != "") & (b != "") & (score >= threshold))
