"""Relevance scores as column arithmetic, in doubles throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def _double(c: Column | float) -> Column:
    return (c if isinstance(c, Column) else F.lit(float(c))).cast("double")


def tfidf(tf: Column, dl: Column, df: Column, n: Column) -> Column:
    """Share of the document's terms times the log of the inverse document share."""
    return _double(tf) / _double(dl) * F.log(_double(n) / _double(df))


def bm25(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """Okapi BM25 with the inverse document frequency kept above zero."""
    tf, dl, df, n = map(_double, (tf, dl, df, n))
    length = F.lit(1.0 - b) + F.lit(b) * dl / _double(avgdl)
    rarity = F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))
    return tf * F.lit(k1 + 1.0) / (tf + F.lit(k1) * length) * rarity
