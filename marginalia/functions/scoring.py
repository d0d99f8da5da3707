"""Okapi BM25: inverse document frequency on the driver, term scores as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


# The half and the one of the formula, df bounded by the documents, 1 for an average length of 0.


def idf(n_docs: int, df: int) -> float:
    df = min(df, n_docs)
    return math.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def term_score(weight: Column, tf: Column, length: Column, average: Column, k1: Column, b: Column) -> Column:
    norm = F.when(average > 0, length / average).otherwise(F.lit(1.0))
    return weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * norm))
