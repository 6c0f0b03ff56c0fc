"""Scoring expressions of BM25F with typo distance, and edit distance with transpositions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

K1, TYPO_PENALTY, EXPANSIONS, NEAR_FIELD, UNANCHORED = 0.9, 0.6, 16, 0.9, 0.5
MISSING_WORD, MISSING_SIZE, MISSING_CONNECTIVE = 3, 16, 0


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + F.greatest(n - df + 0.5, F.lit(0.5)) / (df + 0.5))


def pseudo_tf(fields: list[tuple[Column, Column, Column, float, float]]) -> Column:
    """Sum over fields of boost * tf / (1 - b + b * length / average); fields are (tf, length, average, boost, b)."""
    out = F.lit(0.0)
    for tf, length, average, boost, b in fields:
        out = out + F.when(tf > 0, boost * tf / (1 - b + b * length / average)).otherwise(0.0)
    return out


def saturate(ptf: Column, k1: float = K1) -> Column:
    return ptf / (k1 + ptf)


def canon(x: Column) -> Column:
    """x on a grid of 2 ** -20 of its size, so that sums made in another order compare equal."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(x)) - 20)
    return F.when(x > 0, F.floor(x / step + 0.5) * step).otherwise(F.lit(0.0))


def osa(a: str, b: str) -> int:
    """Edits (insert, delete, replace, swap of neighbours) from a to b, none of them edited twice."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before = before, row
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
    return row[-1]


@F.pandas_udf(IntegerType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([osa(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(IntegerType())
def prefix_distance(term: pd.Series, typed: pd.Series, budget: pd.Series) -> pd.Series:
    """Least distance of what was typed to a prefix of the term, over prefixes within the budget of its length."""
    return pd.Series([min((osa(t[:n], q) for n in range(max(len(q) - b, 0), len(q) + b + 1) if n <= len(t)), default=99) for t, q, b in zip(term, typed, budget, strict=True)])
