"""Ratcliff-Obershelp similarity of strings, which no built-in function gives, in Arrow batches."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: str, b: str) -> Column:
    """Share of both strings that lies in common blocks, for two column names."""

    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)])

    return F.pandas_udf(of, "double")(a, b)
