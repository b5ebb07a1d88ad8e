"""Likeness of short texts."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def edit_ratio(a: Column, b: Column) -> Column:
    """1 − edit distance / longer length; 1 for two empty texts."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.coalesce(1 - F.try_divide(F.levenshtein(a, b).cast("double"), longer), F.lit(1.0))


def block_ratio(a: Column, b: Column) -> Column:
    """Matching-block ratio (2 · matching characters / total length), for already found pairs."""
    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(left, right)])

    return ratio(a, b)
