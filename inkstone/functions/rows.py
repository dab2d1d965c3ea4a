"""Rows out of arrays that are costly to make.

Of an array that is a column the optimiser asks first whether it has elements, in a
filter that it moves below whatever made the column, and below any exchange on the way:
the array would be made twice, and once before its rows are dealt out. The outer forms
keep a row for an empty array, which is left out behind them, so nothing is asked before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numbered(df: DataFrame, keep: list, array: Column | str, place: str, value: str) -> DataFrame:
    """(keep, place, value): a row for each element, with its place from 0."""
    return df.select(*keep, F.posexplode_outer(array).alias(place, value)).where(F.col(place).isNotNull())


def fields(df: DataFrame, keep: list, array: Column | str, never_null: str) -> DataFrame:
    """(keep, fields): a row for each struct of an array; one of its fields is never null."""
    return df.select(*keep, F.inline_outer(array)).where(F.col(never_null).isNotNull())


def made(df: DataFrame, keep: list, value: Column, name: str) -> DataFrame:
    """(keep, name): a costly column that is worked out where it is asked for here. A filter on it
    stays above, and is neither moved below an exchange nor worked out a second time for it."""
    return df.select(*keep, F.explode_outer(F.array(value)).alias(name))
