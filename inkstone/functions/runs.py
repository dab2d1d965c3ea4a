"""Counting inside one row: sorted arrays cut into runs of equal values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def starts(ordered: Column, value: Callable[[Column], Column]) -> Column:
    """The places at which a run of equal values begins in a sorted array."""
    places = F.transform(ordered, lambda x, i: i)
    return F.filter(places, lambda i: (i == 0) | (value(F.get(ordered, i)) != value(F.get(ordered, i - 1))))


def counted(values: Column) -> Column:
    """(v, n, at) for each distinct value of an array of strings: how often it
    occurs and where first, by value. One sort; nothing is compared twice."""
    ordered = F.sort_array(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("at"))))

    def of(a: Column) -> Column:
        ends = lambda s, j: F.coalesce(F.get(s, j + 1), F.size(a))
        return let(starts(a, lambda x: x["v"]), lambda s: F.transform(s, lambda i, j: F.struct(F.get(a, i)["v"].alias("v"), (ends(s, j) - i).alias("n"), F.get(a, i)["at"].alias("at"))))

    return let(ordered, of)
