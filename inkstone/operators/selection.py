"""Choosing sentences: ordered scans with state, as folds over a ranked array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTS = "array<int>"


def ranked(scored: Column) -> Column:
    """Eligible sentences by falling score, then place."""
    keyed = F.transform(F.filter(scored, lambda x: x["eligible"]), lambda x: F.struct((-x["score"]).alias("by"), x["sent_idx"].alias("sent_idx"), F.length(x["sentence"]).alias("len")))
    return F.array_sort(keyed)


def by_chars(order: Column, budget: Column, exclude: Column | None = None, chosen: Column | None = None) -> Column:
    """Places taken greedily while they fit ``budget`` characters, with one
    between two; the scan goes on after a miss."""
    none = F.array().cast(INTS)
    taken = exclude if exclude is not None else none
    start = F.struct(F.lit(0).alias("used"), none.alias("chosen"))

    def step(state: Column, x: Column) -> Column:
        used = state["used"] + x["len"] + F.when(F.size(state["chosen"]) > 0, 1).otherwise(0)
        fits = (used <= budget) & ~F.array_contains(taken, x["sent_idx"])
        return F.struct(F.when(fits, used).otherwise(state["used"]).alias("used"), F.when(fits, F.concat(state["chosen"], F.array(x["sent_idx"]))).otherwise(state["chosen"]).alias("chosen"))

    return F.when(budget > 0, F.aggregate(order, start, step, lambda s: s["chosen"])).otherwise(none)


def by_count(order: Column, count: Column | int, exclude: Column | None = None) -> Column:
    """The first ``count`` places of a ranking."""
    count = F.lit(count) if isinstance(count, int) else count
    free = order if exclude is None else F.filter(order, lambda x: ~F.array_contains(exclude, x["sent_idx"]))
    return F.transform(F.slice(free, F.lit(1), F.greatest(count, F.lit(0))), lambda x: x["sent_idx"])


def texts(s: Column, chosen: Column) -> Column:
    """The sentences at the chosen places, in document order."""
    return F.transform(F.array_sort(chosen), lambda i: F.get(s, i)["sentence"])


def joined(s: Column, chosen: Column) -> Column:
    return F.array_join(texts(s, chosen), " ")
