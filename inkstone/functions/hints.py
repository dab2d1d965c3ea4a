"""Hints: terms towards which a selection leans."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Hints = Sequence[str] | Mapping[str, float] | None


def prepare(hints: Hints) -> list[tuple[str, float]]:
    """(lower-case hint, weight) pairs: white space folded, blank and non-text
    entries left out, a weight of 1 where none is given."""
    pairs = hints.items() if isinstance(hints, Mapping) else [(h, 1.0) for h in hints or ()]
    folded = [(" ".join(h.split()).lower(), float(w)) for h, w in pairs if isinstance(h, str)]
    return [(h, w) for h, w in folded if h]


def check(hints: list, focus: float, mode: str) -> None:
    if hints and not 0.0 <= focus <= 1.0:
        raise ValueError(f"hint_focus must be in [0.0, 1.0]; got {focus}")
    if hints and mode not in ("soft", "hard"):
        raise ValueError(f"hint_mode must be 'soft' or 'hard'; got {mode!r}")


def share(value: int, focus: float) -> int:
    """``value`` times ``focus``, to four decimals of focus, rounded half up."""
    return (value * int(focus * 10_000) + 5_000) // 10_000


def share_of(value: Column, focus: float) -> Column:
    return F.floor((value.cast("long") * int(focus * 10_000) + 5_000) / 10_000).cast("int")


def matches(hint: str, c: Column) -> Column:
    """Occurrences of a prepared hint as whole words."""
    return F.regexp_count(F.lower(c), F.lit(rf"(?U)\b{re.escape(hint)}\b"))


def bonus(c: Column, hints: list[tuple[str, float]]) -> Column:
    """Half a point for each occurrence and weight, three occurrences at most."""
    total = F.lit(0.0)
    for hint, weight in hints:
        total = total + F.least(matches(hint, c), F.lit(3)) * F.lit(weight) * 0.5
    return total
