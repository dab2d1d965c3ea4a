"""Repeated word groups of a text, counted where the text is.

A group of k words occurs no more often than the two of k - 1 words inside it, so
longer groups are made only where both were met often enough.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

COUNTED = "array<struct<v:string,n:int,at:int>>"
#: Most words of a group.
LONGEST = 5
_WORDS = re.compile(rb"[a-z]{3,}")
_STOP = frozenset(w.encode() for w in P.PHRASE_STOPWORDS)


def repeated(text: bytes, least: int = 2) -> list[tuple[bytes, int, int]]:
    """(group, how often, place of the first among all groups) of the groups of two to
    five words in runs without stopwords that a lower-case text has ``least`` times.
    All groups are in order by run, then words, then place in the run."""
    runs, run = [], []
    for word in _WORDS.findall(text):
        if word not in _STOP:
            run.append(word)
        elif run:
            runs.append(run)
            run = []
    runs.append(run)
    often = Counter(chain.from_iterable(zip(run, run[1:]) for run in runs))
    many = {pair for pair, n in often.items() if n >= least}
    if not many:
        return []
    todo, first = [], 0  # (run, place of its first group of k words, where groups met often begin)
    for run in runs:
        pairs = list(zip(run, run[1:]))
        if not many.isdisjoint(pairs):
            todo.append((run, first, [i for i, pair in enumerate(pairs) if pair in many]))
        n, most = len(run), min(len(run), LONGEST)
        first += max(0, (most - 1) * (n + 1) - most * (most + 1) // 2 + 1)
    found = []
    for k in range(2, LONGEST + 1):
        if k > 2:
            todo = [(run, first + len(run) - k + 2, [i for i, j in zip(starts, starts[1:]) if j == i + 1]) for run, first, starts in todo]
            often = Counter(tuple(run[i : i + k]) for run, _, starts in todo for i in starts)
            todo = [(run, first, good) for run, first, starts in todo if (good := [i for i in starts if often[tuple(run[i : i + k])] >= least])]
        seen = set()
        for run, first, starts in todo:
            for i in starts:
                group = tuple(run[i : i + k])
                if group not in seen:
                    seen.add(group)
                    found.append((b" ".join(group), often[group], first + i))
    return found


def _repeated_in(least: int):
    def of(texts: pa.Array) -> pa.Array:
        sizes, rows = [0], []
        for text in texts:
            rows += repeated(text.as_py() or b"", least)
            sizes.append(len(rows))
        v, n, at = zip(*rows) if rows else ((), (), ())
        parts = [pa.array(v, pa.binary()).cast(pa.string()), pa.array(n, pa.int32()), pa.array(at, pa.int32())]
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(parts, ["v", "n", "at"]))

    return F.arrow_udf(of, COUNTED)


def counted(text: Column, least: int = 2) -> Column:
    """(v, n, at) of the word groups that a text has ``least`` times, as ``repeated`` finds them."""
    return _repeated_in(least)(F.lower(text).cast("binary"))
