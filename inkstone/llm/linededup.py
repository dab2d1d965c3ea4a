"""Operator 5: near-duplicate lines by a deletion-neighbourhood join.

Every line that is not blank is a duplicate if an earlier line (by document id,
then place) has the same words. The bound beyond that is one edit, where one edit
is a small part of a line: words are the symbols of lines of at least
``MIN_WORDS`` words, characters those of other lines of at least ``MIN_CHARS``. Equal lines meet in one aggregation. For the others, two lines
within the bound share the first or the last half of their words, so only lines
that share such a half with a different line go on; this screen loses nothing.
The rest emit their deletion variants as hashed keys: a substitution leaves
equal variants with the same place deleted, an insertion makes a variant of the
longer line equal to the shorter line. For each key the earliest line of either
role is kept by aggregation, never the pairs. Each line's earliest partner is
then verified by edit distance over the symbols themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, written

#: Words from which on a line is compared, so that one word is at most a fifth.
MIN_WORDS = 5
#: Characters from which on a line of fewer words is compared by characters:
#: long addresses, encoded data and scripts without spaces, not names or dates.
MIN_CHARS = 40
#: Variant keys of a batch.
BATCH_KEYS = 200_000
#: Roles of a variant key: same place deleted, variant of a longer line, whole line.
SAME, LONGER, WHOLE = 0, 1, 2
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def line_words(line: str) -> list[str]:
    return line.lower().split()


def line_symbols(words: list[str]) -> list[str]:
    """What a line is compared by within one edit: its words, its characters
    (marked by a space, which no word holds) or nothing."""
    if len(words) >= MIN_WORDS:
        return words
    text = " ".join(words)
    return [f" {c}" for c in text] if len(text) >= MIN_CHARS else []


def _half_sizes(n: int) -> set[int]:
    """Words of the shared half, for partners as long or one word longer;
    rounded down so that neighbouring lengths agree."""
    halves = {(n - 1) // 2, n // 2}
    return {h if h < 4 else h // 4 * 4 for h in halves}


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _screen_keys(words: list[str]) -> list[int]:
    from xxhash import xxh64_intdigest as digest

    keys = []
    for h in _half_sizes(len(words)):
        keys.append(_signed(digest("\0".join(words[:h]).encode("utf-8", "surrogatepass"), 2 * h)))
        keys.append(_signed(digest("\0".join(words[len(words) - h :]).encode("utf-8", "surrogatepass"), 2 * h + 1)))
    return keys


def _lines(least: int):
    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest as digest

        for frame in frames:
            rows = []
            for doc, th, text in zip(frame["doc"], frame["th"], frame["t"]):
                for number, line in enumerate(text.split("\n")):
                    words = line_words(line)
                    if len(words) >= least:
                        symbols = line_symbols(words)
                        rows.append((doc, th, number, _signed(digest("\0".join(words).encode("utf-8", "surrogatepass"), 9)), _screen_keys(symbols) if symbols else []))
            yield pd.DataFrame(rows, columns=["doc", "th", "line", "f", "keys"])

    return of


def variant_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys of the line without each of its words: with the place, without it,
    and of the whole line. Sums of word hashes times powers of an odd number,
    so that all variants take one pass."""
    from xxhash import xxh64_intdigest as digest

    n = len(words)
    with np.errstate(over="ignore"):
        hashes = np.fromiter((digest(w.encode("utf-8", "surrogatepass"), 5) for w in words), np.uint64, n)
        powers = np.cumprod(np.full(n, _STEP, np.uint64))
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers)])
        left_out = upto[:-1] + (upto[-1] - upto[1:]) * np.uint64(_BACK)
        longer = left_out * np.uint64(0xC2B2AE3D27D4EB4F) ^ np.uint64(n - 1)
        same = (left_out + np.arange(n, dtype=np.uint64) * np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93) ^ np.uint64(n + (1 << 40))
        whole = upto[-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ np.uint64(n)
    return same.view(np.int64), longer.view(np.int64), int(whole.view(np.int64))


def _variants(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        keys, roles, rows, n = [], [], [], 0
        for i, line in enumerate(frame["t"]):
            same, longer, whole = variant_keys(line_symbols(line_words(line)))
            keys += [same, longer, np.array([whole])]
            roles.append(np.repeat(np.array([SAME, LONGER, WHOLE], np.int8), [len(same), len(longer), 1]))
            rows.append(np.full(2 * len(same) + 1, i))
            n += len(rows[-1])
            if n >= BATCH_KEYS or i == len(frame) - 1:
                of = frame.iloc[np.concatenate(rows)]
                yield pd.DataFrame({"key": np.concatenate(keys), "role": np.concatenate(roles), "doc": of["doc"].to_numpy(), "line": of["line"].to_numpy(), "f": of["f"].to_numpy()})
                keys, roles, rows, n = [], [], [], 0


def edit_distance(a: list[str], b: list[str], most: int = 1) -> int:
    """Edit distance over words; ``most + 1`` stands for anything beyond ``most``."""
    lo, hi_a, hi_b = 0, len(a), len(b)
    while lo < min(hi_a, hi_b) and a[lo] == b[lo]:
        lo += 1
    while min(hi_a, hi_b) > lo and a[hi_a - 1] == b[hi_b - 1]:
        hi_a, hi_b = hi_a - 1, hi_b - 1
    a, b = a[lo:hi_a], b[lo:hi_b]
    if abs(len(a) - len(b)) > most or min(len(a), len(b)) > most * (most + 2):
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return min(row[-1], most + 1)


def _verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        near = [edit_distance(line_symbols(line_words(a)), line_symbols(line_words(b))) <= 1 for a, b in zip(frame["t"], frame["t2"])]
        yield frame.loc[near, ["f"]]


def _place() -> list[Column]:
    """What lines are ordered by; the hash of the text decides only between rows that share an id."""
    return [F.col("doc"), F.col("line"), F.col("th")]


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short_lines: bool = True) -> DataFrame:
    """(doc, th, lines): the numbers, from 0, of all duplicate lines of each
    row that has any. ``doc`` is the id (the largest long for null), ``th`` a
    hash of the text; together they name a row, so repeated rows share a result.
    """
    named = _named(docs, id_col, text_col)
    lines = written(named.where("t is not null").mapInPandas(_lines(1 if short_lines else MIN_WORDS), "doc long, th long, line int, f long, keys array<long>"))
    once = written(lines.groupBy("f").agg(F.min(F.struct(*_place())).alias("first"), F.any_value("keys").alias("keys")).select("f", "first.*", "keys"))
    keyed = once.select("f", F.explode("keys").alias("k"))
    shared = keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    going = keyed.join(shared, "k", "left_semi").select("f").distinct()
    going = once.join(going, "f", "left_semi").select("f", *_place())
    exploded = named.select("doc", "th", F.posexplode(F.split("t", "\n")).alias("line", "t"))
    texts = written(exploded.join(going, ["doc", "th", "line"]).dropDuplicates(["f"]).select("f", *_place(), "t"))
    variants = texts.mapInPandas(_variants, "key long, role byte, doc long, line int, f long")
    at = F.struct("doc", "line", "f")
    earliest = variants.groupBy("key").agg(
        *(F.min(F.when(F.col("role") == r, at)).alias(name) for r, name in ((SAME, "same"), (LONGER, "longer"), (WHOLE, "whole"))), F.count("*").alias("n")
    )
    earliest = earliest.where("n > 1 and (same is not null or (longer is not null and whole is not null))").drop("n")
    partner = F.when(F.col("role") == SAME, F.col("same")).when(F.col("role") == LONGER, F.col("whole")).otherwise(F.col("longer"))
    pairs = variants.join(earliest, "key").select("f", at.alias("at"), partner.alias("partner")).where("partner < at and partner.f <> f")
    pairs = pairs.groupBy("f").agg(F.min("partner").alias("p")).select("f", F.col("p.f").alias("f2"))
    whole = texts.select("f", "t")
    both = pairs.join(whole, "f").join(whole.select(F.col("f").alias("f2"), F.col("t").alias("t2")), "f2")
    near = both.select("f", "t", "t2").mapInPandas(_verified, "f long")
    here = lines.select("doc", "th", "line", "f")
    # two joins of plain exchanges: adaptive execution can split a hot line's partition
    first = once.select(F.col("f").alias("g"), F.struct(*_place()).alias("first"))
    later = here.join(first, F.col("f") == F.col("g")).where(F.struct(*_place()) > F.col("first")).select(*_place())
    gone = later.union(here.join(near.distinct(), "f", "left_semi").select(*_place()))
    out = written(gone.groupBy("doc", "th").agg(F.collect_set("line").alias("lines")))
    for done in (once, texts, lines):
        forget(done)
    return out


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("t"))


def _without(texts: pd.Series, numbers: pd.Series) -> pd.DataFrame:
    rows = []
    for text, gone in zip(texts, numbers):
        if text is None:
            rows.append((None, 0, 0, False))
            continue
        gone = set() if gone is None else set(np.asarray(gone).tolist())
        lines = text.split("\n")
        kept = [line for i, line in enumerate(lines) if i not in gone]
        rows.append(("\n".join(kept), len(lines), len(gone), not gone or any(len(line_words(x)) >= MIN_WORDS for x in kept)))
    return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped", "long_kept"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short_lines: bool = True) -> DataFrame:
    """All columns of ``docs`` and ``line_dedup``: a struct of the text without
    its duplicate lines, n_lines, n_dropped and long_kept (nothing was dropped
    or a line of ``MIN_WORDS`` words is left).

    Lines end at ``\\n``; words are split at white space and compared in lower
    case. Blank lines are never dropped; without ``short_lines`` neither are
    lines of fewer than ``MIN_WORDS`` words. The earliest line of any two within the bound stays, whether or not it is itself near an earlier one's
    copy; rows that repeat an id and a text count as one row. A null text has
    no lines and stays null; a null id comes after all others.
    """
    gone = duplicate_lines(docs, id_col, text_col, short_lines).select(F.col("doc").alias("_gone_doc"), F.col("th").alias("_gone_th"), F.col("lines").alias("_gone_lines"))
    here = F.coalesce(docs[id_col].cast("long"), F.lit((1 << 63) - 1)) == F.col("_gone_doc")
    joined = docs.join(gone, here & (F.xxhash64(docs[text_col]) == F.col("_gone_th")), "left")
    without = F.pandas_udf(_without, "text string, n_lines long, n_dropped long, long_kept boolean")
    return joined.select(*(docs[c] for c in docs.columns), without(docs[text_col], F.col("_gone_lines")).alias("line_dedup"))
