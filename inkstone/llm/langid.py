"""Operator 7: language identification as mixture inference.

For each language a table of character n-gram log-likelihoods is learned. A
document is a mixture of languages and of a flat background: expectation-
maximisation estimates the proportions from its n-grams, and languages leave
the set one by one while the likelihood, less half a logarithm of the number
of n-grams for each member, does not fall. The background may leave, too, but
one language always stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Documents of each language from which the tables are learned, at most:
#: those whose hashed ids are the smallest, so the choice follows no order.
#: Their whole texts count.
SAMPLE = 400
#: Slots of the hashed n-gram tables, added counts.
SLOTS, SMOOTH = 1 << 16, 0.1
#: An estimation ends when a step gains less log-likelihood than about this.
GAIN = 0.01
UNDETERMINED = "und"


def grams(text: str) -> np.ndarray:
    """Slots of the text's character bigrams and trigrams: letters in lower
    case, every run of other characters one space, a space at both ends."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, back = np.unique(points, return_inverse=True)
    letter = np.fromiter((chr(k).isalpha() for k in kinds.tolist()), bool, len(kinds))[back]
    points = np.where(letter, points, 32).astype(np.uint64)
    points = points[letter | np.r_[True, letter[:-1]]]
    if len(points) < 3:
        return np.zeros(0, np.int64)
    two = points[:-1] * np.uint64(0x9E3779B97F4A7C15) + points[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two[:-1] * np.uint64(0x165667B19E3779F9) + points[2:] * np.uint64(0xD6E8FEB86659FD93)
    return (np.concatenate([two, three]) >> np.uint64(40)).astype(np.int64) % SLOTS


def likelihoods(counts: np.ndarray) -> np.ndarray:
    """(languages, SLOTS) of n-gram probabilities from smoothed counts."""
    smooth = counts + SMOOTH
    return np.asfortranarray(smooth / smooth.sum(axis=1, keepdims=True))


def _estimate(given: np.ndarray, weight: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares at which the likelihood stands, and its logarithm. A step gains
    about the n-grams times the divergence of its shares from those before."""
    share, total, mixed = start, weight.sum(), given @ start
    if len(share) == 1:
        return share, float(weight @ np.log(mixed))
    while True:
        moved = share * ((weight / mixed) @ given) / total
        some = moved > 0
        gain = total * float(moved[some] @ np.log(moved[some] / share[some]))
        share, mixed = moved, given @ moved
        if gain < GAIN:
            return share, float(weight @ np.log(mixed))


def mixture(text: str | None, probabilities: np.ndarray) -> tuple[np.ndarray, int]:
    """Proportions of the languages and, last, of the background, and the number
    of the language that explains the text best among those that stayed. All
    zero and -1 when the text is null or has no letter."""
    languages = len(probabilities)
    out = np.zeros(languages + 1)
    if not text or not any(map(str.isalpha, text)):
        return out, -1
    slot, times = np.unique(grams(text), return_counts=True)
    given = np.full((len(slot), languages + 1), 1 / SLOTS)
    given[:, :-1] = probabilities.T[slot]  # rows of a table that lies language by language in memory
    chosen = list(range(languages + 1))
    share, fit = _estimate(given, times, np.full(len(chosen), 1 / len(chosen)))
    price = 0.5 * np.log(times.sum())
    while len(chosen) > 1:
        free = [i for i, c in enumerate(chosen) if c == languages or sum(x < languages for x in chosen) > 1]
        least = min(free, key=lambda i: share[i])
        rest = chosen[:least] + chosen[least + 1 :]
        start = share[[i for i in range(len(chosen)) if i != least]] + 1e-9
        fewer, fit_fewer = _estimate(given[:, rest], times, start / start.sum())
        if fit_fewer + price < fit:
            break
        chosen, share, fit = rest, fewer, fit_fewer
    out[chosen] = share
    most = out[:-1].max()
    best = [c for c in chosen if c < languages and out[c] == most]
    if len(best) > 1:  # equal shares, or none at all beside the background
        best.sort(key=lambda c: -float(times @ np.log(given[:, c])))
    return out, best[0]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and their n-gram probabilities, from at most
    ``sample`` documents of each language with a label and a letter. The choice
    and the counts are made by Spark; the driver gets one table of counts per language."""
    key = F.xxhash64(F.col(id_col).cast("string"), F.lit(7))
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t"), key.alias("k"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    if not sizes:
        return [], np.zeros((0, SLOTS))
    # hashes are even over the longs: this leaves a few times the sample, whatever the input's size
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, (3 * sample + 100) / n))))
    few = rows.where(F.col("k").cast("double") < (share[F.col("lang")] * 2 - 1) * 2.0**63)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("k", "t"))).where(F.col("rank") <= sample)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, text in zip(frame["lang"], frame["t"]):
                slot, times = np.unique(grams(text), return_counts=True)
                yield pd.DataFrame({"lang": lang, "slot": slot, "n": times})

    counted = ranked.select("lang", "t").mapInPandas(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    # at most SLOTS numbers for each language
    found = counted.groupBy("lang").agg(F.collect_list(F.struct("slot", "n")).alias("n")).orderBy("lang").collect()
    counts = np.zeros((len(found), SLOTS))
    for row, of in zip(counts, found):
        for x in of["n"]:
            row[x["slot"]] = x["n"]
    return [r["lang"] for r in found], likelihoods(counts)


def with_language(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", name: str = "language") -> DataFrame:
    """All columns of ``docs`` and a struct ``name``: lang_pred, score (its
    proportion), langs (all chosen languages, the largest proportion first)
    and background. Row by row, in place; whole texts are read.

    ``und`` with score 0 for null texts, texts without a letter, and where no
    language was learned; any other text has a learned language, however small
    its proportion beside the background. Equal proportions are decided by the
    likelihood, then by the order of names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, table = sent.value
        for part in texts:
            rows = []
            for text in part:
                share, best = mixture(text, table) if names else (np.zeros(1), -1)
                if best < 0:
                    rows.append((UNDETERMINED, 0.0, "", 0.0))
                    continue
                order = [best, *(i for i in np.argsort(-share[:-1], kind="stable") if share[i] > 0 and i != best)]
                rows.append((names[best], min(1.0, float(share[best])), ",".join(names[i] for i in order), float(share[-1])))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "langs", "background"])

    return docs.select(*(docs[c] for c in docs.columns), F.pandas_udf(of, "lang_pred string, score double, langs string, background double")(docs[text_col]).alias(name))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the fields of ``with_language``, one row per row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return with_language(rows, model).select("doc_id", "language.*")


def held_out(id_col: str = "doc_id") -> Column:
    """The quarter of the documents from which nothing is learned."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
