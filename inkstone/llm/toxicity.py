"""Operator 11: toxicity by a weighted lexicon.

Texts are folded (case, look-alike letters of other scripts, digits and signs
that stand for letters), a lexicon of word beginnings is matched by an
Aho-Corasick automaton, hits inside exception phrases do not count, and what is
left, weighted and normalised by the text's length, gives the score. Lexicon,
weights, exceptions and the curve of the score are learned from labelled rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, written

#: Labelled documents from which is learned, about so many of each label: those
#: whose hashed ids are the smallest. Their whole texts count.
TOXIC_SAMPLE, CLEAN_SAMPLE = 2_000, 10_000
#: Letters of the shortest and the longest word beginning in the lexicon.
SHORTEST, LONGEST = 3, 12
#: Times that one document's use of a beginning counts while the lexicon is learned.
MOST = 4
#: Chance, over all candidates together, that one which says nothing is taken.
CHANCE = 0.01
#: Logarithm of how many times as often, at least, toxic documents use a term of the lexicon.
LEAST_WEIGHT = 2.0
#: Documents that must have a phrase before it can be an exception.
EXCEPTION_DOCS = 5
#: Odd multipliers, one for each mark by which near copies are found.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
PREDICTED = 0.7

#: Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ո": "n", "ս": "u",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l", "ɪ": "i", "ø": "o",
}
#: Digits and signs that stand for letters inside a word. What can
#: be i or l becomes i, and so does every l.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}

class _Bare(dict):
    """Letters without their marks, one character for one."""

    def __missing__(self, point: int) -> str:
        self[point] = unicodedata.normalize("NFD", chr(point))[0]
        return self[point]


_SIGHT, _SIGNS, _BARE = str.maketrans(LOOK_ALIKES), str.maketrans(STAND_INS), _Bare()
_SIGHTED = re.compile(f"[{''.join(LOOK_ALIKES)}]")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_DOTTED = re.compile(r"[.*_-]\w[.*_-]")
_SPACED = re.compile(r"(?<![\w.*_-])(?:\w[.*_-]){2,}\w(?![\w.*_-])")
_BREAK = re.compile(r"[^\w@$!|]+")


def _respelled(token: str) -> str:
    """A token with digits or signs: letters for them where it has letters, too."""
    if any(map(str.isalpha, token)):
        return token.strip("!|_").translate(_SIGNS).replace("_", " ")
    return token.strip("@$!|_")


def fold(text: str | None) -> tuple[str, int]:
    """The folded text, every word between single spaces, and the number of
    words. Null is empty."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii():
        text = _HIDDEN.sub("", text)
        if _SIGHTED.search(text):
            text = text.translate(_SIGHT)
        text = unicodedata.normalize("NFC", text)
    if _DOTTED.search(text):
        text = _SPACED.sub(lambda m: re.sub(r"[.*_-]", "", m.group()), text)
    words = " ".join([t if t.isalpha() else _respelled(t) for t in _BREAK.split(text)]).split()
    return f" {' '.join(words)} ".replace("l", "i"), len(words)


def bare(folded: str) -> str:
    """The folded text without its letters' marks, one character for one."""
    return folded if folded.isascii() else folded.translate(_BARE)


def beginnings(folded: str) -> dict[str, int]:
    """How many of the text's words have each beginning; a space stands behind
    those that are whole words."""
    out: dict[str, int] = {}
    for word, n in Counter(folded.split()).items():
        if len(word) >= SHORTEST:
            for end in range(SHORTEST, min(LONGEST, len(word)) + 1):
                out[word[:end]] = out.get(word[:end], 0) + n
            if len(word) <= LONGEST:
                out[f"{word} "] = n
    return out


@dataclass
class Lexicon:
    """Folded word beginnings with weights, exception phrases, and the score's
    curve; ``of`` folds plain words and phrases."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: list[float] = field(default_factory=lambda: [-3.0, 0.0, 1.0])
    known: bool = True

    @classmethod
    def of(cls, terms: dict[str, float], exceptions: list[str] = (), **more: object) -> Lexicon:
        """Terms are whole words, or beginnings when they end with ``*``."""
        folded = {fold(t.rstrip("*"))[0].lstrip().rstrip(" " if t.endswith("*") else ""): w for t, w in terms.items()}
        return cls(folded, [fold(e)[0] for e in exceptions], **more)

    def automaton(self) -> ahocorasick.Automaton:
        """Terms carry their weights, exceptions none."""
        found = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            found.add_word(f" {term}", (len(term), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase) - 1, None))
        if len(found):
            found.make_automaton()
        return found


def hits(automaton: ahocorasick.Automaton, folded: str) -> list[tuple[int, int, float]]:
    """Start, end and weight of every word of the lexicon, with or without its
    letters' marks, that lies in no exception phrase; a word counts once, by its
    heaviest term."""
    if not len(automaton):
        return []
    found, spared, texts = {}, [], [folded]
    if not folded.isascii():
        # words with marks are few; the whole text is looked at again only where one of them is in the lexicon
        marked = f" {' '.join([w for w in folded.split(' ') if not w.isascii()])} ".translate(_BARE)
        if next(automaton.iter(marked), None):
            texts.append(bare(folded))
    for text in texts:
        for last, (length, weight) in automaton.iter(text):
            if weight is None:
                spared.append((last - length, last + 1))
            else:
                start = last + 1 - length
                if start not in found or found[start][1] < weight:
                    found[start] = (last + 1, weight)
    rows = sorted((s, e, w) for s, (e, w) in found.items())
    if not spared:
        return rows
    spared.sort()
    kept, at, reach = [], 0, -1
    for s, e, w in rows:  # both in order: the furthest end of the phrases begun so far
        while at < len(spared) and spared[at][0] <= s:
            reach, at = max(reach, spared[at][1]), at + 1
        if s >= reach:
            kept.append((s, e, w))
    return kept


def held_out(id_col: str = "doc_id") -> Column:
    """The third of the documents from which nothing is learned."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def marks(text: str) -> list[int]:
    """Least hashes of the text's three-word runs under a few multipliers: near
    copies have some in common."""
    words = fold(text)[0].split()
    runs = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, runs), np.uint64, len(runs))
    return [int((hashed * np.uint64(m)).min() >> np.uint64(1)) for m in MULTIPLIERS]


def one_of_copies(rows: DataFrame) -> DataFrame:
    """Of ``rows`` (doc_id, toxic, t) those with no near copy of a smaller id:
    words that copies share would otherwise count once for each copy."""

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [marks(t) for t in frame["t"]]
            yield pd.DataFrame({"doc_id": np.repeat(frame["doc_id"], len(MULTIPLIERS)), "k": list(range(len(MULTIPLIERS))) * len(frame), "mark": [m for f in found for m in f]})

    marked = written(rows.mapInPandas(mark, "doc_id long, k int, mark long"))
    first = marked.groupBy("k", "mark").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = marked.join(first, ["k", "mark"]).where("doc_id <> first").select("doc_id").distinct()
    out = written(rows.join(copies, "doc_id", "left_anti").select("toxic", "t"))
    forget(marked)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, toxic_sample: int, clean_sample: int) -> DataFrame:
    """(toxic, t) of about so many documents of each label, one of near copies. A
    document with both labels, or none, is left out; of several texts of one id
    the smallest counts."""
    one = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).where("toxic = _most and doc_id is not null")
    sizes = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}  # one row for each label
    most = {1: toxic_sample, 0: clean_sample}
    share = F.when(F.col("toxic") == 1, min(1.0, most[1] / sizes.get(1, 1))).otherwise(min(1.0, most[0] / sizes.get(0, 1)))
    # hashes are even over the longs, so the chosen ids are about as many as asked for, whatever the input's size
    few = one.where(F.xxhash64(F.col("doc_id").cast("string"), F.lit(11)).cast("double") < (share * 2 - 1) * 2.0**63).select("doc_id", "toxic")
    found = docs.join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("t"))
    rows = written(found)
    out = one_of_copies(rows)
    forget(rows)
    return out


COUNTS = ("a", "b", "toxic", "clean", "all_toxic", "all_clean")


def _counted(rows: DataFrame, keys_of: Callable[[str], dict[str, int]]) -> DataFrame:
    """(key, a, b, toxic, clean, all_toxic, all_clean): toxic and clean documents
    that have each key, how many times they have it, each ``MOST`` times at most,
    and how many times in all."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, list[int]] = {}  # bounded by the sample
        for frame in frames:
            for toxic, text in zip(frame["toxic"], frame["t"]):
                for key, n in keys_of(text).items():
                    found = seen.setdefault(key, [0] * 6)
                    found[1 - toxic] += 1
                    found[3 - toxic] += min(n, MOST)
                    found[5 - toxic] += n
        every = list(seen)
        for i in range(0, len(every), 10_000):
            some = every[i : i + 10_000]
            yield pd.DataFrame([[key, *seen[key]] for key in some], columns=["key", *COUNTS]).astype({"key": object})

    counted = rows.mapInPandas(count, "key string, " + ", ".join(f"{c} long" for c in COUNTS))
    return counted.groupBy("key").agg(*(F.sum(c).alias(c) for c in COUNTS))


def surprise(a: float, b: float, share: float) -> float:
    """Least negative logarithm of the chance that of a+b things as many as a are
    toxic, where a share of all such things is (Chernoff)."""
    n = a + b
    rate = a / n if n else 0.0
    if rate <= share:
        return 0.0
    return n * (rate * np.log(rate / share) + ((1 - rate) * np.log((1 - rate) / (1 - share)) if rate < 1 else 0.0))


def _surprise(a: Column, b: Column, share: float) -> Column:
    """``surprise`` of two columns."""
    rate = a / (a + b)
    told = rate * F.log(rate / share) + F.when(rate < 1, (1 - rate) * F.log((1 - rate) / (1 - share))).otherwise(0.0)
    return F.when(rate > share, (a + b) * told).otherwise(0.0)


def choose(counts: dict[str, tuple[int, ...]], told: Callable[[float, float], bool]) -> list[str]:
    """The beginnings to keep. Of those that count the same, the longest (but not
    the whole word); a longer one goes where a shorter is as clean; a shorter one
    goes where it tells nothing beyond the longer ones."""
    dirt = lambda c: (c[3] + 0.5) / (c[2] + c[3] + 1)
    kept: set[str] = set()
    for term in sorted(counts, key=len):
        above = [q for q in (term[:n] for n in range(SHORTEST, len(term))) if q in kept]
        same = [q for q in above if counts[q] == counts[term]]
        if same and not term.endswith(" "):
            kept.difference_update(same)
            kept.add(term)
        elif not any(dirt(counts[q]) <= dirt(counts[term]) for q in above):
            kept.add(term)
    for term in sorted(kept, key=len, reverse=True):
        below = [t for t in kept if t != term and t.startswith(term)]
        below = [t for t in below if not any(t != q and t.startswith(q) for q in below)]
        # the part of its uses that no longer one has
        rest = [counts[term][i] * max(0, 1 - sum(counts[t][i + 2] for t in below) / max(1, counts[term][i + 2])) for i in (2, 3)]
        if below and not told(*rest):
            kept.discard(term)
    return sorted(kept)


def curve(x: np.ndarray, toxic: np.ndarray) -> list[float]:
    """Intercept and slopes of a logistic curve, both labels of equal weight in
    all, with a small penalty that keeps it finite where it can part them."""
    weight = np.where(toxic == 1, 0.5 / max(1, (toxic == 1).sum()), 0.5 / max(1, (toxic == 0).sum())) * len(x)
    design = np.column_stack([np.ones(len(x)), x])
    penalty, found = np.diag([1e-3, *[1e-2] * x.shape[1]]), np.zeros(design.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ found, -30, 30)))
        slope = design.T @ (weight * (p - toxic)) + penalty @ found
        bend = design.T @ (design * (weight * p * (1 - p))[:, None]) + penalty
        step = np.linalg.solve(bend, slope)
        found = found - step * min(1.0, 4 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return found.tolist()


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_sample: int = TOXIC_SAMPLE, clean_sample: int = CLEAN_SAMPLE) -> Lexicon:
    """A lexicon from the labelled documents among ``docs``. Texts stay on the
    executors; the driver gets the terms that say something, and one number for
    each document of the sample. Without documents of both labels nothing is known."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    labels = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("toxic"))
    rows = labelled_sample(docs, labels, toxic_sample, clean_sample)
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        forget(rows)
        return Lexicon(known=False)
    counted = written(_counted(rows, lambda text: (folded := fold(text)[0]) and beginnings(folded) | {"": folded.count(" ") - 1}).where("a >= 2 or key = ''"))
    words = counted.where("key = ''").first()
    docs_share, words_share = n1 / (n1 + n0), max(1, words["all_toxic"]) / max(2, words["all_toxic"] + words["all_clean"])
    least = float(np.log(max(1, counted.count()) / CHANCE))
    # what one document repeats tells less than what several say: at worst it repeats MOST times
    told = F.greatest(_surprise(F.col("a"), F.col("b"), docs_share), _surprise(F.col("toxic"), F.col("clean"), words_share) / MOST)
    counts = {r["key"]: tuple(r)[1:] for r in counted.where("key <> ''").where(told >= least).collect()}  # bounded by the sample
    forget(counted)
    weigh = lambda toxic, clean: float(np.log((toxic + 0.5) / (words["all_toxic"] + 1)) - np.log((clean + 0.5) / (words["all_clean"] + 1)))
    kept = choose(counts, lambda toxic, clean: surprise(toxic, clean, words_share) >= -np.log(CHANCE))
    found = Lexicon({t: w for t in kept if (w := weigh(*counts[t][2:4])) >= LEAST_WEIGHT})
    sent = rows.sparkSession.sparkContext.broadcast(found)

    automaton = None

    def phrases(text: str) -> dict[str, int]:
        nonlocal automaton
        automaton = automaton or sent.value.automaton()
        folded, _ = fold(text)
        out: Counter[str] = Counter()
        for s, _, _ in hits(automaton, folded):
            end = folded.index(" ", s)
            before, behind = folded.rfind(" ", 0, s - 1) if s > 1 else 0, folded.find(" ", end + 1)
            if s > 1:
                out[folded[before : end + 1]] += 1
            if behind > 0:
                out[folded[s - 1 : behind + 1]] += 1
        return out

    around = _counted(rows, phrases).where(f"b >= {EXCEPTION_DOCS} and a = 0").collect()  # bounded by the sample
    found.exceptions = sorted(r["key"] for r in around)
    sent = rows.sparkSession.sparkContext.broadcast(found)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = sent.value.automaton()
        for frame in frames:
            rows = [measured(automaton, t) for t in frame["t"]]
            yield pd.DataFrame({"toxic": frame["toxic"], "mass": [r[0] for r in rows], "density": [r[1] for r in rows]})

    seen = rows.mapInPandas(measure, "toxic int, mass double, density double").toPandas()  # two numbers for each document of the sample
    found.curve = curve(seen[["mass", "density"]].to_numpy(), seen["toxic"].to_numpy())
    forget(rows)
    return found


def measured(automaton: ahocorasick.Automaton, text: str | None) -> tuple[float, float, int, int]:
    """The weights of the text's hits and their weights for a thousand words,
    both on a logarithmic scale, the hits and the words."""
    folded, words = fold(text)
    found = hits(automaton, folded)
    mass = sum(w for _, _, w in found)
    return float(np.log1p(mass)), float(np.log1p(1000 * mass / max(1, words))), len(found), words


def with_toxicity(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` and a struct ``name``: score, n_hits, n_words. Row
    by row, in place; whole texts are read.

    Null and empty texts have no word and get the score of a text without a hit;
    where nothing was learned every score is 0. Scores follow from the text
    alone, so repeated rows get equal ones.
    """
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found = sent.value
        automaton = found.automaton()
        for part in texts:
            rows = [measured(automaton, text) for text in part]
            x = np.array([(1.0, *r[:2]) for r in rows]).reshape(-1, 3) @ np.array(found.curve)
            score = 1 / (1 + np.exp(-np.clip(x, -30, 30))) if found.known else np.zeros(len(rows))
            yield pd.DataFrame({"score": score, "n_hits": [r[2] for r in rows], "n_words": [r[3] for r in rows]})

    return docs.select(*(docs[c] for c in docs.columns), F.pandas_udf(of, "score double, n_hits long, n_words long")(docs[text_col]).alias(name))


def toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``PREDICTED`` on), n_hits and
    n_words; one row for each row of ``docs``. A null id is not held out."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = with_toxicity(rows, lexicon).withColumn("held_out", held_out())
    return found.select("doc_id", "held_out", "toxicity.score", (F.col("toxicity.score") >= PREDICTED).cast("int").alias("predicted"), "toxicity.n_hits", "toxicity.n_words")
