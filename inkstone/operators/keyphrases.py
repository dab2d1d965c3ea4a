"""Key phrases by the statistics of their words within one document.

A word weighs little, which is good, when it is often written with capitals,
occurs early, is frequent, is spread over sentences, and has few different
neighbours. A phrase of several words combines theirs with its own frequency.
Phrases are counted in Arrow batches of whole documents, all words at once.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import rows as W
from ..functions import text as X
from . import scoring

#: Words, and any mark, which phrases do not cross.
PIECE = r"[\p{L}\p{N}]+(?:['-][\p{L}\p{N}]+)*|[^\s]"
#: Decimals at which scores are compared.
DECIMALS = 9


def _words(text: Column) -> Column:
    """(t, s, p, left, right, capital, acronym) of every word of a text, by term: ``s`` its
    sentence, ``p`` its place there, ``left`` and ``right`` the words beside it without a mark between."""
    piece = lambda w, p, s: F.struct(F.when(w.rlike(r"^[\p{L}\p{N}]"), F.lower(w)).alias("t"), s.alias("s"), p.alias("p"), (w.rlike(r"^\p{Lu}") & (p > 0)).alias("capital"), w.rlike(r"^\p{Lu}{2,}$").alias("acronym"))
    pieces = F.flatten(F.transform(X.split_sentences(text), lambda x, s: F.transform(F.regexp_extract_all(x, F.lit(PIECE), F.lit(0)), lambda w, p: piece(w, p, s))))

    def placed(a: Column) -> Column:
        beside = lambda y, x: F.when(y["s"] == x["s"], y["t"])
        of = lambda x, i: F.struct(x["t"].alias("t"), x["s"].alias("s"), x["p"].alias("p"), beside(F.get(a, i - 1), x).alias("left"), beside(F.get(a, i + 1), x).alias("right"), x["capital"].alias("capital"), x["acronym"].alias("acronym"))
        return F.filter(F.transform(a, of), lambda x: x["t"].isNotNull())

    return F.sort_array(X.let(pieces, placed))


def _usable(term: Column) -> Column:
    """Words that may begin or end a phrase: letters, three at least, no stopword."""
    return term.rlike(r"^[\p{L}'-]{3,}$") & ~term.isin(P.STOPWORDS)


def word_weights(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, n, weight) for every word of a document; a small weight is a good one."""
    rows = W.fields(docs.select(id_col, X.let(_words(F.col(text_col)), _weights).alias("w")), [id_col], "w", "term")
    return rows.select(id_col, "term", F.col("n").cast("long").alias("n"), "weight")


def _weights(words: Column) -> Column:
    """(term, n, weight, usable, places) of each word, out of all of a document's words in their order."""
    some = lambda p, c: F.array_compact(F.transform(p, lambda x: x[c]))
    count = lambda p, c: F.size(F.filter(p, lambda x: x[c]))
    share = lambda p, c: X.let(some(p, c), lambda a: F.when(F.size(a) > 0, F.size(F.array_distinct(a)) / F.size(a)).otherwise(0.0))
    middle = lambda p: (F.get(p, F.floor((F.size(p) - 1) / 2).cast("int"))["s"] + F.get(p, F.floor(F.size(p) / 2).cast("int"))["s"]) / 2

    def stats(p: Column) -> Column:
        term, cased = F.get(p, F.lit(0))["t"], F.greatest(count(p, "capital"), count(p, "acronym")) / (1 + F.ln(F.size(p)))
        sentences = F.size(F.array_distinct(F.transform(p, lambda x: x["s"])))
        at = F.transform(p, lambda x: F.struct(x["s"].alias("s"), x["p"].alias("p")))
        return F.struct(term.alias("term"), F.size(p).alias("n"), _usable(term).alias("usable"), cased.alias("cased"), sentences.alias("sentences"), F.ln(F.ln(3 + middle(p))).alias("early"), (share(p, "left") + share(p, "right")).alias("company"), at.alias("places"))

    def weighed(all_: Column, n: Column, in_all: Column) -> Column:
        mean = F.coalesce(F.try_divide(F.aggregate(n, F.lit(0.0), lambda s, x: s + x), F.size(n)), F.lit(0.0))
        spread = lambda m: F.coalesce(F.sqrt(F.try_divide(F.aggregate(n, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)), F.size(n))), F.lit(0.0))
        often = X.let(mean, lambda m: F.greatest(m + spread(m), F.lit(1.0)))

        def weight(x: Column, most: Column, often: Column) -> Column:
            related = 1 + x["company"] * x["n"] / most
            return X.let(related, lambda r: F.round(r * x["early"] / (x["cased"] + x["n"] / often / r + x["sentences"] / in_all / r), DECIMALS))

        row = lambda x, most, o: F.struct(x["term"].alias("term"), x["n"].alias("n"), weight(x, most, o).alias("weight"), x["usable"].alias("usable"), x["places"].alias("places"))
        return X.let(F.struct(F.array_max(F.transform(all_, lambda x: x["n"])).alias("most"), often.alias("often")), lambda k: F.transform(all_, lambda x: row(x, k["most"], k["often"])))

    counts = lambda a: F.transform(F.filter(a, lambda x: x["usable"]), lambda x: x["n"].cast("double"))
    last = F.array_max(F.transform(words, lambda x: x["s"])) + 1
    return X.let(scoring.runs(words, lambda x: x["t"], stats), lambda a: X.let(F.struct(counts(a).alias("n"), last.alias("last")), lambda k: weighed(a, k["n"], k["last"])))


#: Pieces of texts that are counted at once; a longer text is counted alone.
PIECES = 200_000
PHRASES = "array<struct<phrase:string,size:int,n:long,score:double,at:struct<sent_idx:int,pos:int>>>"


def _pieces(text: Column) -> Column:
    """The words of each sentence, an empty string for each mark between them."""
    return F.transform(X.split_sentences(text), lambda x: F.regexp_extract_all(x, F.lit(f"({PIECE[: PIECE.index('|')]}){PIECE[PIECE.index('|') :]}"), F.lit(1)))


def rounded(x: np.ndarray) -> np.ndarray:
    """To ``DECIMALS``, half up as Spark rounds; what is close to a half by its decimals."""
    times = 10.0**DECIMALS
    out = np.floor(x * times + 0.5) / times
    for i in np.flatnonzero(np.abs(x * times - np.floor(x * times) - 0.5) < 1e-4):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-DECIMALS), ROUND_HALF_UP))
    return out


@dataclass
class Phrases:
    """Phrases of some documents, by document, score and first place."""

    words: list[str]
    doc: np.ndarray
    terms: np.ndarray  # (phrases, longest): numbers of words, -1 behind the last
    size: np.ndarray
    n: np.ndarray
    score: np.ndarray
    sentence: np.ndarray
    place: np.ndarray

    def name(self, i: int) -> str:
        return " ".join([self.words[t] for t in self.terms[i, : self.size[i]]])


def counted(rows: pa.ListArray, longest: int) -> Phrases:
    """The phrases of documents, each a list of sentences, each a list of ``_pieces``: all
    words of the documents are sorted together, and a document's words are runs of that."""
    lists = rows.flatten()
    known = lists.flatten().dictionary_encode()
    code = known.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pieces = known.dictionary.to_pylist()
    low = [w.lower() for w in pieces]
    words = sorted(set(low))
    number = {w: i for i, w in enumerate(words)}
    kinds = [[unicodedata.category(c) for c in w] for w in pieces]
    usable = np.array([len(w) >= 3 and w not in _STOP and all(c in "'-" or unicodedata.category(c)[0] == "L" for c in w) for w in words], bool)
    flag = lambda f: np.array([f(k) for k in kinds], bool)[code] if kinds else np.zeros(0, bool)
    of_doc, of_sentence = (pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (rows, lists))
    number_in = lambda sizes: np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    sentence, doc, place = np.repeat(number_in(of_doc), of_sentence), np.repeat(np.repeat(np.arange(len(of_doc)), of_doc), of_sentence), number_in(of_sentence)
    term = np.array([number[w] for w in low], np.int64)[code] if low else code
    is_word = flag(lambda k: len(k) > 0)
    capital, acronym = flag(lambda k: k[:1] == ["Lu"]) & (place > 0), flag(lambda k: len(k) > 1 and set(k) == {"Lu"})
    # a run of words: how many words stand behind a piece without a mark or the end of its sentence
    left = np.where((place > 0) & np.roll(is_word, 1), np.roll(term, 1), -1)
    right = np.where((np.roll(place, -1) > 0) & np.roll(is_word, -1), np.roll(term, -1), -1)
    if len(right):
        right[-1] = -1

    at = np.flatnonzero(is_word)
    at = at[np.lexsort((at, term[at], doc[at]))]
    key = doc[at] * (len(words) + 1) + term[at]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(at) else np.zeros(0, np.int64)
    n = np.diff(np.append(new, len(at)))
    group = np.repeat(np.arange(len(new)), n)
    per = lambda x: np.bincount(group, x, len(new))
    s = sentence[at]
    sentences = per(np.concatenate([[True], s[1:] != s[:-1]]) | (np.arange(len(at)) == np.repeat(new, n))) if len(at) else np.zeros(0)
    middle = (s[new + (n - 1) // 2] + s[new + n // 2]) / 2

    def share(beside: np.ndarray) -> np.ndarray:
        some = beside[at] >= 0
        of = group[some]
        different = np.unique(of * (len(words) + 1) + beside[at][some]) // (len(words) + 1)
        count = np.bincount(of, minlength=len(new))
        return np.where(count > 0, np.bincount(different, minlength=len(new)) / np.maximum(count, 1), 0.0)

    mine, term_of, docs = doc[at[new]], term[at[new]], len(of_doc)
    most, last = np.zeros(docs), np.zeros(docs)
    np.maximum.at(most, mine, n)
    np.maximum.at(last, doc[at], s)
    some = usable[term_of] if len(new) else np.zeros(0, bool)
    count = np.maximum(np.bincount(mine[some], minlength=docs), 1)
    mean = np.bincount(mine[some], n[some], docs) / count
    away = n - mean[mine]
    often = np.maximum(mean + np.sqrt(np.bincount(mine[some], (away * away)[some], docs) / count), 1.0)
    cased = np.maximum(per(capital[at]), per(acronym[at])) / (1 + np.log(n))
    related = 1 + (share(left) + share(right)) * n / most[mine]
    weight = np.zeros(len(code))
    weight[at] = rounded(related * np.log(np.log(3 + middle)) / (cased + n / often[mine] / related + sentences / (last[mine] + 1) / related))[group]

    found = []
    whole, ids, product, total = is_word.copy(), np.where(is_word, term, 0), weight.copy(), weight.copy()
    good = usable[term] & is_word if len(words) else is_word
    for k in range(1, longest + 1):
        if k > 1:
            here, there = np.arange(len(code) - k + 1), np.arange(k - 1, len(code))
            whole, ids, product, total = whole[: len(here)], ids[: len(here)], product[: len(here)], total[: len(here)]
            whole = whole & is_word[there] & (place[there] == place[here] + k - 1)
            product, total = product * weight[there], total + weight[there]
            ids = np.unique(ids * (len(words) + 1) + term[there], return_inverse=True)[1]
        first = np.flatnonzero(whole & good[: len(whole)] & good[k - 1 : k - 1 + len(whole)])
        _, where, times = np.unique(doc[first] * (int(ids.max(initial=0)) + 1) + ids[first], return_index=True, return_counts=True)
        first = first[where]
        terms = np.full((len(first), longest), -1)
        for j in range(k):
            terms[:, j] = term[first + j]
        found.append((doc[first], terms, np.full(len(first), k), times, rounded(product[first] / (times * (1 + total[first]))), sentence[first], place[first]))
    columns = [np.concatenate(c) for c in zip(*found)]
    order = np.lexsort((columns[2], columns[6], columns[5], columns[4], columns[0]))
    return Phrases(words, *(c[order] for c in columns))


_STOP = frozenset(P.STOPWORDS)


def _portions(rows: pa.Array) -> Iterator[pa.Array]:
    """Documents side by side, ``PIECES`` pieces at a time."""
    lists = rows.flatten()
    ends = np.cumsum([0, *pc.list_value_length(lists).to_numpy(zero_copy_only=False)])[np.cumsum([0, *pc.list_value_length(rows).to_numpy(zero_copy_only=False)])]
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECES, "right")) - 1)
        yield rows.slice(at, to - at)
        at = to


def phrase_weights(docs: DataFrame, longest: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, phrase, size, n, score): runs of up to ``longest`` words that begin and
    end with usable ones; the smallest score is the best. All out of a document's own row."""

    def of(rows: pa.Array) -> pa.Array:
        parts = []
        for some in _portions(rows):
            p = counted(some, longest)
            place = pa.StructArray.from_arrays([pa.array(p.sentence, pa.int32()), pa.array(p.place, pa.int32())], ["sent_idx", "pos"])
            fields = [pa.array([p.name(i) for i in range(len(p.doc))], pa.string()), pa.array(p.size, pa.int32()), pa.array(p.n, pa.int64()), pa.array(p.score), place]
            parts.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(p.doc, np.arange(len(some) + 1)), pa.int32()), pa.StructArray.from_arrays(fields, ["phrase", "size", "n", "score", "at"])))
        return pa.concat_arrays(parts)

    rows = W.fields(docs.select(id_col, F.arrow_udf(of, PHRASES)(_pieces(F.col(text_col))).alias("p")), [id_col], "p", "phrase")
    return rows.select(id_col, "phrase", "size", "n", "score", "at")


def within(a: str, b: str, most: int) -> int | None:
    """The edit distance of two strings if it is ``most`` or less."""
    if abs(len(a) - len(b)) > most:
        return None
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b or most == 0:
        return max(len(a), len(b)) if max(len(a), len(b)) <= most else None
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0], least = row[0], i, i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
            least = min(least, row[j])
        if least > most:
            return None
    return row[-1] if row[-1] <= most else None


@functools.lru_cache(10_000)
def _most_edits(length: int, alike: float) -> int:
    """The largest distance at which two phrases, the longer of this length, are too much alike; -1 if even equal ones are not."""
    d = max(-1, int((1 - alike) * length) + 1)
    while d >= 0 and not 1 - d / length > alike:
        d -= 1
    return d


def _best(p: Phrases, order: range, top: int, alike: float) -> list[int]:
    kept, names = [], []
    for i in order:
        if len(kept) >= top:
            break
        name = p.name(i)
        for other in names:
            most = _most_edits(max(len(name), len(other)), alike)
            # phrases differ, and a distance is no less than the difference of the lengths: most pairs are told apart by these
            if most > 0 and abs(len(name) - len(other)) <= most and within(name, other, most) is not None:
                break
        else:
            kept.append(i)
            names.append(name)
    return kept


def keyphrases(docs: DataFrame, longest: int = 2, top: int = 40, least_words: int = 2, alike: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rank, phrase, score): the ``top`` best phrases of each document. One
    whose edit similarity to a better one exceeds ``alike`` is left out; what
    has fewer than ``least_words`` words goes after that. Phrases of equal score
    come by first appearance, then by themselves. Null and empty texts have none."""

    def of(rows: pa.Array) -> pa.Array:
        sizes, names, scores = [0], [], []
        for some in _portions(rows):
            p = counted(some, longest)
            ends = np.searchsorted(p.doc, np.arange(len(some) + 1)).tolist()
            for a, b in zip(ends, ends[1:]):
                best = [i for i in _best(p, range(a, b), top, alike) if p.size[i] >= least_words]
                names += [p.name(i) for i in best]
                scores += p.score[best].tolist()
                sizes.append(len(names))
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["phrase", "score"]))

    ranked = F.arrow_udf(of, "array<struct<phrase:string,score:double>>")(_pieces(F.col(text_col)))
    rows = W.numbered(docs.select(id_col, ranked.alias("k")), [id_col], "k", "rank", "x")
    return rows.select(id_col, "rank", "x.phrase", "x.score")
