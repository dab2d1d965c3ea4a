"""Operator 8: benchmark decontamination by Wu-Manber multi-pattern search.

The symbols are words. Test windows of equal length are searched together: a
shift table over blocks of two words says how far the window may jump, a
suffix-hash bucket selects the test windows that end in the block seen, and
comparing all words confirms an occurrence. A benchmark of any size is searched
whole: in parts whose size has been checked, one after another. The driver and
the tasks hold one part at a time, and what one has found is written before the
next is read. Documents are never shuffled by content.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import sha_of, union_all, written

#: Words of a window, and the share of hit words (one in so many) that contaminates.
WINDOW, ONE_IN = 13, 20
#: Bytes of benchmark text that one part sent to the tasks holds at most, and words of a piece of it.
#: What a task builds of a part is up to some ninety times as large: 360 MB.
CHUNK_BYTES, PIECE_WORDS = 4 << 20, 100_000

#: Bytes to word bytes: ASCII letters in lower case, digits and all non-ASCII
#: bytes stand; every other byte is a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class WuManber:
    """All windows of one length."""

    def __init__(self, windows: dict[tuple[bytes, ...], frozenset]):
        self.length = len(next(iter(windows)))
        self.block = min(2, self.length)
        self.default = self.length - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for window, items in windows.items():
            for end in range(self.block, self.length + 1):
                key, far = window[end - self.block : end], self.length - end
                if far < self.shift.get(key, self.default):
                    self.shift[key] = far
            self.bucket.setdefault(window[-self.block :], {})[window] = items

    def search(self, text: list[bytes], hit: bytearray, found: set) -> None:
        """Mark the words inside occurrences in ``hit``, add their items to ``found``."""
        length, shift, default = self.length, self.shift, self.default
        end, n = length, len(text)
        while end <= n:
            block = (text[end - 2], text[end - 1]) if self.block == 2 else (text[end - 1],)
            far = shift.get(block, default)
            if far:
                end += far
                continue
            items = self.bucket[block].get(tuple(text[end - length : end]))
            if items is not None:
                hit[end - length : end] = b"\1" * length
                found |= items
            end += 1


def searchers(items: list[tuple[str | None, bytes]], window: int = WINDOW) -> list[WuManber]:
    """One search per window length, over pairs of an item's id and its words."""
    by_length: dict[int, dict] = {}
    same: dict[bytes, bytes] = {}  # a word is held once, however many windows have it
    for item_id, text in items:
        found, alone = [same.setdefault(w, w) for w in text.split(b" ")], frozenset([item_id])
        width = min(window, len(found))
        known = by_length.setdefault(width, {}) if width else {}
        for i in range(len(found) - width + 1 if width else 0):
            key = tuple(found[i : i + width])
            others = known.get(key)
            known[key] = alone if others is None or others == alone else others | alone
    return [WuManber(w) for w in by_length.values()]


def _pieces(window: int):
    """Items cut to at most ``PIECE_WORDS`` words, so that no part can be larger
    than planned; neighbours share ``window`` - 1 words, so no window is lost."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for item, text in zip(frame["item"], frame["t"]):
                found = words(text)
                starts = range(0, max(1, len(found) - window + 1), PIECE_WORDS) if found else ()
                made = [b" ".join(found[i : i + PIECE_WORDS + window - 1]) for i in starts]
                yield pd.DataFrame({"item": [item] * len(made), "t": made}, dtype=object)

    return of


def _parts(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> tuple[DataFrame, int]:
    """Distinct (item, t, part), written, and the number of parts, none of which
    has more than ``CHUNK_BYTES`` (a single piece is always less)."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("t")).where("t is not null")
    pieces = written(rows.mapInPandas(_pieces(window), "item string, t binary").distinct())
    size = F.sum(F.octet_length("t") + 64)
    parts = 2 * ((pieces.agg(size).first()[0] or 0) // CHUNK_BYTES) + 1
    part = lambda n: F.pmod(F.xxhash64("item", "t"), F.lit(n))
    while parts > 1 and pieces.groupBy(part(parts).alias("p")).agg(size.alias("size"), F.count("*").alias("n")).where(f"size > {CHUNK_BYTES} and n > 1").take(1):
        parts *= 2
    return pieces.withColumn("part", part(parts)), parts


#: The searches of the part that this Python worker has met last, by the part's name.
_BUILT: dict[str, list[WuManber]] = {}


def _sent(rows: list[tuple[str | None, bytes]], docs: DataFrame, window: int) -> tuple[Broadcast, Callable]:
    """A part of the benchmark, sent, and a function that gives its searches in a task."""
    sent, name = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

    def built() -> list[WuManber]:
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = searchers(sent.value, window)
        return _BUILT[name]

    return sent, built


_STATE = "n_words long, n_hit long, items array<string>"


def _searched(built: Callable, text: str | None) -> tuple[bytearray, list[str], int]:
    seen, items = words(text), set()
    hit = bytearray(len(seen))
    for s in built():
        s.search(seen, hit, items)
    return hit, sorted(items - {None}), len(seen)


def _at_once(docs: DataFrame, built: Callable, text_col: str) -> DataFrame:
    """All columns and ``_state``, where the benchmark is one part: row by row, in place."""

    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = [(n, sum(hit), items) for hit, items, n in (_searched(built, t) for t in texts)]
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "items"])

    return docs.withColumn("_state", F.pandas_udf(of, _STATE)(docs[text_col]))


def _in_turn(docs: DataFrame, pieces: DataFrame, parts: int, window: int, text_col: str) -> DataFrame:
    """The same for any number of parts. What a part finds is kept by the text's
    two hashes, for texts with a hit only, and put together at the end."""
    h1, h2 = (lambda t: F.xxhash64(t)), (lambda t: F.xxhash64(F.lit(8), t))
    texts = docs.select(h1(text_col).alias("h1"), h2(text_col).alias("h2"), F.col(text_col).alias("t"))
    found = []
    for i in range(parts):
        rows = [(r["item"], bytes(r["t"])) for r in pieces.where(F.col("part") == i).collect()]  # at most CHUNK_BYTES, see _parts
        sent, built = _sent(rows, docs, window)

        def of(frames: Iterator[pd.DataFrame], built: Callable = built) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = [(a, b, *_searched(built, t)[:2]) for a, b, t in zip(frame["h1"], frame["h2"], frame["t"])]
                yield pd.DataFrame([(a, b, bytes(hit), items) for a, b, hit, items in rows if any(hit)], columns=["h1", "h2", "hit", "items"])

        found.append(written(texts.mapInPandas(of, "h1 long, h2 long, hit binary, items array<string>").dropDuplicates(["h1", "h2"])))
        sent.unpersist()

    def joined(texts: pd.Series, hits: pd.Series, items: pd.Series) -> pd.DataFrame:
        rows = []
        for text, of, names in zip(texts, hits, items):
            total = 0
            for hit in () if of is None else of:
                total |= int.from_bytes(hit, "little")
            every = () if names is None else names
            rows.append((len(words(text)), total.bit_count(), sorted({x for some in every for x in some})))
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "items"])

    every = union_all(found).groupBy(F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).agg(F.collect_list("hit").alias("_hits"), F.collect_list("items").alias("_items"))
    both = docs.join(every, (h1(docs[text_col]) == F.col("_h1")) & (h2(docs[text_col]) == F.col("_h2")), "left")
    state = F.pandas_udf(joined, _STATE)(docs[text_col], F.col("_hits"), F.col("_items"))
    return both.select(*(docs[c] for c in docs.columns), state.alias("_state"))


def with_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, name: str = "contamination") -> DataFrame:
    """All columns of ``docs`` and a struct ``name``: n_words, n_hit, n_items,
    items (sorted strings), items_sha256, contaminated. Row by row, in place.

    A word is hit if it lies in any occurrence of a window of the benchmark; a
    document is contaminated if one word in ``ONE_IN`` or more is hit. Null and
    empty texts have no words and are clean; items without words match nothing;
    items without an id hit words but are not among the items found; repeated
    items count once. An empty benchmark leaves all documents clean.
    """
    pieces, parts = _parts(benchmark, item_col, item_text_col, window)
    if parts == 1:
        made = _at_once(docs, _sent([(r["item"], bytes(r["t"])) for r in pieces.collect()], docs, window)[1], text_col)  # at most CHUNK_BYTES
    else:
        made = _in_turn(docs, pieces, parts, window, text_col)
    at = F.col("_state")
    contaminated = (at["n_hit"] > 0) & (ONE_IN * at["n_hit"] >= at["n_words"])
    out = F.struct(at["n_words"].alias("n_words"), at["n_hit"].alias("n_hit"), F.size(at["items"]).cast("long").alias("n_items"), at["items"].alias("items"), sha_of(at["items"]).alias("items_sha256"), contaminated.alias("contaminated"))
    return made.select(*(docs.columns), out.alias(name))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id and the fields of ``with_contamination``, one row per row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return with_contamination(rows, benchmark, **how).select("doc_id", "contamination.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its contaminated rows."""
    marked = with_contamination(docs, benchmark, text_col, name="_contamination")
    return marked.where("not _contamination.contaminated").drop("_contamination")
