"""Operator 2: bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A document's ids go to
the window with the least room that still holds them (best fit). When none
holds them the fullest window is emitted: topped up with the head of those ids
where more than ``slack`` places would be padding. Only the windows' ids are in
memory. What is open when a partition ends is merged into at most one unfinished
window; these leftovers, one row for each partition, are merged in groups,
round by round, until one is left, which is cut at powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import union_all, written

#: The id after the last one of each document.
END = 2
#: Leftover windows merged by one task in one round.
FAN_IN = 32
#: Words whose ids a Python worker remembers.
REMEMBERED = 300_000

# What a tokenizer file must say so that its words can be encoded one by one.
_BY_WORDS = {
    "truncation": None,
    "padding": None,
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ROWS = f"{_PIECE}, part long, ids binary, pieces array<struct<doc_id: long, start: long, length: long, doc_tokens: long>>"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> Callable[[str], bytes]:
    """Text to its ids (little-endian unsigned 32-bit), as the tokenizer at
    ``path`` gives them for the whole text.

    A tokenizer with the rules of ``_BY_WORDS`` drops white space and never
    joins across it, so ids of words between white space are remembered and put
    together. Texts with characters that make this unsafe, and all texts of a
    tokenizer with other rules, are encoded whole.
    """
    import json
    import os
    from unicodedata import is_normalized

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    pieces, letter = tokenizer.model.tokenize, _byte_letters()

    def whole(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def letters(word: str) -> bytes:
        """Ids of a lower-case, composed word of letters only: one run for the model."""
        run = word if word.isascii() else "".join(letter[b] for b in word.encode())
        return np.array([p.id for p in pieces(run)], "<u4").tobytes()

    class Known(dict):
        def __missing__(self, word: str) -> bytes:
            stem = word.rstrip(".,;:!?*#%&$")
            low = stem.lower()
            if not low.isalpha() or "\u03a3" in stem or not is_normalized("NFC", stem):
                ids = whole(word)
            elif low == word:
                ids = letters(word)
            else:
                ids = self[low] + (self[word[len(stem) :]] if stem != word else b"")
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
            return ids

    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    if any(rules.get(key) != value for key, value in _BY_WORDS.items()) or rules["model"]["type"] != "BPE" or not all(t["content"].startswith("<|") for t in rules["added_tokens"]):
        return lambda text: whole(text)
    known = Known()

    def encode(text: str) -> bytes:
        if "<|" in text or not text.isprintable() and any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return whole(text)
        return b"".join([known[word] for word in text.split()])

    return encode


def _byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary writes each byte: printable
    Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class _Window:
    """Pieces put one after another; ids as bytes."""

    def __init__(self):
        self.used, self.pieces = 0, []

    def add(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> None:
        self.pieces.append((doc_id, start, ids, doc_tokens))
        self.used += len(ids) // 4

    def rows(self, sequence_id: int) -> list[tuple]:
        out, offset = [], 0
        for doc_id, start, ids, doc_tokens in self.pieces:
            out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), doc_tokens, sequence_id, offset, None, None, None))
            offset += len(ids) // 4
        return out


class _Packer:
    def __init__(self, size: int, slots: int, slack: int, number: Callable[[int], int]):
        self.size, self.slots, self.slack, self.number = size, slots, slack, number
        self.open: list[_Window] = []
        self.done: list[tuple] = []
        self.count = 0

    def emit(self, window: _Window) -> None:
        self.done += window.rows(self.number(self.count))
        self.count += 1

    def put(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> None:
        """Place a run of ids, of any length."""
        while ids:
            n = len(ids) // 4
            if n >= self.size:
                full = _Window()
                full.add(doc_id, start, ids[: 4 * self.size], doc_tokens)
                self.emit(full)
                start, ids = start + self.size, ids[4 * self.size :]
                continue
            fit = max((w for w in self.open if w.used + n <= self.size), key=lambda w: w.used, default=None)
            if fit is None and len(self.open) < self.slots:
                self.open.append(fit := _Window())
            if fit is not None:
                fit.add(doc_id, start, ids, doc_tokens)
                if fit.used == self.size:
                    self.open.remove(fit)
                    self.emit(fit)
                return
            fullest = max(self.open, key=lambda w: w.used)
            if (room := self.size - fullest.used) > self.slack:
                fullest.add(doc_id, start, ids[: 4 * room], doc_tokens)
                start, ids = start + room, ids[4 * room :]
            self.open.remove(fullest)
            self.emit(fullest)

    def close(self) -> _Window:
        """Merge the open windows; what fills no window is left over."""
        windows, self.open, slots, self.slots, self.slack = self.open, [], self.slots, 1, 0
        for window in windows:
            for piece in window.pieces:
                self.put(*piece)
        self.slots = slots
        return self.open.pop() if self.open else _Window()

    def put_at_powers(self, left: _Window) -> None:
        """Emit an unfinished window as windows whose lengths are powers of two."""
        rest, window, limit = left.used, _Window(), 0
        for doc_id, start, ids, doc_tokens in left.pieces:
            while ids:
                limit = limit or 1 << (rest.bit_length() - 1)
                take = min(limit - window.used, len(ids) // 4)
                window.add(doc_id, start, ids[: 4 * take], doc_tokens)
                start, ids = start + take, ids[4 * take :]
                if window.used == limit:
                    self.emit(window)
                    rest, window, limit = rest - limit, _Window(), 0


def _left(window: _Window, part: int) -> tuple:
    pieces = [{"doc_id": d, "start": s, "length": len(i) // 4, "doc_tokens": t} for d, s, i, t in window.pieces]
    return (*[None] * 7, part, b"".join(p[2] for p in window.pieces), pieces)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part"]
    out = pd.DataFrame({n: pd.array([r[i] for r in rows], "Int64") for i, n in enumerate(names)})
    return out.assign(ids=[r[8] for r in rows], pieces=[r[9] for r in rows])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, slots: int = 16, slack: int = 0, tokenizer_file: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id and offset, the sequences holding at most ``size`` ids.

    A document's ids are the tokenizer's and then ``END``; null and empty texts
    have that one id. Every id is in exactly one piece. All sequences are full
    but those that ``slack`` allows to be padded and the last ones, whose
    lengths are powers of two. Null or repeated ids of documents are packed
    like others; an empty table gives no piece; other columns are not read.
    """
    path = tokenizer_file or vocabulary_path()
    last = END.to_bytes(4, "little")

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, encode = TaskContext.get().partitionId(), encoder(path)
        packer = _Packer(size, slots, slack, lambda n: part << 28 | n)
        for frame in frames:
            for doc_id, text in zip(frame["id"], frame["t"]):
                ids = encode(text or "") + last
                packer.put(None if pd.isna(doc_id) else int(doc_id), 0, ids, len(ids) // 4)
                if len(packer.done) >= 10_000:
                    yield _frame(packer.done)
                    packer.done = []
        left = packer.close()
        if packer.done:
            yield _frame(packer.done)
        if left.used:
            yield _frame([_left(left, part)])

    def merge(level: int, final: bool):
        def of(frame: pd.DataFrame) -> pd.DataFrame:
            group = int(frame["part"].iloc[0]) // FAN_IN
            packer = _Packer(size, 1, 0, lambda n: level << 56 | group << 28 | n)
            for ids, pieces in frame.sort_values("part")[["ids", "pieces"]].itertuples(index=False):
                at = 0
                for p in pieces:
                    end = at + 4 * int(p["length"])
                    packer.put(None if p["doc_id"] is None or pd.isna(p["doc_id"]) else int(p["doc_id"]), int(p["start"]), ids[at:end], int(p["doc_tokens"]))
                    at = end
            left = packer.close()
            if final:
                packer.put_at_powers(left)
            elif left.used:
                return _frame([*packer.done, _left(left, group)])
            return _frame(packer.done)

        return of

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    now = written(rows.mapInPandas(first, _ROWS))
    out, level = [now.where("part is null")], 1
    while True:
        left = now.where("part is not null")
        most = left.agg(F.max("part")).first()[0]
        if most is None:
            break
        final = most < FAN_IN
        groups = left.withColumn("g", F.expr(f"part div {FAN_IN}"))
        now = written(groups.groupBy("g").applyInPandas(merge(level, final), _ROWS))
        out.append(now.where("part is null"))
        level += 1
        if final:
            break
    return union_all(out).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
