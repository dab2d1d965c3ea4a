"""Operator 13: repair of a conversation's structure.

Rows are kept, given another role, deleted, or joined by inserted ones, so that
roles read as an optional system turn and then pairs of user and assistant. The
cheapest edits are found by A* on the lattice of rows and roles: what is left of
a conversation costs at least its mandatory deletions and one for each
truncated row, and places are visited in the order of that sum, then of the edits
so far. Long conversations are solved block by block, from every role and to
every role, and the blocks are joined like links of a chain.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .prefix_trie import carried, content, dealt
from .shared import forget, written

#: Rows of a block.
BLOCK = 1_024
#: The conversation of rows without one; no id has this.
NULL_IDS = -(1 << 63)
#: What edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
#: Roles so far: none, system, user, assistant. A conversation ends after none or an assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NONE, ASSISTANT)
#: The role that a user or an assistant row may follow, and where it leads.
FOLLOWS = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: A row's code: b blank, d duplicate, else its role's initial (x for any other), in upper case if truncated.
MUST_GO = "bd"


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role and text of the rows left, damaged by the checksum of
    ``conv_id:turn``; null roles and texts, and nulls in that key, are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))
    rows = rows.withColumn("code", F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("code") == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("_copy", "copies")


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with a place in their conversation: untimed first, then by turn,
    then by the hash of role and text, so that copies lie side by side."""
    half = lambda i: F.conv(F.substring("digest", i, 15), 16, 10).cast("long")
    rows = rows.withColumn("digest", content(F.col("role"), F.col("text"))).withColumns({"k1": half(1), "k2": half(16), "timed": F.col("turn").isNotNull().cast("int")})
    return rows.select(F.coalesce("conv_id", F.lit(NULL_IDS).cast("long")).alias("conv_id"), "timed", F.coalesce("turn", F.lit(0).cast("long")).alias("turn"), "k1", "k2", "role", "text")


ORDER = ["timed", "turn", "k1", "k2"]


def codes(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, code) of keyed rows; ``pos`` counts from 1. Texts are read
    in place and stay there."""
    solid = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    ended = F.right(solid, F.lit(1)).isin(".", "!", "?")
    narrow = rows.select("conv_id", *ORDER, F.when(solid == "", "b").when(ended, known).otherwise(F.upper(known)).alias("code"))
    parts = dealt(narrow, *ORDER)
    inside = Window.partitionBy("conv_id", "_part").orderBy(*ORDER)
    placed = written(carried(parts, F.count("*")).select("conv_id", "k1", "k2", "code", (F.row_number().over(inside) + F.col("_0")).alias("pos")))
    forget(parts)
    first = placed.groupBy("conv_id", "k1", "k2").agg(F.min("pos").alias("first"))
    # nothing is decided by a whole group: a much repeated row's matches can be split
    return placed.join(first, ["conv_id", "k1", "k2"]).select("conv_id", "pos", F.when((F.col("code") != "b") & (F.col("pos") > F.col("first")), "d").otherwise(F.col("code")).alias("code"))


def search(rows: str, start: int) -> list[tuple[int, str] | None]:
    """Cost and edits of the cheapest way from ``start`` through the coded rows
    to each role; of equally cheap ones the edits least by their letters.

    A* with the key (cost so far plus bound, edits). The bound never falls faster
    than cost rises, and edits of a way are longer and so larger than those of its
    beginnings: the first visit of a place is the one that counts.
    """
    bound = [0] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        bound[i] = bound[i + 1] + (DELETE if rows[i] in MUST_GO else TRUNCATED * rows[i].isupper())
    found: list[tuple[int, str] | None] = [None] * 4
    seen, heap, open_ends = set(), [(bound[0], "", 0, start)], 4 if start == NONE else 3 if start == SYSTEM else 2
    while heap and open_ends:
        key, edits, i, role = heapq.heappop(heap)
        if (i, role) in seen:
            continue
        seen.add((i, role))
        cost = key - bound[i]
        if i == len(rows):
            found[role] = (cost, edits)
            open_ends -= 1
        heapq.heappush(heap, (cost + INSERT + bound[i], edits + "I", i, FOLLOWS[role]))
        if i == len(rows):
            continue
        heapq.heappush(heap, (cost + DELETE + bound[i + 1], edits + "D", i + 1, role))
        if rows[i] in MUST_GO:
            continue
        charge, initial = TRUNCATED * rows[i].isupper(), rows[i].lower()
        to = SYSTEM if initial == "s" and role == NONE else FOLLOWS[role] if initial == NAMES[FOLLOWS[role]][0] else None
        if to is not None:
            heapq.heappush(heap, (cost + charge + bound[i + 1], edits + "K", i + 1, to))
        heapq.heappush(heap, (cost + REROLE + charge + bound[i + 1], edits + "R", i + 1, FOLLOWS[role]))
    return found


#: Short conversations repeat a few patterns.
_known = functools.lru_cache(4_096)(search)


def _solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for conv, block, rows in frame.itertuples(index=False):
            solve = _known if len(rows) <= 32 else search
            ways = [w for s in ((NONE,) if block == 0 else range(4)) for w in solve(rows, s)]
            upper = sum(map(str.isupper, rows))
            out.append((conv, block, rows.count("b"), rows.count("d"), upper, [-1 if w is None else w[0] for w in ways], ["" if w is None else w[1] for w in ways]))
        yield pd.DataFrame(out, columns=["conv_id", "block", "blank", "duplicate", "truncated", "costs", "ways"])


def _join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks, which come in order, joined to one row for each conversation. Only
    the best way to each role is held."""
    names = ["conv_id", "blank", "duplicate", "truncated", "cost", "audit"]
    now, counts, best = None, [0, 0, 0], {}

    def row() -> tuple:
        cost, audit = min(best[e] for e in ENDS if e in best)
        return (now, *counts, cost, audit)

    for frame in frames:
        out = []
        for conv, _, blank, duplicate, truncated, costs, ways in frame.itertuples(index=False):
            if conv != now:
                if now is not None:
                    out.append(row())
                now, counts, best = conv, [0, 0, 0], {NONE: (0, "")}
            counts = [a + b for a, b in zip(counts, (blank, duplicate, truncated))]
            following: dict[int, tuple[int, str]] = {}
            for start, (cost, audit) in best.items():
                for end in range(4):
                    if costs[4 * start + end] >= 0:
                        way = (cost + costs[4 * start + end], audit + ways[4 * start + end])
                        if end not in following or way < following[end]:
                            following[end] = way
            best = following
        if out:
            yield pd.DataFrame(out, columns=names)
    if now is not None:
        yield pd.DataFrame([row()], columns=names)


class _Repair:
    """One conversation, row by row: what is counted, and the hash of what is left."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.role, self.hash, self.lines = audit, 0, NONE, hashlib.sha256(), 0
        self.first = self.last = None
        self.turns = self.illegal = 0
        self.before: str | None = None

    def line(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) * (self.lines > 0)}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.lines += 1

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.role, self.at = FOLLOWS[self.role], self.at + 1
            self.line(NAMES[self.role], "")

    def row(self, timed: int, turn: int, role: str, text: str) -> None:
        if timed:
            self.first = turn if self.first is None else self.first
            self.turns, self.last = self.turns + (turn != self.last), turn
        if self.before is not None:
            self.illegal += self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        self.inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "R":
            self.role = FOLLOWS[self.role]
            self.line(NAMES[self.role], text)
        elif edit == "K":
            self.role = SYSTEM if role[:1] == "s" else FOLLOWS[self.role]
            self.line(role, text)

    def end(self) -> tuple[int, int, str]:
        self.inserts()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return gaps, self.illegal, self.hash.hexdigest()


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each conversation's verdict comes before its rows, which come in order and are not held."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    head, now = None, None

    def done() -> tuple:
        gaps, illegal, digest = now.end()
        return (head[0], gaps, *head[1:4], illegal, *head[4:], digest)

    for frame in frames:
        out = []
        for conv, kind, timed, turn, role, text, *verdict in frame.itertuples(index=False):
            if kind == 0:
                if now is not None:
                    out.append(done())
                head, now = (conv, *verdict), _Repair(verdict[-1])
            else:
                now.row(timed, turn, role, text)
        if out:
            yield pd.DataFrame(out, columns=names)
    if now is not None:
        yield pd.DataFrame([done()], columns=names)


def repair(conversations: DataFrame, damage: bool = True, block: int = BLOCK, **columns: str) -> DataFrame:
    """One row for each conv_id of ``conversations``: gaps, blank, duplicate,
    truncated, illegal, cost, audit and repaired_sha256. With ``damage`` the rows
    are damaged first (``damaged``), else taken as they are.

    Rows with a null conversation form one of their own. Null roles and texts are
    one space, so such rows are blank, or have a role that must change. Rows of
    one turn lie in the order of a hash of role and text; repeated rows are
    duplicates. A conversation without rows has zeros, no edits and the hash of
    nothing; an empty table gives an empty result. Other columns are not read.

    Texts are moved once, to be hashed in order as a stream; everything else is
    worked out on codes of one letter. A task holds one block of a conversation, or
    one letter for each of its rows.
    """
    names = ["conv_id", "turn", "role", "text"]
    given = conversations.select(*(F.col(columns.get(f"{n[:4]}_col", n)).alias(n) for n in names))
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = _keyed(damaged(given) if damage else given.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), space("role").alias("role"), space("text").alias("text")))
    coded = codes(rows).withColumn("block", F.expr(f"(pos - 1) div {block}"))
    # one block at most in a row
    blocks = coded.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("rows")).select("conv_id", "block", F.array_join(F.transform("rows", lambda r: r["code"]), "").alias("rows"))
    ways = blocks.mapInPandas(_solve, "conv_id long, block long, blank long, duplicate long, truncated long, costs array<long>, ways array<string>")
    verdict = ways.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInPandas(_join, "conv_id long, blank long, duplicate long, truncated long, cost long, audit string")
    verdict = written(verdict)
    counts = ("blank", "duplicate", "truncated", "cost")
    every = given.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NULL_IDS).cast("long")).alias("conv_id")).distinct()
    nothing = lambda c: F.lit(0).cast("long").alias(c)
    heads = every.join(verdict, "conv_id", "left").select("conv_id", F.lit(0).alias("kind"), F.lit(0).alias("timed"), *(nothing(c) for c in ("turn", "k1", "k2")), F.lit("").alias("role"), F.lit("").alias("text"), *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"))
    body = rows.select("conv_id", F.lit(1).alias("kind"), "timed", "turn", "k1", "k2", "role", "text", *(nothing(c) for c in counts), F.lit("").alias("audit"))
    both = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER)
    out = both.select("conv_id", "kind", "timed", "turn", "role", "text", *counts, "audit").mapInPandas(_apply, RESULT)
    return out.withColumn("conv_id", F.nullif(F.col("conv_id"), F.lit(NULL_IDS).cast("long")))
