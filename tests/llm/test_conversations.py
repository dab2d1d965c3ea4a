"""Operators 12 and 13 against brute force."""

from __future__ import annotations

import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest

from inkstone.llm import prefix_trie, repair
from inkstone.llm.queries import QUERIES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, depth int, a string"


def table(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_trie(rows):
    """Prefixes as tuples in a dictionary."""
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((turn is not None, turn or 0, sha(f"{len(role)}:{role}:{text}")), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = own.get(first, [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) if below else 1
        saved[p] = sum(saved[k] for k in below) + ((len(members[p]) - 1) * len(WORDS.findall(p[-1][1])) if p else 0)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(built[c]) == len(p))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below), leaves[p], saved[p], sha(ends)))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


def test_trie_query(spark, sf_dir):
    assert found(QUERIES["op12_prefix_trie"](spark, sf_dir)) == slow_trie([tuple(r) for r in table(spark, sf_dir).collect()])


@pytest.mark.parametrize("shard_turns", [1, 7, 60, 20_000])
def test_trie_in_shards(spark, shard_turns, monkeypatch):
    """Nulls, repeated rows and turns, equal conversations, a long one, negative ids, long texts; rounds of shards."""
    rng = random.Random(shard_turns)
    rows = []
    for c in [*range(-25, 90), 10**12]:
        deep = 90 if c in (7, 8, 60, 61) else rng.randrange(0, 6)
        for t in range(deep):
            text = "a b  c" if c in (60, 61) else rng.choice(["hello there", "what is\n\tit", "", None, "é" * 50])
            rows.append((c, rng.choice([t, t, None]) if c not in (60, 61) else t, rng.choice(["user", None]) if c not in (60, 61) else "user", text, 1, "x"))
    rows += rows[:30] + [(None, 1, "user", "nobody's", 1, "x"), (20, 5, "user", "word " * 20_000, 1, "x")]
    rng.shuffle(rows)
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    monkeypatch.setattr(prefix_trie, "GROWTH", 5)
    got = found(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), shard_turns=shard_turns))
    assert got == slow_trie(rows)


def test_trie_without_rows(spark):
    assert found(prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA))) == []
    nobody = spark.createDataFrame([(None, 1, "user", "x", 1, "x")], SCHEMA)
    assert found(prefix_trie.prefix_trie(nobody)) == []
    only = [(1, 1, "user", "x", 1, "x")]  # its only turn is the first of a conversation that is not there
    assert found(prefix_trie.prefix_trie(spark.createDataFrame(only, SCHEMA))) == slow_trie(only)


SHAPE = re.compile(r"(s?(ua)+)?")
SOLID = re.compile(r"[^\x20\x09-\x0D]")


def order_of(turn, role, text):
    return (turn is not None, turn or 0, sha(f"{len(role)}:{role}:{text}"))


def damage(rows):
    out = []
    for c, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            out += [(c, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def faults(rows):
    """blank, duplicate, truncated or nothing for each row of one conversation."""
    out, seen = [], set()
    for role, text in rows:
        solid = SOLID.findall(text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def slow_repair(rows, marks):
    """Cost, edits and what is left: all ways forward from each row, remembered."""
    step = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    @functools.cache
    def best(i, last, inserts):
        ways = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        if inserts < 2:
            cost, audit, left = best(i, step[last], inserts + 1) or (None, None, None)
            if cost is not None:
                ways.append((cost + 2, "I" + audit, (names[step[last]] + ":", *left)))
        if i < len(rows):
            (role, text), mark = rows[i], marks[i]
            tries = [("D", 3, last, None)]
            if mark not in ("blank", "duplicate"):
                more = mark == "truncated"
                if role[:1] == step[last] or (role[:1] == "s" and last == ""):
                    tries.append(("K", more, role[:1], f"{role}:{text}"))
                tries.append(("R", 2 + more, step[last], f"{names[step[last]]}:{text}"))
            for letter, charge, to, line in tries:
                rest = best(i + 1, to, 0)
                if rest:
                    ways.append((rest[0] + charge, letter + rest[1], rest[2] if line is None else (line, *rest[2])))
        return min(ways, default=None)

    return best(0, "", 0)


def slow_conversations(rows):
    out = []
    after = damage(rows)
    for c in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in after if r[0] == c), key=lambda r: order_of(*r))
        turns = [t for t, _, _ in mine if t is not None]
        texts = [(role, text) for _, role, text in mine]
        marks = faults(texts)
        cost, audit, left = slow_repair(texts, marks)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(texts))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(left))))
    return sorted(out, key=repr)


def repaired(df):
    return sorted((tuple(r) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=repr)


def test_repair_query(spark, sf_dir):
    assert repaired(QUERIES["op13_conversation_repair"](spark, sf_dir)) == slow_conversations([tuple(r) for r in table(spark, sf_dir).collect()])


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_repair_in_blocks(spark, block):
    rng = random.Random(block)
    rows = []
    for c in [None, *range(-5, 40)]:
        for t in range(rng.choice([1, 3, 6, 9, 60])):
            rows.append((c, rng.choice([t, t, t, t + 2, None]), rng.choice(["user", "assistant", "system", "tool", "", None, "assistant"]), rng.choice(["Yes.", "no", " \n", "What?  ", None, f"Turn {t}!", "wörd.", "same."]), 1, "x"))
    rows += rows[:20] + [(3, 7, "user", "long " * 50_000, 1, "x")]
    rng.shuffle(rows)
    assert repaired(repair.repair(spark.createDataFrame(rows, SCHEMA), block=block)) == slow_conversations(rows)


def test_repair_without_rows(spark):
    assert repaired(repair.repair(spark.createDataFrame([], SCHEMA))) == []
    lost = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    rows = [(5, lost, "user", "Gone.", 1, "x")]
    assert repaired(repair.repair(spark.createDataFrame(rows, SCHEMA))) == [(5, 0, 0, 0, 0, 0, 0, "", sha(""))]
    kept = repaired(repair.repair(spark.createDataFrame(rows, SCHEMA), damage=False))
    assert kept == [(5, 0, 0, 0, 0, 0, 2, "KI", sha("user:Gone.\nassistant:"))]


def test_search_is_exhaustive():
    """Against all edit strings of few rows."""
    rng = random.Random(1)
    for _ in range(150):
        rows = "".join(rng.choice("suaxSUAXbd") for _ in range(rng.randrange(0, 4)))
        best = None
        for inserts in itertools.product(range(3), repeat=len(rows) + 1):
            for edits in itertools.product("KRD", repeat=len(rows)):
                if any(e != "D" and r in "bd" for e, r in zip(edits, rows)):
                    continue
                audit = "".join("I" * n + e for n, e in itertools.zip_longest(inserts, edits, fillvalue=""))
                cost = 2 * sum(inserts) + sum({"K": 0, "R": 2, "D": 3}[e] + (e != "D" and r.isupper()) for e, r in zip(edits, rows))
                slots = [x for n, e, r in itertools.zip_longest(inserts, edits, rows, fillvalue="") for x in ["?"] * n + ([r.lower()] if e == "K" else ["?"] if e == "R" else [])]
                shapes = ["".join(p) for p in itertools.product(*(["u", "a"] if x == "?" else [x] for x in slots))]
                if any(SHAPE.fullmatch(p) for p in shapes) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
        found = [w for e, w in enumerate(repair.search(rows, 0)) if w and e in repair.ENDS]
        assert min(found) == best, rows


def test_many_rows(spark):
    """Many blocks of one conversation."""
    rng = random.Random(5)
    rows = "".join(rng.choice("uauauaxSd") for _ in range(5_000))
    whole = min(w for e, w in enumerate(repair.search(rows, 0)) if w and e in repair.ENDS)
    import pandas as pd

    parts = pd.DataFrame([(1, i, rows[i * 512 : i * 512 + 512]) for i in range(-(-len(rows) // 512))], columns=["conv_id", "block", "rows"])
    joined = pd.concat(repair._join(repair._solve([parts])))
    assert (joined["cost"].iloc[0], joined["audit"].iloc[0]) == whole
