"""Operator 9: secret scans by assignment-aware lexing.

Base patterns find assignments to sensitive names, access keys and long hex
runs. Beside them a tokenizer reads the text as source or configuration:
strings of all quotes (escaped, triple, over several lines, with prefixes),
names with dots and subscripts, typed declarations, bare values, block scalars,
here-documents, attributes and elements. What is assigned to what becomes a
graph; sensitive names send their weight along it, the most sensitive first,
to the literals that end up in them, through any number of constants. A
literal is scored by that weight and by what it looks like; those that reach
the threshold are ``pair`` spans.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in their fixed order; the last is the lexer's.
KINDS = ("assign", "access", "hex", "pair")

# The patterns of the base kinds. Runs that are too short could
# not match in part, so the least lengths stand inside the patterns.
_ASSIGN = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(?P<value>[A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: Sensitive parts of names and how much each says (fixed values).
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "privatekey": 1.0, "accesskey": 0.9, "credential": 0.8, "credentials": 0.8, "auth": 0.6, "bearer": 0.8, "signingkey": 0.9, "encryptionkey": 0.9}
#: Literals that stand for nothing (fixed values).
PLACEHOLDERS = {"changeme", "example", "none", "null", "true", "false", "undefined", "your", "xxx", "todo", "placeholder", "redacted"}
THRESHOLD = 0.75

#: Texts without any of these hold no sensitive name.
_WORTH = re.compile("pass|pwd|secret|token|key|credential|auth|bearer", re.I | re.A)
#: Words that stand between a name and its value in declarations (fixed values).
TYPES = frozenset("string str char bytes byte text varchar bool int long float double object any auto std.string".split())
_PREFIXES = frozenset("f r b u fr rf br rb l s".split())
_SPACE = re.compile(r"[^\S\n]+")
_WORD = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*(?:[.-][A-Za-z0-9_$]+)*", re.A)
_HERE = re.compile(r"""<<[-~]?[ ]?(["']?)([A-Za-z_][A-Za-z0-9_]*)\1""")
_OPERATOR = re.compile(r"::|:=|=>|===?|!==?|<=|>=|\+=|=|:|\+")
#: What a string of each quote holds, closed or not.
_HOLDS = {"'": re.compile(r"(?:[^'\\\n]++|\\.)*+", re.S), '"': re.compile(r'(?:[^"\\\n]++|\\.)*+', re.S)}
#: Characters from which on values without quotes that end at one place are weighed together.
LONG_BARE = 1_024
_BARE = re.compile(r"""[^\s"'`#;,)\]}<>]++""")
_HELD = re.compile(r"\$?\{([A-Za-z_][A-Za-z0-9_.]*)\}")
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:-]*)(?:\s[^<>]*+)?+>([^<>]++)</")
_FIRST_WORD = re.compile(r"^[ \t]*([A-Za-z_][A-Za-z0-9_]*)\b", re.M)
_ASSIGNS = frozenset([":=", "=>", "=", ":", "+="])

NAME, STRING, OPERATOR, LINE, HERE, OTHER = range(6)


def _fold(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", name.lower())


def name_weight(name: str) -> float:
    """How sensitive a name is: the weight of the strongest part in it."""
    parts = re.findall(r"[a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower())
    joined = [a + b for a, b in zip(parts, parts[1:])] + parts
    return max((SENSITIVE[p] for p in joined if p in SENSITIVE), default=0.0)


def literal_weight(value: str) -> float:
    """How much a literal looks like a secret: length and bits per character."""
    if len(value) < 6 or _fold(value) in PLACEHOLDERS or any(value.lower().startswith(p) for p in ("your", "example", "changeme", "${", "<")):
        return 0.0
    times = Counter(value).values()
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in times)
    return min(1.0, 0.4 + 0.1 * bits + 0.01 * min(len(value), 20))


def _long_weights(text: str, nodes: list[Assignment]) -> dict[tuple[int, int], tuple[float, bool]]:
    """For each long value without quotes its weight, by the rule of ``literal_weight``, and
    whether it has a digit. Those that end at one place are met from the last to the
    first, and characters counted once for all of them."""
    by_end: dict[int, set[int]] = {}
    for node in nodes:
        for start, end, value, _ in node.literals:
            if value is None:
                by_end.setdefault(end, set()).add(start)
    out = {}
    for end, begins in by_end.items():
        times, at = Counter(), end
        for start in sorted(begins, reverse=True):
            times.update(text[start:at])
            at, n = start, end - start
            letters = sum(k for c, k in times.items() if c.isascii() and c.isalnum())
            said = text[start : start + 10].lower()
            nothing = letters <= 16 and _fold(text[start:end]) in PLACEHOLDERS or said.startswith(("your", "example", "changeme", "${", "<"))
            bits = -sum(k / n * math.log2(k / n) for k in times.values())
            out[start, end] = (0.0 if nothing else min(1.0, 0.4 + 0.1 * bits + 0.2), any(times[d] for d in "0123456789"))
    return out


def tokens(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) in order, without white space but line ends. A
    string's place is that of what its quotes hold. One way forward: a quote
    that is not closed is a character, and is not looked for again: the escaped
    ones behind it, up to where its line ends, would not be closed either."""
    out, at, size, missing, open_until = [], 0, len(text), set(), {"'": 0, '"': 0}
    while at < size:
        c = text[at]
        if c == "\n":
            out.append((LINE, at, at + 1, c))
            at += 1
        elif c.isspace():
            at = _SPACE.match(text, at).end() if _SPACE.match(text, at) else at + 1
        elif c in "\"'`":
            # an apostrophe inside a word opens nothing, unless the word is a string's prefix
            inside = at > 0 and text[at - 1].isalnum() and not (out and out[-1][0] == NAME and out[-1][2] == at and out[-1][3].lower() in _PREFIXES)
            mark = c * 3 if text.startswith(c * 3, at) and c != "`" else c
            if len(mark) == 3 or c == "`":
                end = -1 if inside or mark in missing else text.find(mark, at + len(mark))
                if end < 0:
                    missing.add(mark)
                    out.append((OTHER, at, at + 1, c))
                    at += 1
                else:
                    out.append((STRING, at + len(mark), end, text[at + len(mark) : end]))
                    at = end + len(mark)
            elif not inside and at >= open_until[c] and text.startswith(c, end := _HOLDS[c].match(text, at + 1).end()):
                out.append((STRING, at + 1, end, text[at + 1 : end]))
                at = end + 1
            else:
                if not inside and at >= open_until[c]:
                    open_until[c] = end
                out.append((OTHER, at, at + 1, c))
                at += 1
        elif m := _WORD.match(text, at):
            out.append((NAME, at, m.end(), m[0]))
            at = m.end()
        elif c == "<" and (m := _HERE.match(text, at)):
            out.append((HERE, at, m.end(), m[2]))
            at = m.end()
        elif m := _OPERATOR.match(text, at):
            out.append((OPERATOR, at, m.end(), m[0]))
            at = m.end()
        else:
            out.append((OTHER, at, at + 1, c))
            at += 1
    return out


class Assignment:
    """A name with the literals and the names it is assigned: literals are
    (start, end, value, quoted); a long value without quotes is None, and read off the text."""

    __slots__ = ("at", "literals", "name", "refs")

    def __init__(self, name: str, at: int):
        self.name, self.at, self.literals, self.refs = name, at, [], []


class _Lines:
    """Where lines end and with which words they begin, looked up once for a
    text, and how far the last here-document reaches."""

    def __init__(self, text: str):
        self.text, self.reach, self._ends, self._words, self._bare = text, 0, None, None, (0, 0)

    def end(self, at: int) -> int:
        """The next line end from ``at`` on; -1 if there is none."""
        if self._ends is None:
            self._ends = [m.start() for m in re.finditer("\n", self.text)]
        i = bisect.bisect_left(self._ends, at)
        return self._ends[i] if i < len(self._ends) else -1

    def bare(self, at: int) -> int:
        """Where the value without quotes from ``at`` on ends; a run is looked through once."""
        if not self._bare[0] <= at < self._bare[1]:
            m = _BARE.match(self.text, at)
            self._bare = (at, m.end() if m else at)
        return self._bare[1] if self._bare[0] <= at < self._bare[1] else at

    def word(self, word: str, at: int) -> int:
        """The next line from ``at`` on that begins with ``word``; -1 if there is none."""
        if self._words is None:
            self._words = {}
            for m in _FIRST_WORD.finditer(self.text):
                self._words.setdefault(m[1], []).append(m.start())
        places = self._words.get(word, [])
        i = bisect.bisect_left(places, at)
        return places[i] if i < len(places) else -1


def _block(text: str, key: int, line_end: int) -> tuple[int, int]:
    """(start, end) of the lines after ``line_end`` that are indented deeper than the line of ``key``."""
    begin = text.rfind("\n", 0, key) + 1
    depth = key - begin - len(text[begin:key].lstrip(" -"))
    at, first, last = line_end + 1, -1, -1
    while 0 < at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        if line.strip():
            indent = len(line) - len(line.lstrip())
            if indent <= depth:
                break
            first, last = (at + indent if first < 0 else first), at + len(line.rstrip())
        at = end + 1
    return (first, last) if first >= 0 else (0, 0)


def _target(t: list, i: int) -> tuple[str, int] | None:
    """The name before the operator ``t[i]`` and where it is."""
    kind, start, _, value = t[i - 1]
    if kind == OTHER and value == "]" and i >= 4 and t[i - 2][0] in (STRING, NAME) and t[i - 3][3] == "[" and t[i - 4][0] == NAME:
        return f"{t[i - 4][3]}.{t[i - 2][3]}", t[i - 4][1]
    if kind == STRING and len(value) <= 200 or kind == NAME:
        if kind == NAME and i >= 2 and value.lower() in TYPES:
            if t[i - 2][0] == NAME:  # name type = value
                return t[i - 2][3], t[i - 2][1]
            if i >= 3 and t[i - 2][3] == ":" and t[i - 3][0] in (NAME, STRING):  # name: type = value
                return t[i - 3][3], t[i - 3][1]
        return value, start
    return None


def _value(text: str, t: list, i: int, made: Assignment, key: int, lines: _Lines, stops: list[int]) -> None:
    """Read the value that starts at the token ``t[i]``: strings, joined or side by
    side, make one literal; names and what strings hold in braces are references.
    ``stops`` has for each token the next here-document or line end."""
    run: list[tuple[int, int, str]] = []
    joined = True

    def close() -> None:
        if run:
            made.literals.append((run[0][0], run[-1][1], _HELD.sub("", "".join(v for _, _, v in run)), True))
            run.clear()

    while i < len(t):
        kind, start, end, value = t[i]
        after = t[i + 1] if i + 1 < len(t) else (LINE, end, end, "")
        if kind == STRING:
            run.append((start, end, value))
            made.refs += [(name, start) for name in _HELD.findall(value)]
            joined = False
        elif kind == NAME and value.lower() in _PREFIXES and after[0] == STRING and text[end] in "\"'":
            pass
        elif not joined and kind == OPERATOR and value == "+":
            joined = True
        elif kind == LINE and (run and after[0] == STRING or joined and i > 0 and t[i - 1][3] in ("+", "(", "\\")):
            pass  # strings go on in the next line inside brackets or after an operator
        elif kind == OTHER and value in "(\\" and joined and not run:
            pass
        elif kind == OTHER and value in "|>" and text[end : text.find("\n", end) if "\n" in text[end : end + 4] else end].strip("+-0123456789 ") == "" and "\n" in text[end : end + 4]:
            s, e = _block(text, key, text.find("\n", end))
            if e > s:
                made.literals.append((s, e, text[s:e], True))
            break
        elif kind == HERE:
            # what looks like one inside another is part of its text
            line = lines.end(end) if start >= lines.reach else -1
            over = lines.word(value, line + 1) if line >= 0 else -1
            if over > line + 1:
                made.literals.append((line + 1, over - 1, text[line + 1 : over - 1], True))
                lines.reach = over
            break
        elif kind == NAME and value == "$" and after[3] == "(":  # a command whose input may be a here-document
            i = stops[i + 1] - 1
        elif joined and kind in (NAME, OTHER) and (stop := lines.bare(start)) > start:
            if stop == end and kind == NAME:
                if after[3] in ("(", "["):
                    break  # what a call gives is not known
                made.refs.append((value, start))
                close()
                joined = False
                if after[3] != "+":
                    made.literals.append((start, end, value, False))
            else:
                made.literals.append((start, stop, text[start:stop] if stop - start <= LONG_BARE else None, False))
                break
        else:
            break
        i += 1
    close()


def assignments(text: str) -> list[Assignment]:
    """All assignments of a text, in order."""
    t, out, lines = tokens(text), [], _Lines(text)
    stops = [len(t)] * (len(t) + 1)
    for i in range(len(t) - 1, -1, -1):
        stops[i] = i if t[i][0] in (HERE, LINE) else stops[i + 1]
    for i in range(1, len(t)):
        if t[i][0] == OPERATOR and t[i][3] in _ASSIGNS and (found := _target(t, i)):
            if t[i][3] == ":" and i + 2 < len(t) and t[i + 1][0] == NAME and t[i + 1][3].lower() in TYPES and t[i + 2][3] == "=":
                continue  # the operator after the type counts
            made = Assignment(found[0], found[1])
            _value(text, t, i + 1, made, found[1], lines, stops)
            if made.literals or made.refs:
                out.append(made)
    for m in _ELEMENT.finditer(text):
        if value := m[2].strip():
            made, start = Assignment(m[1], m.start(1)), m.end(2) - len(m[2].lstrip())
            made.literals.append((start, start + len(value), value, False))
            out.append(made)
    return out


def lexed(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of literals that end up under sensitive names.

    A reference means the last assignment to that name before it, or else the
    first after it; ``a.b`` means ``b`` where nothing is assigned to ``a.b``.
    Every assignment is visited once, from the most sensitive name that reaches it."""
    if not _WORTH.search(text):
        return []
    nodes = assignments(text)
    known: dict[str, list[int]] = {}
    for i, node in enumerate(nodes):
        known.setdefault(node.name, []).append(i)
        if "." in node.name:
            known.setdefault("." + node.name.rpartition(".")[2], []).append(i)
    places = {name: [nodes[i].at for i in of] for name, of in known.items()}
    weights = [name_weight(n.name) for n in nodes]
    long = _long_weights(text, nodes)
    best: dict[tuple[int, int], float] = {}
    done = [False] * len(nodes)
    for first in sorted((i for i, w in enumerate(weights) if w > 0), key=lambda i: -weights[i]):
        todo = [(first, True)]
        while todo:
            i, direct = todo.pop()
            if done[i]:
                continue
            done[i] = True
            for name, at in nodes[i].refs:
                last = name.rpartition(".")[2]
                for other in (name, last, "." + last):
                    if other in known:
                        j = known[other][max(0, bisect.bisect_left(places[other], nodes[i].at) - 1)]
                        if j != i:
                            todo.append((j, False))
                        break
            for start, end, value, quoted in nodes[i].literals:
                weight, digit = long[start, end] if value is None else (None, False)
                if quoted or not direct or digit or value is not None and re.search("[0-9]", value):
                    score = weights[first] * (literal_weight(value) if value is not None else weight)
                    if score >= THRESHOLD * 0.9:
                        best[start, end] = max(score, best.get((start, end), 0.0))
    return [(s, e, v) for (s, e), v in sorted(best.items())]


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans of a whole text, by start, then kind;
    code points, end exclusive. A null text is empty."""
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m["value"]) >= 6]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    if "=" in text or ":" in text or "</" in text:
        found += [("pair", s, e) for s, e, _ in lexed(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_pair, base_sha256, spans: one row
    per row of ``docs``, in place.

    Null and empty texts have no spans. Spans of different kinds may overlap;
    those of one base kind do not. Null and repeated ids pass through.
    """

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["t"]:
                spans = scan(text)
                n = Counter(k for k, _, _ in spans)
                base = _joined([x for x in spans if x[0] != "pair"])
                rows.append((*(n[k] for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), _joined(spans)))
            out = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
            out.insert(0, "doc_id", frame["id"].astype("Int64").to_numpy())
            yield out

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return rows.mapInPandas(of, "doc_id long, n_assign long, n_access long, n_hex long, n_pair long, base_sha256 string, spans string")
