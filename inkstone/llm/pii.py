"""Operator 10: personal data, in DataFrame functions only.

Regular expressions propose spans, validators confirm them (ranges of address
parts, Luhn for cards, mod-97 for account numbers, digit counts for phones),
and words before and behind a span adjust its score. Spans of the base kinds
stay whatever their score; those of the added kinds appear from a least score
on, so that a plain number of seven digits is a phone number only where the
words around it say so. Everything is one projection over
``text``: no shuffle and no Python on the executors.

The patterns are written so that Java's engine reads a text in linear time:
possessive runs, and starts only where the plain pattern's leftmost match can
start (after no character of the run, or right after the previous match).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}+(?: [A-Z0-9]{1,3})?+)(?![A-Za-z0-9])"
_LOCAL = r"[0-9][0-9().\x20/-]*[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, r"[^0-9]", "")


def luhn(found: Column) -> Column:
    """Whether the digits in a string pass the Luhn check."""
    backward = F.split(F.reverse(_digits(found)), "")
    value = F.transform(
        backward,
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(value, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(found: Column) -> Column:
    """Whether an account number leaves 1 modulo 97, its first four characters
    moved to the end and letters read as 10 to 35."""
    plain = F.replace(found, F.lit(" "), F.lit(""))
    moved = F.split(F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4))), "")
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(moved, F.lit(0), step) == 1


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. ``hint`` is a pattern that is found in any text
    with a match, so that other texts are not searched; ``valid`` takes the match
    and the character before it; ``score`` is in hundredths, and ``near`` are
    words whose presence close by raises it. Spans of the base have no ``least``."""

    name: str
    pattern: str
    hint: str
    valid: Callable[[Column, Column], Column]
    score: int
    near: str
    least: int | None = None


# The kinds, in their order.
KINDS = (
    Kind("email", _EMAIL, "@", lambda m, c: F.lit(True), 70, "mail|contact|write|reply"),
    Kind("ip", _IP, r"[0-9]\.[0-9]", lambda m, c: m.rlike(rf"^(?:{_PART}\.){{3}}{_PART}$"), 50, "ip|host|server|address|login"),
    Kind("card", _CARD, r"[0-9][ -]?[0-9]", lambda m, c: luhn(m), 60, "card|visa|credit|debit|payment|pay"),
    Kind("phone", _PHONE, r"\+[0-9]", lambda m, c: F.length(_digits(m)).between(8, 15), 50, "phone|tel|call|mobile|fax|contact"),
    Kind("iban", _IBAN, r"[A-Z]{2}[0-9]{2}[ A-Z0-9][A-Z0-9]", lambda m, c: mod97(m), 70, "iban|bank|account|transfer", 70),
    Kind("local", _LOCAL, r"[0-9][0-9().\x20/-]{5}", lambda m, c: F.length(_digits(m)).between(7, 12) & (c != "+") & ~m.rlike(r"^[0-9]+(?:\.[0-9]+){2,3}$|^[0-9]{4}-[0-9]{2}-[0-9]{2}"), 40, "phone|tel|call|mobile|fax", 60),
)

#: Characters before and behind a span in which context words are looked for, and what they add.
BEFORE, BEHIND, ADDS_BEFORE, ADDS_BEHIND = 48, 24, 20, 10
_SPAN = "array<struct<kind:string,start:int,end:int,found:string,score:int>>"


def _spans(text: Column, hits: Column, gaps: Column, kind: Kind) -> Column:
    """The valid hits with their places; ``gaps`` are the texts between all hits."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def near(at: Column, n: Column) -> Column:
        return F.lower(F.substring(text, at + 1, n)).rlike(rf"\b(?:{kind.near})")

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        before = F.when(near(F.greatest(begin - BEFORE, F.lit(0)), F.least(begin, F.lit(BEFORE))), ADDS_BEFORE).otherwise(0)
        score = F.lit(kind.score) + before + F.when(near(end, F.lit(BEHIND)), ADDS_BEHIND).otherwise(0)
        span = F.struct(F.lit(kind.name).alias("kind"), begin.alias("start"), end.alias("end"), x["hit"].alias("found"), score.alias("score"))
        valid = kind.valid(x["hit"], F.right(x["gap"], F.lit(1)))
        if kind.least is not None:
            valid = valid & (score >= kind.least)
        return F.struct(end.alias("at"), F.when(valid, F.concat(state["out"], F.array(span).cast(_SPAN))).otherwise(state["out"]).alias("out"))

    both = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.when(F.size(hits) > 0, F.aggregate(both, start, step, lambda s: s["out"])).otherwise(F.array().cast(_SPAN))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``found``: all spans of a row's text, by kind as listed, then
    start; code points, end exclusive. Null and empty texts have none; null and
    repeated ids pass through; other columns are not read.
    """
    at = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    none = F.array().cast("array<string>")
    for kind in KINDS:
        there = F.col("t").rlike(kind.hint)
        at = at.withColumn(f"hits_{kind.name}", F.when(there, F.regexp_extract_all("t", F.lit(kind.pattern), F.lit(0))).otherwise(none))
    for kind in KINDS:
        some = F.size(f"hits_{kind.name}") > 0
        at = at.withColumn(f"gaps_{kind.name}", F.when(some, F.split("t", kind.pattern, -1)).otherwise(none))
    spans = [_spans(F.col("t"), F.col(f"hits_{k.name}"), F.col(f"gaps_{k.name}"), k) for k in KINDS]
    return at.select("doc_id", F.concat(*spans).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and joined spans of ``personal_data``: n_<kind>, base_sha256 over
    the kinds of the base, spans, and their scores in the same order."""

    def of(name: str) -> Column:
        return F.filter("found", lambda s: s["kind"] == name)

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    base = F.filter("found", lambda s: s["kind"].isin([k.name for k in KINDS if k.least is None]))
    return found.select(
        "doc_id",
        *(F.size(of(k.name)).cast("long").alias(f"n_{k.name}") for k in KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined("found").alias("spans"),
        F.concat_ws(",", F.transform("found", lambda s: s["score"].cast("string"))).alias("scores"),
    )
