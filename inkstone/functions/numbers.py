"""Spelled-out English cardinals, as column expressions.

A text is cut into words and marks with their places; a fold over them joins
number words to numbers ("two hundred and five", "twenty-one", "five thousand").
The words and the grammar are this library's own: cardinals below a trillion
times a thousand, in British and American style, no ordinals, no fractions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

# Number words.
UNITS = "zero one two three four five six seven eight nine".split()
TEENS = "ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = {"thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12}

#: A text without a match of this has no spelled-out number.
ANY = r"(?i)\b(?:" + "|".join([*UNITS, *TEENS, *TENS, "hundred", *SCALES]) + r")\b"
TOKEN = r"(?U)\w+|[^\w\s]+"
SPAN = "array<struct<start:int,end:int,digits:string>>"
#: Kinds of words, in the order of size; 0 is none, 9 is ``and`` or a hyphen that may join.
_NONE, _UNIT, _TEEN, _TEN, _HUNDRED, _SCALE, _JOIN = 0, 1, 2, 3, 4, 5, 9
_STATE = "struct<at:int,spans:array<struct<start:int,end:int,digits:string>>,start:int,end:int,total:bigint,now:bigint,scale:bigint,last:int,join:int>"


def _of(word: Column) -> tuple[Column, Column]:
    """(kind, value) of a lower-case word."""
    kind, value = F.when(word.isin(UNITS), _UNIT), None
    for n, w in [*enumerate(UNITS), *enumerate(TEENS, 10), *((10 * i, w) for i, w in enumerate(TENS, 2)), (100, "hundred"), *((v, w) for w, v in SCALES.items())]:
        value = (F if value is None else value).when(word == w, F.lit(n).cast("long"))
    kind = kind.when(word.isin(TEENS), _TEEN).when(word.isin(TENS), _TEN).when(word == "hundred", _HUNDRED).when(word.isin(list(SCALES)), _SCALE).when(word.isin("and", "-"), _JOIN)
    return kind.otherwise(_NONE), value.otherwise(F.lit(0).cast("long"))


def spans(c: Column) -> Column:
    """(start, end, digits) of each spelled-out number, in order; places count from 0, the end is exclusive."""
    none = F.array().cast(SPAN)

    def closed(st: Column) -> Column:
        span = F.array(F.struct(st["start"].alias("start"), st["end"].alias("end"), (st["total"] + st["now"]).cast("string").alias("digits"))).cast(SPAN)
        return F.when(st["last"] != _NONE, F.concat(st["spans"], span)).otherwise(st["spans"])

    def step(st: Column, x: Column) -> Column:
        begin = st["at"] + F.length(x["gap"])
        end = begin + F.length(x["token"])
        word = F.lower(x["token"])
        kind, value = _of(word)
        last, now = st["last"], st["now"]
        hyphen = st["join"] == 2
        # what a word may follow: units follow tens, hundreds and scales; teens and tens only the latter two
        after_round = last.isin(_HUNDRED, _SCALE) & ~hyphen
        small = (kind == _UNIT) & (value > 0) & (((last == _TEN) & (st["join"] != 1)) | after_round)
        middle = kind.isin(_TEEN, _TEN) & after_round
        hundred = (kind == _HUNDRED) & last.isin(_UNIT, _TEEN, _TEN) & (now > 0) & (now < 100) & (st["join"] == 0)
        scale = (kind == _SCALE) & (last != _NONE) & (now > 0) & (st["join"] == 0) & ((st["scale"] == 0) | (value < st["scale"]))
        joins = (kind == _JOIN) & (st["join"] == 0) & (((word == "and") & last.isin(_HUNDRED, _SCALE)) | ((word == "-") & (last == _TEN) & (F.length(x["gap"]) == 0)))

        def state(spans: Column, start: Column, stop: Column, total: Column, now: Column, scale: Column, last: Column, join: Column) -> Column:
            return F.struct(end.alias("at"), spans.alias("spans"), start.alias("start"), stop.alias("end"), total.alias("total"), now.alias("now"), scale.alias("scale"), last.alias("last"), join.alias("join")).cast(_STATE)

        zero, nought = F.lit(0).cast("long"), F.lit(0)
        grown = state(st["spans"], st["start"], end, st["total"], now + value, st["scale"], kind, nought)
        times = state(st["spans"], st["start"], end, st["total"], now * 100, st["scale"], kind, nought)
        scaled = state(st["spans"], st["start"], end, st["total"] + now * value, zero, value, kind, nought)
        waits = state(st["spans"], st["start"], st["end"], st["total"], now, st["scale"], last, F.when(word == "and", 1).otherwise(2))
        fresh = state(closed(st), begin, end, F.when(kind == _SCALE, value).otherwise(zero), F.when(kind == _SCALE, zero).otherwise(value), F.when(kind == _SCALE, value).otherwise(zero), kind, nought)
        other = state(closed(st), begin, end, zero, zero, zero, F.lit(_NONE), nought)
        return F.when(small | middle, grown).when(hundred, times).when(scale, scaled).when(joins, waits).when(kind.between(_UNIT, _SCALE), fresh).otherwise(other)

    def folded(tokens: Column) -> Column:
        both = F.zip_with(F.slice(F.split(c, TOKEN, -1), 1, F.size(tokens)), tokens, lambda g, t: F.struct(g.alias("gap"), t.alias("token")))
        zero = F.lit(0).cast("long")
        start = F.struct(F.lit(0).alias("at"), none.alias("spans"), F.lit(0).alias("start"), F.lit(0).alias("end"), zero.alias("total"), zero.alias("now"), zero.alias("scale"), F.lit(_NONE).alias("last"), F.lit(0).alias("join")).cast(_STATE)
        return F.aggregate(both, start, step, closed)

    return F.when(c.rlike(ANY), X.let(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), folded)).otherwise(none)


def shadow(c: Column, found: Column) -> Column:
    """(text, map): the text with digits in the place of spelled-out numbers, and
    for each of them its place before (s, e) and after (s2, e2)."""
    kind = "struct<text:string,at:int,map:array<struct<s:int,e:int,s2:int,e2:int>>>"
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,s2:int,e2:int>>").alias("map")).cast(kind)

    def step(st: Column, x: Column) -> Column:
        text = F.concat(st["text"], F.substring(c, st["at"] + 1, x["start"] - st["at"]), x["digits"])
        s2 = F.length(text) - F.length(x["digits"])
        place = F.struct(x["start"].alias("s"), x["end"].alias("e"), s2.alias("s2"), F.length(text).alias("e2"))
        return F.struct(text.alias("text"), x["end"].alias("at"), F.concat(st["map"], F.array(place)).alias("map")).cast(kind)

    return F.aggregate(found, start, step, lambda st: F.struct(F.concat(st["text"], F.substr(c, st["at"] + 1)).alias("text"), st["map"].alias("map")))


def back(place: Column, spans: Column, is_end: bool) -> Column:
    """The place in the text before, for a place in the text with digits: inside
    a replaced number the number's own end (or start), else moved by what was replaced before."""
    inside = F.get(F.filter(spans, lambda m: (m["s2"] < place) & (place < m["e2"])), F.lit(0))
    moved = F.aggregate(F.filter(spans, lambda m: m["e2"] <= place), F.lit(0), lambda a, m: a + (m["e2"] - m["s2"]) - (m["e"] - m["s"]))
    return F.coalesce(inside["e" if is_end else "s"], place - moved)
