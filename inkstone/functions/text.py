"""Preparing text: cleaning, sentences, paragraphs, headings, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

_NUL = "\x00"
# The characters that count as white space, as a set and as a pattern class.
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_S = r"[ \t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
STRINGS = "array<string>"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_ws(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(col(c), F.lit(SPACES))


def fold_ws(c: Column | str) -> Column:
    """Every run of white space one space, none at the ends."""
    return trim_ws(F.regexp_replace(col(c), f"{_S}+", " "))


def is_blank(c: Column) -> Column:
    return trim_ws(c) == ""


def strip_think(c: Column | str) -> Column:
    """Without ``<think>…</think>`` blocks and the white space after them; null is empty."""
    return trim_ws(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?sU)<think>.*?</think>\s*", ""))


def clean_text(c: Column | str) -> Column:
    """Markdown, filler and boilerplate removed, lower case, white space folded; null is empty."""
    steps = [
        (r"\*{1,3}", ""),
        (r"_{1,3}", ""),
        (r"(?mUd)^#{1,6}\s*", ""),
        (r"(?mUd)^-{3,}$", ""),
        # after an empty line the line before it was tried already, with the same end
        (r"(?mUd)(?<!\n\n)^\s*+[-*+]\s+", ""),
        (r"(?mUd)(?<!\n\n)^\s*+\d+\.\s+", ""),
        (rf"(?iU)\b(?:{P.FILLER_PHRASES})\b", ""),
        (rf"(?iU)\b(?:{P.FILLER_WORDS})\b", ""),
        *((f"(?iU){p}", "") for p in P.CRM_LINES),
    ]
    after = [(r"[ \t]+", " "), (r"(?U)\n\s*\n+", "\n"), (r"(?mUd)^\s+", ""), (r"(?mUd)\s+$", ""), (r"(?mUd)^\s*$\n?", "")]
    out = F.coalesce(col(c), F.lit(""))
    for pattern, to in steps:
        out = F.regexp_replace(out, pattern, to)
    out = F.lower(out)
    for pattern, to in after:
        out = F.regexp_replace(out, pattern, to)
    return trim_ws(out)


def _masked(c: Column) -> Column:
    """Periods that end no sentence become NUL: in numbers, after ``No`` before a
    number, and after a known abbreviation that is a whole dotted word."""
    short = "|".join("".join(rf"\." if ch == "." else f"[{ch.upper()}{ch}]" for ch in a) for a in P.ABBREVIATIONS)
    first = "".join(sorted({a[0].upper() + a[0] for a in P.ABBREVIATIONS}))
    out = F.translate(c, _NUL, "")
    out = F.regexp_replace(out, r"(\p{Nd})\.(\p{Nd})", f"$1{_NUL}$2")
    out = F.regexp_replace(out, rf"No(?<=(?U:\b)No)\.(?={_S}*\p{{Nd}})", f"No{_NUL}")
    # cheap tests first: an initial, then the word, and only then what stands before it
    return F.regexp_replace(out, rf"(?=[{first}])(?U:\b)(?=(?:{short})\.)(?<!(?U:\b)[A-Za-z]{{1,40}}\.)({short})\.(?![A-Za-z]+\.)", f"$1{_NUL}")


def split_sentences(c: Column | str) -> Column:
    """Sentences of a text in order; null and empty texts have none."""
    parts = F.split(_masked(F.coalesce(col(c), F.lit(""))), rf"(?<=[.!?]){_S}+(?=[A-Z])|\n{_S}*\n", -1)
    kept = F.filter(F.transform(parts, trim_ws), lambda s: s != "")
    return F.transform(kept, lambda s: F.translate(s, _NUL, "."))


def split_lines_to_sentences(c: Column | str) -> Column:
    """The splitter of keyword extraction: line ends count as periods, and what
    has 20 characters or fewer is left out."""
    parts = F.split(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\n+", ". "), rf"(?<=[.!?]){_S}+", -1)
    return F.filter(F.transform(parts, trim_ws), lambda s: F.length(s) > 20)


def split_paragraphs(c: Column | str, least: int = 20) -> Column:
    """Blank-line paragraphs of at least ``least`` characters."""
    parts = F.split(F.coalesce(col(c), F.lit("")), rf"\n{_S}*\n+", -1)
    return F.filter(F.transform(parts, trim_ws), lambda s: F.length(s) >= least)


# four runs of three letters; what lies between them is passed over without going back
_FOUR_WORDS = r"^(?:(?:[^A-Za-z]++|[A-Za-z]{1,2}+(?![A-Za-z]))*+[A-Za-z]{3,}+){4}"


def is_structural_heading(c: Column | str) -> Column:
    return col(c).rlike(f"(?Ud){P.HEADING}") & ~is_blank(col(c))


def is_heading(c: Column | str) -> Column:
    """A structural heading, or any text with fewer than four words of three letters."""
    return ~is_blank(col(c)) & (~col(c).rlike(_FOUR_WORDS) | col(c).rlike(f"(?Ud){P.HEADING}"))


def heading_depth(c: Column | str) -> Column:
    return F.greatest(F.length(F.regexp_extract(col(c), r"(?U)^\s*(#+)\s+", 1)), F.lit(1))


def heading_name(c: Column | str) -> Column:
    """A heading without its marks and what follows a dash; null when nothing is left."""
    out = trim_ws(c)
    for pattern in (r"(?U)^#+\s+", r"(?U)^\d+\.\s+", r"(?Ud)\s+[—–\-]\s+.*$", r":+$"):
        out = F.regexp_replace(out, pattern, "")
    return F.nullif(trim_ws(out), F.lit(""))


def separate_headings(c: Column | str) -> Column:
    """A blank line after each line that looks like a heading and is followed by text."""

    def spaced(lines: Column) -> Column:
        follows = lambda i: F.coalesce(trim_ws(F.get(lines, i + 1)) != "", F.lit(False))
        return F.array_join(F.transform(lines, lambda x, i: F.when(follows(i) & is_heading(x), F.concat(x, F.lit("\n"))).otherwise(x)), "\n")

    return let(F.split(F.coalesce(col(c), F.lit("")), "\n", -1), spaced)


def truncate(c: Column | str, most: Column | int) -> Column:
    """At most ``most`` characters, the last three of a longer text being periods."""
    most = F.lit(most) if isinstance(most, int) else most
    return F.when(F.length(col(c)) <= most, col(c)).otherwise(F.concat(F.substring(col(c), F.lit(1), F.greatest(most - 3, F.lit(0))), F.lit("...")))


def compact(c: Column | str, most: int = 260) -> Column:
    """One line of at most about ``most`` characters."""
    one = fold_ws(c)
    return F.when(F.length(one) <= most, one).otherwise(F.concat(F.regexp_replace(F.left(one, F.lit(most - 1)), r"(?U)\s+\z", ""), F.lit("...")))


def normalize_key(c: Column | str) -> Column:
    out = F.regexp_replace(F.replace(F.lower(trim_ws(c)), F.lit("&"), F.lit(" and ")), r"[^a-z0-9]+", "_")
    return F.regexp_replace(out, "^_+|_+$", "")


def normalize_value(c: Column | str) -> Column:
    return fold_ws(F.regexp_replace(F.lower(col(c)), r"[-_/]+", " "))


def tokens(c: Column | str) -> Column:
    """Whole words of three or more ASCII letters, lower case, without stopwords."""
    words = F.regexp_extract_all(F.lower(col(c)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(words, lambda w: w.rlike(r"^[a-z]{3,}$") & ~w.isin(P.STOPWORDS))


def letter_words(c: Column | str) -> Column:
    """Runs of three or more ASCII letters, lower case, wherever they stand."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z]{3,}"), F.lit(0))


def word_count(c: Column | str) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(col(c), f"{_S}+", -1), lambda w: w != ""))


def polarity(c: Column | str) -> Column:
    words = F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z]+"), F.lit(0))
    has = lambda these: F.arrays_overlap(words, F.array(*map(F.lit, these)))
    return F.when(has(P.GROWTH), "growth").when(has(P.DECLINE), "decline").otherwise("absolute")


def value_type(key: Column, value: Column) -> Column:
    low = F.lower(value)
    return (
        F.when(value.rlike(r"(?U)^\d{4}\z"), "year")
        .when(low.rlike(r"\$|usd|eur|gbp"), "money")
        .when(low.rlike(r"https?://|www\."), "url")
        .when(key.contains("citation") | low.rlike(r"(?U)\b\d+\s+u\.s\."), "citation")
        .when(key.contains("docket") | value.rlike(r"(?U)^\d{1,4}-\d+[A-Za-z]?\z"), "identifier")
        .when(value.contains(",") | value.contains(";"), "list")
        .otherwise("text")
    )
