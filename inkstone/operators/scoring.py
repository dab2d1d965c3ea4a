"""Sentence scores.

All scoring of a document comes out of its own row: sentences, their tokens,
term and sentence frequencies are arrays, counted as runs of sorted ones.
Nothing is dealt out, and what several elements look up is bound by ``let``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions import rows as W
from ..functions import runs as R
from ..functions import text as X

#: Decimals at which scores are compared, so that the order in which a
#: distributed sum adds does not decide between equal sentences.
DECIMALS = 10


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separate: bool = False) -> DataFrame:
    """(id, sent_idx, sentence); ``separate`` first sets headings apart."""
    source = X.separate_headings(text_col) if separate else F.col(text_col)
    return W.numbered(docs, [id_col], X.split_sentences(source), "sent_idx", "sentence")


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separate: bool = False) -> DataFrame:
    """(id, sent_idx, pos, term)."""
    return sentences(docs, id_col, text_col, separate).select(id_col, "sent_idx", F.posexplode(X.tokens("sentence")).alias("pos", "term"))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20) -> DataFrame:
    """(id, para_idx, paragraph)."""
    return docs.select(id_col, F.posexplode(X.split_paragraphs(text_col, least)).alias("para_idx", "paragraph"))


def runs(ordered: Column, value, body) -> Column:
    """``body`` of each run of equal values of a sorted array. Elements are taken by
    their places: a slice would copy the whole array for each run."""

    def of(a: Column) -> Column:
        end = lambda starts, j: F.coalesce(F.get(starts, j + 1), F.size(a))
        return X.let(R.starts(a, value), lambda starts: F.transform(starts, lambda i, j: X.let(F.transform(F.sequence(i, end(starts, j) - 1), lambda k: F.get(a, k)), body)))

    return X.let(ordered, of)


def term_runs(toks: Column, body) -> Column:
    """``body`` of each distinct term of a document, given (v, i) for each time it
    occurs and its weight; ``toks`` has the terms of each sentence."""
    every = F.sort_array(F.flatten(F.transform(toks, lambda t, i: F.transform(t, lambda w: F.struct(w.alias("v"), i.alias("i"))))))
    weight = lambda p: F.ln((F.size(toks) + 1) / (F.size(F.array_distinct(F.transform(p, lambda x: x["i"]))) + 1)) + 1
    return runs(every, lambda x: x["v"], lambda p: X.let(weight(p), lambda w: body(p, w)))


def _raws(toks: Column) -> Column:
    """(sent_idx, raw) in order: mean weight of a sentence's terms in its document."""
    weights = F.flatten(term_runs(toks, lambda p, w: F.transform(p, lambda x: F.struct(x["i"].alias("i"), w.alias("w")))))
    mean = lambda p: F.aggregate(p, F.lit(0.0), lambda s, x: s + x["w"]) / F.size(p)
    return runs(F.sort_array(weights), lambda x: x["i"], lambda p: F.struct(F.get(p, F.lit(0))["i"].alias("sent_idx"), mean(p).alias("raw")))


def _sentences(text: Column, separate: bool) -> Column:
    return X.split_sentences(X.separate_headings(text) if separate else text)


def _scored(sents: Column, body) -> Column:
    """``body`` of a document's sentences, the mean weight of each one's terms (zero
    without terms), and the largest of these."""

    def of(s: Column) -> Column:
        dense = X.let(F.transform(s, X.tokens), lambda toks: X.let(_raws(toks), lambda raws: _dense(raws, F.size(s))))
        return X.let(dense, lambda d: X.let(F.coalesce(F.array_max(d), F.lit(0.0)), lambda top: body(s, d, top)))

    return X.let(sents, of)


def tfidf_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separate: bool = False) -> DataFrame:
    """(id, sent_idx, tfidf): mean term weight, divided by the document's largest."""
    shares = lambda s, d, top: F.transform(d, lambda raw: F.when(top > 0, raw / top).otherwise(0.0))
    rows = docs.select(id_col, _scored(_sentences(F.col(text_col), separate), shares).alias("s"))
    return W.numbered(rows, [id_col], "s", "sent_idx", "tfidf")


def position(i: Column, n: Column) -> Column:
    """1 at both ends of a document, 0 in its middle."""
    away = F.least(i, n - 1 - i) / F.greatest(n - 1, F.lit(1))
    return F.greatest(F.lit(0.0), 1 - 2 * away)


def length_raw(words: Column) -> Column:
    """1 from 10 to 30 words, less for shorter and longer sentences."""
    return F.when(words < 10, words / 10.0).when(words <= 30, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (words - 30) / 50.0))


def scored_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separate: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, text, the columns in ``carry``, and ``s``, its sentences in order with
    sent_idx, sentence, tfidf, position, length, composite (0.60, 0.25 and 0.15
    of these), words and heading. Documents without sentences have an empty ``s``."""
    measure = lambda t, i: X.let(X.word_count(t), lambda w: F.struct(i.alias("sent_idx"), t.alias("sentence"), w.alias("words"), length_raw(w).alias("long"), X.is_heading(t).alias("heading")))

    def finished(m: Column, dense: Column, top: Column, top_long: Column) -> Column:
        def final(x: Column, raw: Column) -> Column:
            t = F.when(top > 0, raw / top).otherwise(0.0)
            q = F.when(top_long > 0, x["long"] / top_long).otherwise(0.0)
            p = position(x["sent_idx"], F.size(m))

            def full(v: Column) -> Column:
                composite = F.round(0.60 * v["t"] + 0.25 * v["p"] + 0.15 * v["q"], DECIMALS)
                return F.struct(x["sent_idx"].alias("sent_idx"), x["sentence"].alias("sentence"), v["t"].alias("tfidf"), v["p"].alias("position"), v["q"].alias("length"), composite.alias("composite"), x["words"].alias("words"), x["heading"].alias("heading"))

            return X.let(F.struct(t.alias("t"), p.alias("p"), q.alias("q")), full)

        return F.zip_with(m, dense, final)

    def of(s: Column, dense: Column, top: Column) -> Column:
        longest = lambda m: F.array_max(F.transform(m, lambda x: x["long"]))
        return X.let(F.transform(s, measure), lambda m: X.let(longest(m), lambda top_long: finished(m, dense, top, top_long)))

    text = F.col(text_col)
    return docs.select(id_col, text.alias("text"), *carry, _scored(_sentences(text, separate), of).alias("s"))


def _dense(raws: Column, n: Column) -> Column:
    """Scores of the places 0 to ``n`` - 1 from (sent_idx, raw) in order: runs
    of zeros are put in where places are missing."""
    zeros = lambda k: F.array_repeat(F.lit(0.0), k)
    parts = F.transform(raws, lambda x, i: F.concat(zeros(x["sent_idx"] - F.coalesce(F.get(raws, i - 1)["sent_idx"], F.lit(-1)) - 1), F.array(x["raw"])))
    last = F.coalesce(F.get(raws, F.size(raws) - 1)["sent_idx"], F.lit(-1))
    return F.concat(F.flatten(parts), zeros(n - last - 1))


def sections(s: Column) -> Column:
    """For each sentence the lower-case name of the last heading, its own
    included; empty before the first."""
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("all"))

    def step(state: Column, x: Column) -> Column:
        now = F.when(x["heading"], F.coalesce(F.lower(X.heading_name(x["sentence"])), F.lit(""))).otherwise(state["now"])
        return F.struct(now.alias("now"), F.concat(state["all"], F.array(now)).alias("all"))

    return F.aggregate(s, start, step, lambda st: st["all"])


def section_map(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sent_idx, section): the last heading's lower-case name, carried
    forward by a window over the document."""
    sents = sentences(docs, id_col, text_col, separate=True).withColumn("h", X.is_heading("sentence"))
    name = F.when(F.col("h"), F.coalesce(F.lower(X.heading_name("sentence")), F.lit("")))
    last = F.last(name, ignorenulls=True).over(Window.partitionBy(id_col).orderBy("sent_idx"))
    return sents.select(id_col, "sent_idx", F.coalesce(last, F.lit("")).alias("section"))


def default_scores(s: Column) -> Column:
    """(sent_idx, sentence, score, eligible) of each sentence: sentences of
    boosted sections count their terms 1.3 times, cue phrases add 2.0, digits
    0.3, and headings are not eligible."""

    def final(x: Column, section: Column) -> Column:
        t = x["tfidf"] * F.when(section.isin(P.BOOSTED_SECTIONS), 1.3).otherwise(1.0)
        score = 0.60 * t + 0.25 * x["position"] + 0.15 * x["length"]
        score = score + F.when(x["sentence"].rlike(f"(?iU){P.CUE}"), 2.0).otherwise(0.0) + F.when(x["sentence"].rlike(r"(?U)\d"), 0.3).otherwise(0.0)
        return F.struct(x["sent_idx"].alias("sent_idx"), x["sentence"].alias("sentence"), F.round(score, DECIMALS).alias("score"), (~x["heading"]).alias("eligible"))

    return F.zip_with(s, sections(s), final)


def plain_scores(s: Column, headings: bool) -> Column:
    """The same with the composite alone; headings are eligible only where asked."""
    return F.transform(
        s, lambda x: F.struct(x["sent_idx"].alias("sent_idx"), x["sentence"].alias("sentence"), x["composite"].alias("score"), (F.lit(headings) | ~x["heading"]).alias("eligible"))
    )
