"""Extractive summaries under a character budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hints as H
from ..functions import text as X
from . import extract, pins
from . import selection as S
from .scoring import DECIMALS, default_scores, plain_scores, scored_documents

#: Fewer sentences, or a smaller budget, and a text is cut instead.
LEAST_SENTENCES, LEAST_BUDGET = 3, 50
MODES = ("default", "coverage", "legacy")
ATTACHMENTS = ("stats", "outline", "metadata", "phrases", "correlated_facts")


def _hint_pools(df: DataFrame, hints: list, focus: float, mode: str) -> DataFrame:
    """``chosen``: hint pool, plain pool, then what either left over."""
    hard = mode == "hard"

    def with_hints(x: Column) -> Column:
        extra = H.bonus(x["sentence"], hints)
        ok = x["eligible"] & (extra > 0) if hard else x["eligible"]
        return F.struct(x["sent_idx"].alias("sent_idx"), x["sentence"].alias("sentence"), F.round(x["score"] + extra, DECIMALS).alias("score"), ok.alias("eligible"))

    def used(chosen: str) -> Column:
        total = F.aggregate(chosen, F.lit(0), lambda a, i: a + F.length(F.get(F.col("scored"), i)["sentence"]))
        return total + F.greatest(F.size(chosen) - 1, F.lit(0))

    both = F.array_union("c_hint", "c_plain")
    df = df.withColumn("o_plain", S.ranked(F.col("scored"))).withColumn("o_hint", S.ranked(F.transform("scored", with_hints)))
    df = df.withColumn("b_hint", H.share_of(F.col("budget"), focus)).withColumn("b_plain", F.col("budget") - F.col("b_hint"))
    df = df.withColumn("c_hint", S.by_chars(F.col("o_hint"), F.col("b_hint")))
    df = df.withColumn("c_plain", S.by_chars(F.col("o_plain"), F.col("b_plain"), F.col("c_hint")))
    more = S.by_chars(F.col("o_hint" if hard else "o_plain"), F.col("b_hint") - used("c_hint"), both)
    df = df.withColumn("c_plain", F.concat("c_plain", more))
    if not hard:
        df = df.withColumn("c_hint", F.concat("c_hint", S.by_chars(F.col("o_hint"), F.col("b_plain") - used("c_plain"), both)))
    return df.withColumn("chosen", F.array_sort(both))


def _coverage(df: DataFrame) -> DataFrame:
    """``chosen``: the best sentence of each paragraph, then sentences of
    paragraphs not yet met.

    The k-th of equal sentences belongs to the k-th paragraph that contains it.
    """
    paras = F.transform(X.split_paragraphs("text"), lambda p, i: F.struct(i.alias("i"), p.alias("p")))
    same = lambda x: F.size(F.filter("s", lambda y: (y["sentence"] == x["sentence"]) & (y["sent_idx"] < x["sent_idx"])))
    para = lambda paras, x: F.get(F.filter(paras, lambda p: p["p"].contains(x["sentence"])), same(x))["i"]
    placed = lambda paras: F.transform("s", lambda x: F.struct(para(paras, x).alias("para"), (-x["composite"]).alias("by"), x["sent_idx"].alias("sent_idx"), (F.length(x["sentence"]) + 1).alias("cost"), x["heading"].alias("heading")))
    df = df.withColumn("placed", F.filter(X.let(paras, placed), lambda x: ~x["heading"] & x["para"].isNotNull()))
    # sorted by paragraph, score and place, the first of each paragraph is its best
    df = df.withColumn("placed", F.array_sort("placed"))
    df = df.withColumn("best", F.filter("placed", lambda x, i: F.coalesce(F.get(F.col("placed"), i - 1)["para"] != x["para"], F.lit(True))))
    state = "struct<used:int,chosen:array<int>,met:array<int>>"

    def step(st: Column, x: Column, open_only: bool) -> Column:
        fits = st["used"] + x["cost"] <= F.col("budget")
        if open_only:
            fits = fits & (st["used"] < F.col("budget"))
        return F.when(fits, F.struct((st["used"] + x["cost"]).alias("used"), F.concat(st["chosen"], F.array(x["sent_idx"])).alias("chosen"), F.concat(st["met"], F.array(x["para"])).alias("met")).cast(state)).otherwise(st)

    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("used"), none.alias("chosen"), none.alias("met")).cast(state)
    df = df.withColumn("first", F.aggregate("best", start, lambda st, x: step(st, x, False)))
    rest = F.array_sort(F.transform(F.filter("placed", lambda x: ~F.array_contains(F.col("first.met"), x["para"])), lambda x: F.struct(x["by"].alias("by"), x["sent_idx"].alias("sent_idx"), x["cost"].alias("cost"), x["para"].alias("para"))))
    df = df.withColumn("rest", rest)
    return df.withColumn("chosen", F.array_sort(F.aggregate("rest", F.col("first"), lambda st, x: step(st, x, True), lambda st: st["chosen"])))


def summarize(
    docs: DataFrame,
    max_length: int | Column = 500,
    *,
    mode: str = "default",
    attach: Sequence[str] = (),
    hints: H.Hints = None,
    hint_focus: float = 0.7,
    hint_mode: str = "soft",
    keep_headings: bool = False,
    include_toc: bool = False,
    pin: Sequence[str] | None = None,
    headings: Sequence[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, summary, pinned_headings) and a column for each attachment.

    ``max_length`` may be a column over ``docs``. Modes: ``default`` leaves
    headings out and prefers cue phrases, digits and telling sections;
    ``coverage`` takes from every paragraph first; ``legacy`` uses the plain
    composite and returns texts that fit unchanged. Hints split the budget
    between sentences that match and all others. Null texts count as empty.
    Arguments that do not go together raise ``ValueError`` before any work.
    """
    prepared = H.prepare(hints)
    weaving = keep_headings or include_toc or bool(pin) or bool(headings)
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode!r}")
    if mode == "legacy" and (prepared or weaving):
        raise ValueError("hints, headings, toc and pins are not supported in legacy mode")
    H.check(prepared, hint_focus, hint_mode)
    if unknown := set(attach) - set(ATTACHMENTS):
        raise ValueError(f"unknown attachments: {sorted(unknown)}")

    budget = F.lit(max_length) if isinstance(max_length, int) else max_length
    base = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"), budget.cast("int").alias("budget"))
    separate = bool(prepared) or mode == "default"
    df = scored_documents(base, id_col, "text", separate, carry=("budget",))
    n, text = F.size("s"), F.col("text")
    cut = X.truncate(text, F.col("budget"))
    if prepared or mode != "coverage":
        if mode == "default":
            scored = default_scores(F.col("s"))
        else:
            scored = plain_scores(F.col("s"), headings=mode == "legacy")
        df = df.withColumn("scored", scored)
        df = _hint_pools(df, prepared, hint_focus, hint_mode) if prepared else df.withColumn("chosen", S.by_chars(S.ranked(F.col("scored")), F.col("budget")))
        usable = (F.col("budget") >= LEAST_BUDGET) & (n >= LEAST_SENTENCES) & (F.size("chosen") > 0)
        short = F.when((F.col("budget") >= LEAST_BUDGET) & (n < LEAST_SENTENCES) & (F.length(text) <= F.col("budget")), text).otherwise(cut)
    else:
        df = _coverage(df)
        usable, short = n > 0, text
    df = df.withColumn("usable", usable & (text != "")).withColumn("plain", S.joined(F.col("s"), F.col("chosen")))
    summary = F.when(F.col("usable"), F.col("plain")).otherwise(short)
    if mode == "legacy":
        summary = F.when(F.length(text) <= F.col("budget"), text).otherwise(summary)
    df = df.withColumn("summary", F.when(text == "", F.lit("")).otherwise(summary))
    pinned = F.array().cast("array<string>")
    if weaving:
        toc = None
        if include_toc and headings:
            toc = pins.toc_of_given(headings)
        elif include_toc:
            if separate:  # the outline's own sentences and scores
                df = df.withColumn("_outline", extract.outline_of(F.col("s")))
            else:
                df = df.join(extract.outline(base, id_col, "text").select(F.col(id_col).alias("_of"), F.col("outline").alias("_outline")), F.col(id_col) == F.col("_of"), "left").drop("_of")
            toc = F.array_join(F.transform("_outline", lambda o: F.concat(F.repeat(F.lit("  "), o["depth"] - 1), o["name"])), "\n")
        body = F.col("summary")
        if keep_headings:
            woven = pins.given_headings(F.col("s"), F.col("chosen"), headings) if headings else pins.keep_headings(F.col("s"), F.col("chosen"))
            df = df.withColumn("woven", F.when(F.col("usable"), woven))
            body = F.coalesce("woven.body", body)
            pinned = F.coalesce("woven.pinned", pinned)
        df = df.withColumn("pinned_headings", pinned).withColumn("summary", pins.prepend(body, pin, toc) if pin or include_toc or keep_headings else body)
    else:
        df = df.withColumn("pinned_headings", pinned)
    out = df.select(id_col, "summary", "pinned_headings")
    for name in attach:
        out = out.join(extract.ATTACHED[name](base, id_col, "text"), id_col, "left")
    return out


def extract_keyword(docs: DataFrame, keywords: str, num_sentences: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, extract): the sentences that hold most of the query's words, best
    first, one per line. Keywords of one or two letters do not count; without
    keywords the extract is empty. A text without sentences is returned whole."""
    from ..functions import patterns as P

    wanted = sorted({w.lower() for w in keywords.split() if len(w) > 2})
    text = F.coalesce(F.col(text_col), F.lit(""))
    if not wanted:
        return docs.select(id_col, F.lit("").alias("extract"))

    def score(x: Column, i: Column) -> Column:
        low = F.lower(x)
        points = sum((F.when(low.contains(w), 1.0).otherwise(0.0) for w in wanted), F.lit(0.0))
        points = points + F.when(F.length(x) > 200, 0.5).otherwise(0.0) + F.when(x.rlike(r"(?U)\d"), 0.3).otherwise(0.0) + F.when(low.rlike(P.CAUSAL), 1.0).otherwise(0.0)
        return F.struct((-F.round(points, DECIMALS)).alias("by"), i.alias("i"), x.alias("t"))

    ranked = docs.select(id_col, text.alias("t"), X.split_lines_to_sentences(text).alias("s"))
    best = F.slice(F.array_sort(F.transform("s", score)), 1, num_sentences)
    return ranked.select(id_col, F.when(F.size("s") == 0, F.col("t")).otherwise(F.array_join(F.transform(best, lambda x: x["t"]), "\n")).alias("extract"))
