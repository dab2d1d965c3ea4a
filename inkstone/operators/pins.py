"""Headings and pinned lines woven around a selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .scoring import sentences

LINES = "struct<out:array<string>,buf:array<string>,seen:array<int>,pinned:array<string>>"


def nearest_headings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sent_idx, heading_idx): the place of the last structural heading
    above each sentence; null for headings and before the first."""
    sents = sentences(docs, id_col, text_col, separate=True).withColumn("h", X.is_structural_heading("sentence"))
    last = F.last(F.when(F.col("h"), F.col("sent_idx")), ignorenulls=True).over(Window.partitionBy(id_col).orderBy("sent_idx"))
    return sents.select(id_col, "sent_idx", F.when(~F.col("h"), last).alias("heading_idx"))


def document_titles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, title): a first sentence that is a structural heading of depth one."""
    first = F.get(X.split_sentences(X.separate_headings(text_col)), F.lit(0))
    return docs.select(id_col, F.when(X.is_structural_heading(first) & (X.heading_depth(first) == 1), first).alias("title"))


def headings_of(s: Column) -> Column:
    """Places of the structural headings among sentences."""
    return F.transform(F.filter(s, lambda x: X.is_structural_heading(x["sentence"])), lambda x: x["sent_idx"])


def _flush(state: Column) -> Column:
    return F.when(F.size(state["buf"]) > 0, F.concat(state["out"], F.array(F.array_join(state["buf"], " ")))).otherwise(state["out"])


def weave(s: Column, chosen: Column, headings: Column, names: Column, start: Column, on_empty: Column | None) -> Column:
    """Lines of the chosen sentences, each run under its heading: ``headings``
    are the places in force, ``names`` their texts, ``start`` the state that
    stands above. Returns (body, pinned); without any pin the plain body where
    ``on_empty`` gives it."""

    def step(state: Column, i: Column, headings: Column, names: Column) -> Column:
        above = F.array_max(F.filter(headings, lambda h: h <= i))
        return X.let(above, lambda above: placed(state, i, above, headings, names))

    def placed(state: Column, i: Column, above: Column, headings: Column, names: Column) -> Column:
        new = above.isNotNull() & ~F.array_contains(state["seen"], above)
        name = F.get(names, F.array_position(headings, above).cast("int") - 1)
        text = F.get(s, i)["sentence"]
        return F.when(
            new,
            F.struct(
                F.concat(_flush(state), F.array(name)).alias("out"), F.array(text).alias("buf"),
                F.concat(state["seen"], F.array(above)).alias("seen"), F.concat(state["pinned"], F.array(name)).alias("pinned"),
            ).cast(LINES),
        ).otherwise(F.struct(state["out"].alias("out"), F.concat(state["buf"], F.array(text)).alias("buf"), state["seen"].alias("seen"), state["pinned"].alias("pinned")).cast(LINES))

    def fold(headings: Column, names: Column) -> Column:
        return F.aggregate(F.array_sort(chosen), start, lambda state, i: step(state, i, headings, names), finish)

    def finish(state: Column) -> Column:
        body = F.array_join(_flush(state), "\n")
        if on_empty is not None:
            body = F.when(F.size(state["pinned"]) > 0, body).otherwise(on_empty)
        return F.struct(body.alias("body"), state["pinned"].alias("pinned"))

    return X.let(headings, lambda headings: X.let(names, lambda names: fold(headings, names)))


def keep_headings(s: Column, chosen: Column) -> Column:
    """(body, pinned) with the document's own structural headings."""
    at = headings_of(s)
    first = F.get(s, F.lit(0))
    title = X.is_structural_heading(first["sentence"]) & (X.heading_depth(first["sentence"]) == 1)
    none, empty = F.array().cast("array<string>"), F.array().cast("array<int>")
    name = F.array(first["sentence"])
    start = F.when(title, F.struct(name.alias("out"), none.alias("buf"), F.array(F.lit(0)).alias("seen"), name.alias("pinned")).cast(LINES)).otherwise(
        F.struct(none.alias("out"), none.alias("buf"), empty.alias("seen"), none.alias("pinned")).cast(LINES)
    )
    plain = F.array_join(F.transform(F.array_sort(chosen), lambda i: F.get(s, i)["sentence"]), " ")
    return weave(s, chosen, at, F.transform(at, lambda h: F.get(s, h)["sentence"]), start, plain)


def given_headings(s: Column, chosen: Column, headings: Sequence[str]) -> Column:
    """(body, pinned) with the caller's headings: the first on top, then those
    that match no sentence, then each matched one above its sentences, and the
    rest at the end, so that all of them are there."""
    own = list(dict.fromkeys(headings))
    wanted = F.array(*map(F.lit, own)).cast("array<string>")
    # which sentence each heading claims: the first equal one not claimed before
    claim = F.aggregate(
        wanted,
        F.array().cast("array<int>"),
        lambda got, h: F.concat(got, F.array(F.coalesce(F.get(F.transform(F.filter(s, lambda x: (X.trim_ws(x["sentence"]) == X.trim_ws(h)) & ~F.array_contains(got, x["sent_idx"])), lambda x: x["sent_idx"]), F.lit(0)), F.lit(-1)))),
    )
    pairs = F.zip_with(claim, wanted, lambda i, h: F.struct(i.alias("at"), h.alias("name")))
    return X.let(pairs, lambda pairs: _given(s, chosen, pairs, wanted, len(own)))


def _given(s: Column, chosen: Column, pairs: Column, wanted: Column, n: int) -> Column:
    matched = F.array_sort(F.filter(pairs, lambda p: p["at"] >= 0))
    places, names = F.transform(matched, lambda p: p["at"]), F.transform(matched, lambda p: p["name"])
    rest = F.transform(F.filter(F.slice(pairs, 2, max(n - 1, 0)), lambda p: p["at"] < 0), lambda p: p["name"])
    head = F.concat(F.slice(wanted, 1, 1), rest)
    first = F.filter(F.transform(F.slice(pairs, 1, 1), lambda p: p["at"]), lambda i: i >= 0)
    start = F.struct(head.alias("out"), F.array().cast("array<string>").alias("buf"), first.alias("seen"), head.alias("pinned")).cast(LINES)

    def finished(woven: Column) -> Column:
        late = F.filter(wanted, lambda h: ~F.array_contains(woven["pinned"], h))
        body = F.array_join(F.concat(F.when(woven["body"] == "", F.array().cast("array<string>")).otherwise(F.array(woven["body"])), late), "\n")
        return F.struct(body.alias("body"), F.concat(woven["pinned"], late).alias("pinned"))

    return X.let(weave(s, chosen, places, names, start, None), finished)


def toc_of_given(headings: Sequence[str]) -> Column:
    return F.lit("\n".join(dict.fromkeys(headings)))


def prepend(body: Column, pin: Sequence[str] | None, toc: Column | None) -> Column:
    """Pinned lines, table of contents and body as blocks; empty ones are left out."""
    blocks = [F.lit("\n".join(pin or ())), F.coalesce(toc, F.lit("")) if toc is not None else F.lit(""), body]
    return F.array_join(F.filter(F.array(*blocks), lambda b: b != ""), "\n\n")
