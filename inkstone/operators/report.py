"""Briefs, reports and their rendering as text, Markdown and JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hints as H
from ..functions import text as X
from . import extract
from .summarize import summarize

#: Overview of a brief: share of a text, and characters.
SHARES, CHARS = (0.05, 0.50), (250, 1500)
#: Detail records of a report.
RECORDS = 12

FORMATS = ("text", "markdown", "json")


def _lines(rows: Column, item) -> Column:
    return F.transform(rows, item)


def _block(*parts: Column | str) -> Column:
    """Lines of a block as an array."""
    return F.array(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _when_any(rows: Column, lines: Column) -> Column:
    return F.when(F.size(rows) > 0, lines).otherwise(F.array().cast("array<string>"))


def _rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)(?<!\s)\s++\z", "")


def bullets(title: str, rows: Column) -> Column:
    """A Markdown section of bullet rows."""
    full = F.array_join(F.concat(_block(f"## {title}", ""), _lines(rows, lambda r: F.concat(F.lit("- "), r))), "\n")
    return F.when(F.size(rows) > 0, full).otherwise(F.lit(f"## {title}\n"))


def _by_sentence(rows: Column, fact) -> Column:
    """Facts grouped under their sentences, by first appearance."""
    return F.transform(
        F.array_distinct(F.transform(rows, lambda r: r["sentence"])),
        lambda s: F.struct(s.alias("sentence"), F.transform(F.filter(rows, lambda r: r["sentence"] == s), fact).alias("facts")),
    )


def render(kind: str, value: Column | str, output: str = "text") -> Column:
    """One extraction result as a string column."""
    v = X.col(value)
    if output not in FORMATS:
        raise ValueError(f"output must be one of {FORMATS}; got {output!r}")
    if output == "json":
        return F.to_json(v, {"pretty": "true", "ignoreNullFields": "false"})
    text = output == "text"
    tab = lambda *cols: F.concat_ws("\t", *cols)
    if kind == "stats":
        if text:
            return F.array_join(_lines(v, lambda s: tab(s["stat_type"], s["value"], s["unit"], s["context_sentence"])), "\n")
        row = lambda s: F.concat(F.lit("| "), F.concat_ws(" | ", s["stat_type"], s["value"], s["unit"], s["context_sentence"]), F.lit(" |"))
        table = F.array_join(F.concat(_block("## Stats", "", "| Type | Value | Unit | Context |", "|---|---|---|---|"), _lines(v, row)), "\n")
        return F.when(F.size(v) > 0, table).otherwise(F.lit("## Stats\n"))
    if kind == "metadata":
        parts = []
        for label, name in (("Dates", "dates"), ("Amounts", "amounts"), ("URLs", "urls"), ("Entities", "entities")):
            head = _block(f"{label}:") if text else _block("", f"### {label}", "")
            mark = "  - " if text else "- "
            parts.append(_when_any(v[name], F.concat(head, F.transform(v[name], _prefixer(mark)))))
        return F.array_join(F.concat(*([] if text else [_block("## Metadata")]), *parts), "\n")
    if kind == "outline":
        indent = lambda o: F.repeat(F.lit("  "), F.greatest(o["depth"] - 1, F.lit(0)))
        if text:
            return F.array_join(_lines(v, lambda o: F.concat(indent(o), F.lit("- "), o["name"], F.lit(": "), o["representative_sentence"])), "\n")
        item = lambda o: F.concat(indent(o), F.lit("- **"), o["name"], F.lit("**: "), o["representative_sentence"])
        return F.array_join(F.concat(_block("## Outline", ""), _lines(v, item)), "\n")
    if kind == "correlate_facts":
        if text:
            groups = _by_sentence(v, lambda r: tab(r["entity"], r["number"], r["polarity"]))
            each = lambda g: F.array_join(F.concat(F.array(g["sentence"]), F.transform(g["facts"], lambda f: F.concat(F.lit("  "), f))), "\n")
            return _rstrip(F.array_join(F.transform(groups, each), "\n\n"))
        tick = F.lit("`")
        groups = _by_sentence(v, lambda r: F.concat(tick, r["entity"], F.lit("` -> `"), r["number"], F.lit("` ("), r["polarity"], F.lit(")")))
        each = lambda g: F.array_join(F.concat(F.array(F.lit(""), F.concat(F.lit("- "), g["sentence"])), F.transform(g["facts"], lambda f: F.concat(F.lit("  - "), f))), "\n")
        full = F.array_join(F.concat(_block("## Correlated Facts"), F.transform(groups, each)), "\n")
        return F.when(F.size(v) > 0, full).otherwise(F.lit("## Correlated Facts\n"))
    titles = {"facts": "Key Facts", "key_facts": "Key Facts", "toc": "Table of Contents", "phrases": "Phrases", "top_terms": "Top Terms"}
    if kind not in titles:
        raise ValueError(f"unknown extraction kind: {kind!r}")
    return F.array_join(v, "\n") if text else bullets(titles[kind], v)


def _prefixer(mark: str):
    return lambda x: F.concat(F.lit(mark), x)


def render_term_scores(terms: Column | str, output: str = "text") -> Column:
    """(term, kind, score) structs: six significant digits in text, three decimals in Markdown."""
    v = X.col(terms)
    if output == "text":
        digits = lambda s: F.regexp_replace(F.regexp_replace(F.format_string("%.6g", s), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        return F.array_join(F.transform(v, lambda t: F.concat_ws("\t", t["term"], t["kind"], digits(t["score"]))), "\n")
    row = lambda t: F.concat(F.lit("`"), t["term"], F.lit("` ("), t["kind"], F.lit(", "), F.format_string("%.3f", t["score"]), F.lit(")"))
    return bullets("Top Terms", F.transform(v, row))


def _with(df: DataFrame, more: DataFrame, id_col: str) -> DataFrame:
    return df.join(more, id_col, "left")


def brief(
    docs: DataFrame, *, overview_max: float = 0.35, max_facts: int = 10, include_phrases: bool = False, output: str = "string",
    hints: H.Hints = None, hint_focus: float = 0.7, hint_mode: str = "soft", id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, brief): overview, key facts, table of contents and, where asked,
    phrases. ``output`` is string, markdown, or dict (a struct). The overview's
    budget follows each text's length."""
    if output not in ("string", "markdown", "dict"):
        raise ValueError(f"output must be 'string', 'markdown', or 'dict'; got {output!r}")
    share = max(SHARES[0], min(SHARES[1], overview_max))
    text = F.coalesce(F.col(text_col), F.lit(""))
    budget = F.least(F.greatest(F.floor(F.length(text) * share), F.lit(CHARS[0])), F.lit(CHARS[1])).cast("int")
    how = {"hints": hints, "hint_focus": hint_focus, "hint_mode": hint_mode, "id_col": id_col, "text_col": text_col}
    df = summarize(docs, budget, **how).select(id_col, _rstrip(F.col("summary")).alias("overview"))
    df = _with(df, extract.key_facts(docs, max_facts, **how), id_col)
    df = _with(df, extract.toc(docs, id_col, text_col), id_col)
    df = _with(df, extract.phrases(docs, **how), id_col) if include_phrases else df.withColumn("phrases", F.lit(None).cast("array<string>"))
    if output == "dict":
        return df.select(id_col, F.struct("overview", "key_facts", "toc", "phrases").alias("brief"))
    shown = F.coalesce("phrases", F.array().cast("array<string>"))
    if output == "markdown":
        part = lambda title, rows: _when_any(rows, F.concat(_block(f"\n## {title}\n"), F.transform(rows, _prefixer("- ")), _block("")))
        lines = F.concat(F.array(F.lit("## Overview\n"), F.col("overview"), F.lit("")), part("Key facts", F.col("key_facts")), part("Also in this doc", F.col("toc")), _when_any(shown, F.array(F.lit("\n## Key phrases\n"), F.array_join(shown, "  ·  "), F.lit(""))))
        return df.select(id_col, F.array_join(lines, "\n").alias("brief"))
    part = lambda title, rows: _when_any(rows, F.concat(_block(f"{title}:"), F.transform(rows, _prefixer("  - ")), _block("")))
    lines = F.concat(F.array(F.lit("Overview:"), F.col("overview"), F.lit("")), part("Key facts", F.col("key_facts")), part("Also in this doc", F.col("toc")), _when_any(shown, F.array(F.lit("Key phrases:"), F.concat(F.lit("  "), F.array_join(shown, ", ")), F.lit(""))))
    return df.select(id_col, F.concat(_rstrip(F.array_join(lines, "\n")), F.lit("\n")).alias("brief"))


def report(
    docs: DataFrame, max_length: int = 2000, max_facts: int = 40, *, mode: str = "default", include_toc: bool = True, keep_headings: bool = True,
    headings: Sequence[str] | None = None, pin: Sequence[str] | None = None, hints: H.Hints = None, hint_focus: float = 0.7, hint_mode: str = "soft",
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: summary, pinned_headings, key_facts, stats,
    metadata, attributes, fact_records, promotions and search_text."""
    how = {"hints": hints, "hint_focus": hint_focus, "hint_mode": hint_mode, "id_col": id_col, "text_col": text_col}
    df = summarize(docs, max_length, mode=mode, include_toc=include_toc, keep_headings=keep_headings, headings=headings, pin=pin, **how)
    df = _with(df, extract.key_facts(docs, max_facts, **how), id_col)
    df = _with(df, extract.details(docs, id_col, text_col), id_col)
    pairs = F.transform("attributes", lambda a: F.concat(a["label"], F.lit(": "), a["value"]))
    found = F.concat(F.array("summary"), F.col("key_facts"), pairs, F.col("metadata.dates"), F.col("metadata.amounts"), F.col("metadata.urls"))
    return df.withColumn("search_text", F.array_join(F.filter(found, lambda x: x != ""), "\n"))


def compact_records(records: Column, attributes: Column, most: int = RECORDS) -> Column:
    """Records for people: no attributes, no number that an attribute of the
    same name states, each once, ``most`` at most."""
    keys = F.transform(attributes, lambda a: a["key"])
    kept = F.filter(records, lambda r: (r["fact_type"] != "attribute") & ~((r["fact_type"] == "numeric") & F.array_contains(keys, r["predicate"]) & (r["object"] != "")))
    row = F.transform(kept, lambda r: F.struct(r["subject"].alias("subject"), r["predicate"].alias("predicate"), r["object"].alias("object"), r["fact_type"].alias("fact_type")))
    return F.slice(F.array_distinct(row), 1, most)


def render_report(df: DataFrame, output: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, report): the rows of ``report`` as text or Markdown."""
    text = output == "text"
    if output not in ("text", "markdown"):
        raise ValueError(f"output must be 'text' or 'markdown'; got {output!r}")
    head = lambda plain, mark: _block("", plain) if text else _block("", f"### {mark}", "")
    unit = lambda s: F.when((s["unit"] != "") & (s["unit"] != s["stat_type"]), F.concat(F.lit(" "), s["unit"])).otherwise("")
    stat = lambda s: F.concat(F.lit("- "), s["stat_type"], F.lit(": "), s["value"], unit(s), F.lit(" - "), X.compact(s["context_sentence"], 140))
    meta = []
    for label, name in (("Dates", "dates"), ("Amounts", "amounts"), ("URLs", "urls")):
        mark = f"  {label}: " if text else f"- **{label}:** "
        meta.append(_when_any(F.col(f"metadata.{name}"), F.array(F.concat(F.lit(mark), F.array_join(F.col(f"metadata.{name}"), ", ")))))
    meta = F.concat(*meta)
    sure = lambda a: F.format_string("%.2f", a["confidence"])
    if text:
        attribute = lambda a: F.concat(F.lit("- "), a["key"], F.lit(": "), a["value"], F.lit(" ("), F.concat_ws(", ", a["value_type"], a["source"], sure(a)), F.lit(")"))
        record = lambda r: F.concat(F.lit("- "), r["subject"], F.lit(": "), r["predicate"], F.lit(" = "), r["object"], F.lit(" ("), r["fact_type"], F.lit(")"))
        start = F.array(F.lit("Summary"), F.lit("======="), _rstrip(F.col("summary")), F.lit(""), F.lit("Facts and Important Details"), F.lit("==========================="))
    else:
        attribute = lambda a: F.concat(F.lit("- **"), a["key"], F.lit(":** "), a["value"], F.lit(" ("), F.concat_ws(", ", a["value_type"], a["source"], F.concat(F.lit("confidence "), sure(a))), F.lit(")"))
        record = lambda r: F.concat(F.lit("- **"), r["subject"], F.lit(":** "), r["predicate"], F.lit(" = "), r["object"], F.lit(" ("), r["fact_type"], F.lit(")"))
        start = F.array(F.lit("## Summary"), F.lit(""), _rstrip(F.col("summary")), F.lit(""), F.lit("## Facts and Important Details"))
    records = compact_records(F.col("fact_records"), F.col("attributes"))
    lines = F.concat(
        start,
        _when_any(F.col("key_facts"), F.concat(head("Key facts:", "Key Facts"), F.transform("key_facts", lambda f: F.concat(F.lit("- "), X.compact(f, 360))))),
        _when_any(F.col("stats"), F.concat(head("Numeric/date facts:", "Numeric/Date Facts"), F.transform("stats", stat))),
        _when_any(meta, F.concat(head("Metadata:", "Metadata"), meta)),
        _when_any(F.col("attributes"), F.concat(head("Structured metadata candidates:", "Structured Metadata Candidates"), F.transform("attributes", attribute))),
        _when_any(records, F.concat(head("Important detail records:", "Important Detail Records"), F.transform(records, record))),
    )
    return df.select(id_col, _rstrip(F.array_join(lines, "\n")).alias("report"))


def render_summary(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, markdown): rows of ``summarize`` with whatever is attached; empty
    attachments are left out."""
    parts = [F.concat(F.lit("## Summary\n\n"), _rstrip(F.col("summary")))]
    for name, kind in (("stats", "stats"), ("outline", "outline"), ("metadata", "metadata"), ("phrases", "phrases"), ("correlated_facts", "correlate_facts")):
        if name in df.columns:
            some = F.col(name).isNotNull() if name == "metadata" else F.size(name) > 0
            parts.append(F.when(some, render(kind, name, "markdown")))
    return df.select(id_col, F.concat_ws("\n\n", *parts).alias("markdown"))
