"""``python -m inkstone MODE --in PATH --out PATH``: one operator over a corpus.

MODE is a summary mode (default, also as summarize and tfidf; coverage, legacy),
keyword, textrank, clean_text (clean), strip_think (think), brief, report, or an
extraction: stats, outline, toc, metadata, phrases, key_facts (facts), top_terms,
correlate_facts, attributes, entities. ``--in`` takes Parquet with doc_id and
text, JSON lines (``*.jsonl``) or text files (``*.txt``); ``-`` is standard
input. Without ``--out`` all results are printed, one partition at a time.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sources
from .functions import text as X
from .operators import backends, enrich, extract, graph, report
from .operators.summarize import ATTACHMENTS, MODES, extract_keyword, summarize

EXTRACTIONS = {
    "stats": extract.stats, "outline": extract.outline, "toc": extract.toc, "metadata": extract.metadata, "phrases": extract.phrases, "key_facts": extract.key_facts,
    "top_terms": extract.top_terms, "correlate_facts": extract.correlate_facts, "attributes": extract.attributes, "entities": enrich.entities,
}


#: Other names of modes.
ALIASES = {"tfidf": "default", "summarize": "default", "facts": "key_facts", "clean_text": "clean", "strip_think": "think"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkstone", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("mode", choices=[*MODES, "keyword", "textrank", "clean", "think", "brief", "report", *EXTRACTIONS, *ALIASES])
    p.add_argument("--in", dest="source", default="-")
    p.add_argument("--out")
    p.add_argument("--max-length", "--max-chars", type=int, help="500; 2000 for reports")
    p.add_argument("--sentences", type=int, help="of keyword (10) and textrank (5)")
    p.add_argument("--max-facts", type=int, help="10; 40 for reports")
    p.add_argument("--top", type=int, default=10, help="terms of top_terms")
    p.add_argument("--kinds", action="append", default=[], help="words, phrases; top_terms takes both")
    p.add_argument("--scores", action="store_true", help="top_terms with kinds and scores")
    p.add_argument("--attach", action="append", default=[], help="results beside a summary; all of them: all")
    p.add_argument("--include-phrases", action="store_true", help="in brief")
    p.add_argument("--convert-word-names", action="store_true", help="spelled-out numbers count as numbers")
    p.add_argument("--keywords", default="")
    p.add_argument("--hint", action="append", default=[], help="TERM or TERM=WEIGHT, or several with commas; repeatable")
    p.add_argument("--hint-focus", type=float, default=0.7)
    p.add_argument("--hint-mode", default="soft", choices=["soft", "hard"])
    p.add_argument("--keep-headings", action="store_true")
    p.add_argument("--toc", action="store_true")
    p.add_argument("--pin", action="append", default=[])
    p.add_argument("--headings-file")
    p.add_argument("--backend")
    p.add_argument("--format", default="text", choices=report.FORMATS)
    return p


def listed(given: list[str]) -> list[str]:
    """The items of repeated, comma-separated arguments."""
    return [item.strip() for one in given for item in one.split(",") if item.strip()]


def hints(given: list[str]) -> dict[str, float] | None:
    pairs = (h.rpartition("=") if "=" in h else (h, "", "1") for h in listed(given))
    return {term: float(weight) for term, _, weight in pairs} or None


def read(spark: SparkSession, source: str) -> DataFrame:
    if source == "-":
        return sources.one_document(spark, sys.stdin.read())
    if source.endswith((".jsonl", ".json")):
        return sources.read_jsonl(spark, source)
    if source.endswith(".txt"):
        return sources.read_text_files(spark, source)
    return sources.read_table(spark, source)


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """(doc_id, result) as strings."""
    docs = read(spark, args.source)
    lean = {"hints": hints(args.hint), "hint_focus": args.hint_focus, "hint_mode": args.hint_mode}
    headings = sources.read_headings(spark, args.headings_file) if args.headings_file else None
    woven = {"keep_headings": args.keep_headings, "include_toc": args.toc, "pin": args.pin or None, "headings": headings}
    mode, name = ALIASES.get(args.mode, args.mode), "result"
    markdown = args.format == "markdown"
    words = {"convert_word_names": True} if args.convert_word_names else {}
    if mode in MODES:
        attach = listed(args.attach)
        out = summarize(docs, args.max_length or 500, mode=mode, attach=ATTACHMENTS if "all" in attach else attach, **lean, **woven)
        if args.format == "json":
            return out.select("doc_id", F.to_json(F.struct(*(c for c in out.columns if c != "doc_id"))).alias(name))
        if markdown or attach:
            return report.render_summary(out).withColumnRenamed("markdown", name)
        return out.select("doc_id", F.col("summary").alias(name))
    if mode == "keyword":
        return extract_keyword(docs, args.keywords, args.sentences or 10).withColumnRenamed("extract", name)
    if mode == "textrank":
        return graph.summarize_textrank(docs, args.sentences or 5).withColumnRenamed("summary", name)
    if mode in ("clean", "think"):
        return docs.select("doc_id", (X.clean_text if mode == "clean" else X.strip_think)("text").alias(name))
    if mode == "brief":
        return report.brief(docs, max_facts=args.max_facts or 10, include_phrases=args.include_phrases, output="markdown" if markdown else "string", **lean).withColumnRenamed("brief", name)
    if mode == "report":
        rows = report.report(docs, args.max_length or 2000, args.max_facts or 40, **lean, pin=args.pin or None, headings=headings)
        if args.format == "json":
            return rows.select("doc_id", F.to_json(F.struct(*(c for c in rows.columns if c != "doc_id"))).alias(name))
        return report.render_report(rows, "markdown" if markdown else "text").withColumnRenamed("report", name)
    how = dict(lean) if mode in ("phrases", "key_facts", "top_terms", "correlate_facts") else {}
    how |= words if mode in ("stats", "key_facts", "correlate_facts") else {}
    if mode == "phrases" and args.keywords:
        how["keywords"] = args.keywords
    if mode == "key_facts":
        how["max_facts"] = args.max_facts or 10
    if mode == "top_terms":
        how |= {"n": args.top, "kinds": listed(args.kinds) or ("words", "phrases")}
        if args.scores:
            rows = extract.term_scores(docs, **how)
            scored = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term", "kind", "score"))).alias("t"))
            return scored.select("doc_id", report.render_term_scores("t", "markdown" if markdown else "text").alias(name))
    found = (backends.resolve(args.backend, mode) if args.backend else EXTRACTIONS[mode])(docs, **how)
    column = next(c for c in found.columns if c != "doc_id")
    if mode in ("attributes", "entities"):
        return found.select("doc_id", F.to_json(column).alias(name))
    return found.select("doc_id", report.render(mode, column, args.format).alias(name))


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("inkstone").getOrCreate()
    out = run(spark, args)
    if args.out:
        out.write.parquet(args.out)
    else:
        for row in out.toLocalIterator():
            print(row["result"])


if __name__ == "__main__":
    main()
