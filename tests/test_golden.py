"""Golden cases: texts, arguments and the results that must come out, kept as
data in ``golden/cases.json``. Cases of equal arguments run as one DataFrame."""

from __future__ import annotations

import json
from pathlib import Path

import pytest

from inkstone.functions import text as X
from inkstone.operators import extract
from inkstone.operators.summarize import extract_keyword, summarize

GOLDEN = json.loads((Path(__file__).parent / "golden" / "cases.json").read_text(encoding="utf-8"))


def groups(suite):
    """Lists of the suite's cases with equal arguments, named by their first case."""
    found = {}
    for case in GOLDEN["cases"]:
        if case["suite"] == suite:
            found.setdefault(json.dumps(case["args"], sort_keys=True), []).append(case)
    return [pytest.param(of, id=of[0]["case"]) for of in found.values()]


def check(spark, cases, made):
    """``made`` takes the documents of all cases and gives one column, by the order of the cases."""
    docs = spark.createDataFrame([(i, GOLDEN["texts"][c["text"]]) for i, c in enumerate(cases)], "doc_id long, text string")
    got = {r[0]: r[1] for r in made(docs).collect()}
    for i, case in enumerate(cases):
        assert got[i] == case["expected"], case["case"]


@pytest.mark.parametrize("cases", groups("modes"))
def test_modes(spark, cases):
    config = cases[0]["args"]
    params = config.get("params", {})
    made = {
        "clean_text": lambda docs: docs.select("doc_id", X.clean_text("text")),
        "strip_think": lambda docs: docs.select("doc_id", X.strip_think("text")),
        "keyword": lambda docs: extract_keyword(docs, params["keywords"], params.get("num_sentences", 10)).select("doc_id", "extract"),
        "tfidf": lambda docs: summarize(docs, params.get("max_length", 500), mode=params.get("scorer_mode", "legacy")).select("doc_id", "summary"),
    }
    check(spark, cases, made[config["mode"]])


@pytest.mark.parametrize("cases", groups("summaries"))
def test_hints_pins_and_headings(spark, cases):
    args = {k: v for k, v in cases[0]["args"].items() if v is not None}
    length = args.pop("max_length", 500)
    check(spark, cases, lambda docs: summarize(docs, length, **args).select("doc_id", "summary"))


LINES = {
    "stats": (extract.stats, lambda x: f"{x.stat_type} | {x.value} | {x.unit} | {x.phrase} | {x.context_sentence}"),
    "outline": (extract.outline, lambda x: f"{x.depth} | {x.name} | {x.representative_sentence}"),
    "correlate_facts": (extract.correlate_facts, lambda x: f"{x.entity} | {x.number} | {x.polarity} | {x.sentence}"),
    **{name: (f, str) for name, f in (("toc", extract.toc), ("phrases", extract.phrases), ("top_terms", extract.top_terms), ("key_facts", extract.key_facts))},
}


@pytest.mark.parametrize("cases", groups("facts"))
def test_facts(spark, cases):
    kind = cases[0]["args"]["kind"]
    docs = spark.createDataFrame([(i, GOLDEN["texts"][c["text"]]) for i, c in enumerate(cases)], "doc_id long, text string")
    if kind == "metadata":
        for r in extract.metadata(docs).collect():
            m = r.metadata
            got = [f"{name.upper()}: {', '.join(m[name])}".rstrip() for name in ("dates", "amounts", "urls", "entities")]
            assert got == [line.rstrip() for line in cases[r.doc_id]["expected"].splitlines()], cases[r.doc_id]["case"]
        return
    made, line = LINES[kind]
    for r in made(docs).collect():
        assert "".join(f"{line(x)}\n" for x in r[1]) == cases[r.doc_id]["expected"], cases[r.doc_id]["case"]
