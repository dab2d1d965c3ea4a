"""Operators on small corpora, edge cases, and the plans they make."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkstone.functions import patterns as P
from inkstone.functions import text as X
from inkstone.operators import backends, enrich, evals, extract, graph, report, scoring
from inkstone.operators.summarize import extract_keyword, summarize

SCHEMA = "doc_id long, text string"
STORY = (
    "# Title\n\n## Results\nRevenue grew 5 percent to $12.5 million in 2021. The network team shipped 300 units in 5 days. The network team met twice.\n\n"
    "Costs: fell\n\nHeld: the network team wins. It ends here with quite a few more words than needed for one sentence."
)


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), SCHEMA)


EDGES = [None, "", " \n ", "One.", "Short one. Two here.", "x" * 2_000, "A. " * 400, STORY, STORY + "\n\n" + STORY, "é ñ 日本 😀. Ünd so. Weiter geht es hier."]

ALL = {
    "stats": extract.stats, "metadata": extract.metadata, "outline": extract.outline, "toc": extract.toc, "key_facts": extract.key_facts, "phrases": extract.phrases, "top_terms": extract.top_terms,
    "correlate_facts": extract.correlate_facts, "attributes": extract.attributes, "fact_records": extract.fact_records, "entities": enrich.entities, "summary": summarize, "legacy": lambda d: summarize(d, mode="legacy"),
    "coverage": lambda d: summarize(d, mode="coverage"), "hints": lambda d: summarize(d, hints=["network"]), "pins": lambda d: summarize(d, keep_headings=True, include_toc=True, pin=["p"]),
    "given": lambda d: summarize(d, keep_headings=True, headings=["## Results", "Other"]), "brief": report.brief, "report": report.report, "textrank": graph.summarize_textrank, "keyword": lambda d: extract_keyword(d, "network team"),
}


@pytest.mark.parametrize("name", ALL)
def test_one_row_for_each_document(spark, name):
    got = ALL[name](docs(spark, *EDGES)).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(EDGES)))
    assert all(x is not None for r in got for x in r)
    assert ALL[name](docs(spark, *EDGES).limit(0)).collect() == []


def test_results_do_not_depend_on_partitions(spark):
    d = docs(spark, *EDGES)
    for name in ("summary", "key_facts", "phrases", "top_terms", "correlate_facts", "outline"):
        assert sorted(map(str, ALL[name](d.repartition(7)).collect())) == sorted(map(str, ALL[name](d.coalesce(1)).collect()))


def test_story(spark):
    d = docs(spark, STORY)
    kinds = sorted((s.stat_type, s.value, s.unit) for s in extract.stats(d).first().stats)
    assert kinds == [("count", "300", "units"), ("date", "2021", "date"), ("duration", "5 days", "day"), ("money", "$12.5 million", "usd"), ("percent", "5", "percent")]
    assert "Results" in extract.toc(d).first().toc
    assert "network team" in extract.phrases(d).first().phrases
    summary = summarize(d, 120).first().summary
    assert 0 < len(summary) <= 120 and all(part in STORY for part in summary.split(". "))
    assert summarize(d, 30).first().summary == STORY[:27] + "..."


def test_summary_arguments(spark):
    d = docs(spark, STORY)
    for bad in ({"mode": "odd"}, {"mode": "legacy", "hints": ["x"]}, {"mode": "legacy", "pin": ["x"]}, {"attach": ["odd"]}, {"hints": ["x"], "hint_focus": 3.0}, {"hints": ["x"], "hint_mode": "odd"}):
        with pytest.raises(ValueError):
            summarize(d, **bad)
    got = summarize(d, attach=["stats", "metadata", "outline", "phrases", "correlated_facts"])
    assert got.columns == ["doc_id", "summary", "pinned_headings", "stats", "metadata", "outline", "phrases", "correlated_facts"]
    by_row = summarize(d.withColumn("m", F.lit(60)), F.col("m")).first().summary
    assert len(by_row) <= 60


def test_extra_columns_with_clashing_names(spark):
    d = docs(spark, STORY).withColumns({c: F.lit(1) for c in ("s", "sents", "chosen", "budget", "n", "stats", "summary", "_of")})
    for name in ("summary", "stats", "key_facts", "phrases", "outline", "entities"):
        assert len(ALL[name](d).collect()) == 1


def test_entities(spark):
    d = docs(spark, "Dr. Mary Smith met Bank of America. However John left. Our Team won in Paris. January came. He saw Foo.")
    assert enrich.entities(d).first().entities == ["Mary Smith", "Bank of America", "John", "Paris", "Foo"]
    assert [t.tag for t in docs(spark, "The firm quickly raised $5 in Paris").select(enrich.tagged("text").alias("t")).first().t] == ["DET", "NOUN", "ADV", "VERB", "NUM", "ADP", "PROPN"]


@pytest.mark.parametrize("word,base", [("Studies", "study"), ("running", "run"), ("walked", "walk"), ("stopped", "stop"), ("boxes", "box"), ("cats", "cat"), ("falling", "fall"), ("was", "be"), ("children", "child"), ("dog", "dog")])
def test_lemma(spark, word, base):
    assert docs(spark, word).select(enrich.lemma("text").alias("x")).first().x == base


def test_bio_round_trip(spark):
    tokens = enrich.span_tokens(docs(spark, "Acme Corp hired Jeff Bezos."))
    spans = spark.createDataFrame([(0, 0, 9, "ORG"), (0, 16, 26, "PERSON")], "doc_id long, start int, end int, label string")
    tagged = enrich.project_bio(tokens, spans)
    assert [r.bio for r in tagged.orderBy("tok").collect()] == ["B-ORG", "I-ORG", "O", "B-PERSON", "I-PERSON", "O"]
    assert sorted((r.label, r.text) for r in enrich.merge_bio(tagged).collect()) == [("ORG", "Acme Corp"), ("PERSON", "Jeff Bezos")]


def test_expand_hints(spark):
    given = spark.createDataFrame([("Costs", 2.0), ("fast", 1.0)], "term string, weight double")
    other = spark.createDataFrame([("fast", "Quick")], "term string, synonym string")
    assert {r.term: r.weight for r in enrich.expand_hints(given, other).collect()} == {"costs": 2.0, "cost": 1.0, "fast": 1.0, "quick": 0.5}


def test_backends(spark):
    d = docs(spark, "Mary Smith paid $5.")
    assert backends.resolve("auto", "metadata") is extract.metadata
    assert backends.resolve("rules", "metadata")(d).first().metadata.entities == ["Mary Smith"]
    with pytest.raises(ImportError):
        backends.resolve("odd", "metadata")


def plain_rank(nodes, edges):
    """Scores by the rule itself: a dictionary of neighbours, fifty steps at most."""
    near = {x: {} for x in nodes}
    for (x, y), w in edges.items():
        near[x][y] = near[y][x] = w
    score = {x: 1 / len(nodes) for x in nodes}
    for _ in range(50):
        new = {x: 0.15 / len(nodes) + 0.85 * sum(score[y] * w / sum(near[y].values()) for y, w in near[x].items()) for x in nodes}
        moved, score = sum(abs(new[x] - score[x]) for x in nodes), new
        if moved < 1e-6:
            break
    return score


def plain_terms(text):
    return [w for w in re.findall(r"\w+", text.lower()) if re.fullmatch("[a-z]{3,}", w) and w not in P.STOPWORDS]


def test_textrank_matches_a_plain_iteration(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("length(text) < 3000").orderBy("doc_id").limit(25)
    rows = d.withColumn("s", X.split_sentences("text")).collect()
    terms, sums = {}, {r.doc_id: r.summary for r in graph.summarize_textrank(d, 3).collect()}
    for r in graph.textrank_terms(d, 5).orderBy("doc_id", "rank").collect():
        terms.setdefault(r.doc_id, []).append(r.term)
    for r in rows:
        t, edges = plain_terms(r.text), Counter()
        for i, x in enumerate(t):
            for y in t[i + 1 : i + 4]:
                if x != y:
                    edges[min(x, y), max(x, y)] += 1
        score = plain_rank(sorted(set(t)), edges) if t else {}
        assert terms.get(r.doc_id, []) == sorted(score, key=lambda x: (-round(score[x], 10), x))[:5], r.doc_id
        counts = [Counter(plain_terms(s)) for s in r.s]
        norm = [math.sqrt(sum(v * v for v in c.values())) for c in counts]
        edges = {(i, j): sum(v * counts[j][w] for w, v in counts[i].items()) / (norm[i] * norm[j]) for j in range(len(counts)) for i in range(j) if counts[i].keys() & counts[j].keys()}
        want = r.text
        if len(r.s) > 3:
            score = plain_rank(range(len(r.s)), edges)
            want = " ".join(r.s[i] for i in sorted(sorted(score, key=lambda i: (-round(score[i], 10), i))[:3]))
        assert sums[r.doc_id] == want, r.doc_id


def test_brief_is_its_parts(spark, sf_dir):
    from inkstone.plans import corpora

    d = corpora.narratives(spark, sf_dir).where("doc_id < 20")
    budget = F.least(F.greatest(F.floor(F.length("text") * 0.35), F.lit(250)), F.lit(1500)).cast("int")
    parts = {r.doc_id: r.summary.rstrip() for r in summarize(d, budget).collect()}
    facts, contents = ({r[0]: r[1] for r in f(d).collect()} for f in (extract.key_facts, extract.toc))
    for r in report.brief(d, output="dict").collect():
        assert (r.brief.overview, r.brief.key_facts, r.brief.toc) == (parts[r.doc_id], facts[r.doc_id], contents[r.doc_id])
    for r in report.brief(d).collect():
        lines = ["Overview:", parts[r.doc_id], "", "Key facts:", *(f"  - {x}" for x in facts[r.doc_id]), "", "Also in this doc:", *(f"  - {x}" for x in contents[r.doc_id]), ""]
        assert r.brief == "\n".join(lines).rstrip() + "\n"


def test_agreement(spark):
    f, g = (spark.createDataFrame([(1, x) for x in s], "k int, v string") for s in ("abc", "bcde"))
    r = evals.set_agreement(f, g, ["v"], ["k"]).first()
    assert (r.tp, r.fp, r.fn) == (2, 1, 2) and r.precision == pytest.approx(2 / 3)
    r = docs(spark, "red cats run").select(evals.rouge("text", F.lit("red cats sleep")).alias("r")).first().r
    assert (r.r1_p, r.r2_p) == (pytest.approx(2 / 3), 0.5)
    found, gold = F.array(*map(F.lit, ["eight days", "12 users", "12 users"])), F.array(*map(F.lit, ["Eight-days", "12", "none", "12 users"]))
    one = docs(spark, "x").select(evals.greedy_agreement(found, gold, evals.equivalent).alias("x"), evals.overlap_agreement(found, gold).alias("y")).first()
    assert (one.x.tp, one.x.fp, one.x.fn) == (3, 0, 1) and one.x.recall == 0.75
    assert (one.y.tp, one.y.fp, one.y.fn) == (3, 0, 1)
    none = docs(spark, "x").select(evals.greedy_agreement(F.array().cast("array<string>"), gold, evals.equivalent).alias("x")).first().x
    assert (none.tp, none.fp, none.fn, none.f1) == (0, 0, 4, 0.0)


def test_absent_backends_say_what_is_missing(spark):
    for backend, primitive in (("spacy", "entities"), ("yake", "phrases")):
        with pytest.raises(ImportError, match="needs"):
            backends.resolve(backend, primitive)(docs(spark, "x"))
    with pytest.raises(ImportError, match="no backend"):
        backends.resolve("yake", "stats")


def test_rendering(spark):
    d = docs(spark, STORY)
    for kind, f in (("stats", extract.stats), ("metadata", extract.metadata), ("outline", extract.outline), ("toc", extract.toc), ("phrases", extract.phrases), ("key_facts", extract.key_facts), ("correlate_facts", extract.correlate_facts)):
        rows = f(d)
        for output in report.FORMATS:
            shown = rows.select(report.render(kind, rows.columns[1], output).alias("x")).first().x
            assert {"text": True, "markdown": shown.startswith("## "), "json": shown[:1] in "[{"}[output]
            assert any(word in shown for word in ("network", "Results", "2021"))
    with pytest.raises(ValueError):
        report.render("odd", "x")
    text = report.render_report(report.report(d)).first().report
    assert text.startswith("Summary\n=======\n") and "Key facts:" in text
    assert report.brief(d, output="dict").first().brief.toc
    scores = extract.term_scores(d, 3).groupBy("doc_id").agg(F.collect_list(F.struct("term", "kind", "score")).alias("t"))
    assert scores.select(report.render_term_scores("t").alias("x")).first().x.count("\n") == 2


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["stats", "metadata", "attributes", "fact_records"])
def test_row_local_operators_do_not_use_python(spark, sf_dir, name):
    assert "Python" not in plan(ALL[name](spark.read.parquet(f"{sf_dir}/documents.parquet")))


def test_plans(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stats = plan(extract.stats(d))
    assert "Exchange" not in stats and "ReadSchema: struct<doc_id:bigint,text:string>" in stats
    scores = plan(scoring.tfidf_scores(d))
    assert scores.count("Exchange hashpartitioning") <= 2 and "Python" not in scores  # the same exchange, once for each side


def test_spelled_out_numbers(spark):
    from inkstone.functions import numbers as N

    cases = {
        "two weeks": ["2"], "Eight days": ["8"], "twenty-one users": ["21"], "two hundred and five items": ["205"], "five thousand documents": ["5000"],
        "one million two hundred thousand and three": ["1200003"], "nineteen ninety": ["19", "90"], "one two three": ["1", "2", "3"], "a hundred": ["100"],
        "twenty and five": ["20", "5"], "someone often stones": [], "zero units": ["0"], "three thousand million": ["3000", "1000000"], "ten, eleven": ["10", "11"],
        "fifty five percent": ["55"], "two hundred and": ["200"], "nine hundred ninety nine thousand": ["999000"], "": [], "- and -": [],
    }
    rows = spark.createDataFrame(list(cases.items()), "t string, want array<string>").select("t", "want", N.spans(F.col("t")).alias("s")).collect()
    for r in rows:
        assert [x.digits for x in r.s] == r.want, r.t
        assert all(0 <= x.start < x.end <= len(r.t) and r.t[x.start : x.end] == r.t[x.start : x.end].strip() for x in r.s)


def test_facts_of_spelled_out_numbers(spark):
    text = "The trip took eight days and cost five thousand dollars. It rose fifty-five percent to 1,200 users. We read two hundred and five documents in 2020."
    docs = spark.createDataFrame([(1, text), (2, "no numbers here at all"), (3, None), (4, "It has 12 users.")], "doc_id long, text string")
    got = {r.doc_id: [(s.stat_type, s.value, s.unit) for s in r.stats] for r in extract.stats(docs, convert_word_names=True).collect()}
    assert got[1] == [("money", "five thousand dollars", "usd"), ("duration", "eight days", "day"), ("percent", "fifty-five", "percent"), ("count", "1,200", "users"), ("date", "2020", "date"), ("count", "two hundred and five", "documents")]
    assert got[2] == [] and got[3] == [] and got[4] == [("count", "12", "users")]
    phrases = [s.phrase for s in extract.stats(docs, convert_word_names=True).where("doc_id = 1").first().stats]
    assert all(p in text for p in phrases) and phrases[1].startswith("The trip took eight days")
    plain = [s.value for s in extract.stats(docs).where("doc_id = 1").first().stats]
    assert plain == ["1,200", "2020"]
    facts = extract.key_facts(docs, convert_word_names=True).where("doc_id = 1").first().key_facts
    assert len(facts) == 3
