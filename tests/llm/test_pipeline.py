"""The corpus pipeline against its stages' brute-force versions."""

from __future__ import annotations

import corpus_pipeline
from inkstone.llm.shared import written

from .test_near_duplicates import slow_all_lines, slow_similar
from .test_texts import check_packing, slow_hits


def test_stages(spark, sf_dir):
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "lines", "near_duplicates", "benchmark", "sequences"]

    def run(name, docs):
        out = written(stages[name](spark, docs, sf_dir))
        if name != "sequences":
            assert out.columns == columns
            assert all(r.n_chars == len(r.text) for r in out.collect())
        return out

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = run("language", docs)
    assert first.count() >= 0.98 * docs.count()
    rows = [(r.doc_id, r.text) for r in first.orderBy("doc_id").collect()]
    gone, want = slow_all_lines(rows), {}
    for doc, text in rows:
        kept = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone.get(doc, ()))
        if doc not in gone or kept.strip():
            want[doc] = kept
    second = run("lines", first)
    assert {r.doc_id: r.text for r in second.collect()} == want
    third = run("near_duplicates", second)
    left = sorted(want.items())
    assert sorted(r.doc_id for r in third.collect()) == sorted(left[i][0] for i, root in enumerate(slow_similar(left)) if i == root)
    fourth = run("benchmark", third)
    texts = {r.doc_id: r.text for r in third.collect()}
    assert {r.doc_id for r in fourth.collect()} == {d for d, t in texts.items() if not slow_hits(t, items)[4]}
    fifth = run("sequences", fourth)
    check_packing(fifth.collect(), [(r.doc_id, r.text) for r in fourth.collect()])


def test_run_is_the_stages_in_turn(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_clean_documents_stay(spark, sf_dir):
    docs = spark.createDataFrame([(i, f"entirely distinct number{i} words{i * 7} of text{i * 3} here", "en", "s", 0) for i in range(50)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, sf_dir).count() == 50, name


def test_lines_keeps_short_documents_that_share_a_long_line(spark):
    shared = "one licence line of six words"
    texts = {1: f"{shared}\nfirst of its own", 2: f"first to say\n{shared}", 3: f"{shared}\n \t\u3000\n", 4: shared, 5: " \n", 6: None}
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in dict(corpus_pipeline.STAGES)["lines"](spark, docs, "").collect()}
    assert got == {1: (texts[1], len(texts[1])), 2: ("first to say", 12), 5: (" \n", 2), 6: (None, None)}


def test_lines_matches_brute_force_over_all_lines(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    gone, want = slow_all_lines(rows), {}
    for doc, text in rows:
        kept = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone.get(doc, ()))
        if doc not in gone or kept.strip():
            want[doc] = kept
    assert {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["lines"](spark, docs, sf_dir).collect()} == want
