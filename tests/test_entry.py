"""The driver contract, sources, streams and the command line."""

from __future__ import annotations

import json
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from inkstone import __main__ as cli
from inkstone import sources, streaming
from inkstone.operators import extract
from inkstone.plans import catalog

ROOT = Path(__file__).parent.parent


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "orders", "customer", "lineitem", "part"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    want = con.execute("select {} from ({})".format(", ".join(f'"{c}"' for c in cols), catalog.ORACLE[name])).fetchall()
    got = df.select(*cols).collect()
    assert got and sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    import shutil

    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; assert 'sentences' in e.queries() and 'pipeline' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "r")})


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("Line one.\nLine two.")
    (tmp_path / "j.jsonl").write_text('{"id": "x", "text": "é"}\n')
    (tmp_path / "h.txt").write_text("One\n\n Two \n")
    assert sources.read_text_files(spark, str(tmp_path / "t")).first().text == "Line one.\nLine two."
    assert tuple(sources.read_jsonl(spark, str(tmp_path / "j.jsonl")).first()) == ("x", "é")
    assert sources.read_headings(spark, str(tmp_path / "h.txt")) == ["One", "Two"]
    docs = sources.one_document(spark, "a" * 60 + "\n\nshort\n\n" + "b" * 60)
    assert sources.chunks(docs).count() == 2
    sources.write_text(docs, str(tmp_path / "out"), "text")
    sources.write_json(docs, str(tmp_path / "json"))
    sources.write_relations(docs, str(tmp_path / "rel"))
    assert spark.read.parquet(str(tmp_path / "rel")).count() == 1
    assert '"doc_id" : 0' in sources.as_json(docs).first().json


def test_streams(spark, tmp_path, sf_dir):
    source = spark.createDataFrame([(i, f"It took {i} days. It cost ${i}.", f"2024-01-01 0{i % 3}:00:00") for i in range(9)], "doc_id long, text string, ts string").selectExpr("doc_id", "text", "cast(ts as timestamp) as ts")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    docs = streaming.documents(spark, str(tmp_path / "in"), "doc_id long, text string, ts timestamp", 1)
    counts = streaming.fact_counts(streaming.facts(docs, keep=("ts",)), "ts")
    query = counts.writeStream.outputMode("complete").format("memory").queryName("facts_seen").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.stat_type, r.n) for r in spark.sql("select stat_type, sum(n) as n from facts_seen group by 1").collect()} == {("duration", 9), ("money", 9)}
    streaming.summaries(docs, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9
    assert extract.stats(source).count() == 9


@pytest.mark.parametrize("mode", ["default", "tfidf", "keyword", "textrank", "clean_text", "strip_think", "brief", "report", "facts", "stats", "outline", "toc", "metadata", "phrases", "top_terms", "correlate_facts", "attributes", "entities"])
def test_command_line(spark, tmp_path, mode):
    (tmp_path / "a.txt").write_text("# T\n\nThe team met 5 times in 2020. The team won. Cost: 5 units\n")
    args = cli.parser().parse_args([mode, "--in", str(tmp_path / "a.txt"), "--keywords", "team", *(["--hint", "team=2"] if mode == "default" else [])])
    assert cli.run(spark, args).count() == 1


def test_command_line_attaches_scores_and_splits_lists(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("# T\n\nThe team met five times in 2020 for two weeks. The team won. The team paid $5 to 7 users.\n")
    run = lambda *more: cli.run(spark, cli.parser().parse_args([more[0], "--in", str(tmp_path / "a.txt"), *more[1:]])).first()[1]
    shown = run("summarize", "--attach", "stats,metadata", "--hint", "team=2,users")
    assert "## Summary" in shown and "## Stats" in shown and "## Metadata" in shown
    assert set(json.loads(run("default", "--attach", "all", "--format", "json"))) >= {"summary", "stats", "outline", "metadata", "phrases", "correlated_facts"}
    assert "two weeks" in run("stats", "--convert-word-names") and "two weeks\t" not in run("stats")
    assert run("top_terms", "--top", "2", "--kinds", "words", "--scores").count("\n") == 1
    assert len(run("facts", "--max-facts", "1").splitlines()) == 1
    assert cli.listed(["a, b", "c,,d "]) == ["a", "b", "c", "d"] and cli.hints(["a=2,b"]) == {"a": 2.0, "b": 1.0}
    (tmp_path / "many").mkdir()
    for i in range(25):
        (tmp_path / "many" / f"{i}.txt").write_text(f"text number {i}")
    out = cli.run(spark, cli.parser().parse_args(["clean", "--in", str(tmp_path / "many" / "*.txt")]))
    assert sum(1 for _ in out.toLocalIterator()) == 25
