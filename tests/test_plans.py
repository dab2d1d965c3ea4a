"""What plans hold: how often a source is read, and how often rows are dealt."""

from __future__ import annotations

import re

import pytest

from inkstone.operators import enrich, extract, report
from inkstone.functions import runs as R
from inkstone.plans import corpora as C
from pyspark.sql import functions as F


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def reads(df):
    return len(re.findall(r"FileScan", plan_of(df)))


def exchanges(df):
    return len(re.findall(r"\bExchange\b", plan_of(df)))


def test_correlated_facts_come_out_of_one_row(spark, sf_dir):
    facts = extract.correlate_facts(C.documents(spark, sf_dir))
    assert reads(facts) == 1 and exchanges(facts) == 0


def test_phrases_deal_rows_once(spark, sf_dir):
    docs = C.documents(spark, sf_dir)
    for df in (extract.phrases(docs), extract.phrases(docs, "order"), extract.phrase_scores(docs), extract.phrase_counts(docs)):
        assert reads(df) == 1 and exchanges(df) == 1


def test_key_facts_do_not_come_back_to_their_documents(spark, sf_dir):
    facts = extract.key_facts(C.documents(spark, sf_dir))
    assert reads(facts) <= 2 and exchanges(facts) <= 3


def test_details_are_one_projection(spark, sf_dir):
    df = extract.details(C.documents(spark, sf_dir))
    assert reads(df) == 1 and exchanges(df) == 0
    assert reads(report.report(C.documents(spark, sf_dir))) <= 9


@pytest.mark.parametrize("values", [[], ["a"], ["b", "a", "b", "c", "b", "a"], [""] * 3])
def test_counted_runs(spark, values):
    rows = spark.createDataFrame([(values,)], "v array<string>").select(F.inline(R.counted(F.col("v")))).collect()
    assert [tuple(r) for r in rows] == [(v, values.count(v), values.index(v)) for v in sorted(set(values))]


def test_facts_of_documents_with_equal_and_null_ids(spark):
    """Work inside one row does not mix up documents that share an id or have none."""
    texts = ["Order volume fell by 3 percent. Order volume rose 5 percent.", "Sales team won $5. Sales team paid $7.", "Nothing here."]
    docs = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (None, texts[0]), (None, texts[2])], "doc_id long, text string")
    got = sorted((r.doc_id is None, sorted({f.entity for f in r.correlated_facts})) for r in extract.correlate_facts(docs).collect())
    assert got == [(False, ["order volume"]), (False, ["sales team"]), (True, []), (True, ["order volume"])]
    assert extract.phrases(docs).count() == 4


def test_named_facts_still_use_names(spark):
    docs = spark.createDataFrame([(1, "Google sales fell by 3 percent. Google sales rose 5 percent.")], "doc_id long, text string")
    assert {r.entity for r in enrich.named_facts(docs).collect()} == {"Google"}
