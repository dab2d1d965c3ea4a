"""Work that stays in a document's row: nothing made twice, nothing dealt out, and texts in many tasks."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from inkstone.functions import rows as W
from inkstone.operators import chain, enrich, extract, graph, keyphrases, nearest, scoring
from inkstone.operators.summarize import summarize
from inkstone.plans import catalog, labels
from inkstone.plans import corpora as C
from pyspark.sql import functions as F


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_narratives_are_dealt_out_before_their_texts_are_made(spark, sf_dir):
    """A deal by the join's own key was left out of the plan."""
    assert "REPARTITION_BY_NUM" in plan_of(C.narratives(spark, sf_dir))


def test_rows_of_an_array_do_not_ask_for_its_size_before(spark, sf_dir):
    facts = W.numbered(extract.stats(C.narratives(spark, sf_dir)), ["doc_id"], "stats", "i", "s")
    assert plan_of(facts).count("split(") == plan_of(extract.stats(C.narratives(spark, sf_dir))).count("split(")
    rows = spark.createDataFrame([(1, ["a", None]), (2, []), (3, None)], "k long, v array<string>")
    assert [tuple(r) for r in W.numbered(rows, ["k"], "v", "i", "x").collect()] == [(1, 0, "a"), (1, 1, None)]


def test_scores_come_out_of_one_row(spark, sf_dir):
    docs = C.documents(spark, sf_dir)
    for df in (scoring.tfidf_scores(docs), scoring.scored_documents(docs), extract.word_scores(docs), extract.term_scores(docs)):
        assert not re.search(r"\bExchange\b|\bWindow\b", plan_of(df))


def test_scores_of_documents_with_equal_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "Alpha beta gamma. Alpha delta."), (1, "Other words here."), (None, "Alpha beta gamma. Alpha delta.")], "doc_id long, text string")
    got = [sorted((r.term, round(r.score, 6)) for r in extract.word_scores(docs.where(c)).collect()) for c in ("doc_id is null", "text like 'Alpha%' and doc_id = 1")]
    assert got[0] == got[1] and got[0]
    assert scoring.tfidf_scores(docs).count() == 5


def test_features_are_made_of_neighbouring_tokens_where_they_are(spark):
    docs = spark.createDataFrame([(1, "Mary went to Paris - now 42 times."), (2, ""), (3, None), (4, "One")], "doc_id long, text string")
    tokens = enrich.span_tokens(docs)
    wide = enrich.sequence_features(tokens)
    dealt = plan_of(wide)
    assert "pre1" not in dealt[dealt.index("Exchange") :]
    some = lambda df: sorted((r.doc_id, r.tok, tuple(r.features)) for r in df.select("doc_id", "tok", F.col("features")).collect())
    assert some(enrich.text_features(docs)) == some(wide)
    assert "Exchange" not in plan_of(enrich.text_features(docs))


def test_key_phrases_come_out_of_one_row(spark):
    """Their words were dealt out, and once for each kind of distinct neighbours."""
    text = "Deep learning helps. Deep learning needs data centers. The data centers use data."
    docs = spark.createDataFrame([(1, text), (1, "Solar panels, solar panels."), (2, None), (None, text)], "doc_id long, text string")
    for df in (keyphrases.keyphrases(docs), keyphrases.phrase_weights(docs, 3), keyphrases.word_weights(docs)):
        assert not re.search(r"\bExchange\b|\bWindow\b", plan_of(df))
    rows = keyphrases.phrase_weights(docs, 3).collect()
    first, same = ({(r.phrase, r.n, r.score) for r in rows if r.doc_id == i} for i in (1, None))
    assert ("deep learning needs", 1) in {x[:2] for x in same} and same < first and {("solar panels", 2)} < {x[:2] for x in first - same}
    assert not any("helps deep" in r.phrase or "the data" == r.phrase for r in rows)


def test_chains_are_labelled_where_their_text_is(spark, monkeypatch):
    """Every feature of every token was a row that was dealt out; the labels are those of the joined tables."""
    texts = ["Dr. Mary Smith of Paris met Google in May. 12 men left.", "", None, "Smith & Co", "IBM"]
    docs = spark.createDataFrame(list(enumerate(texts)), "sid long, sentence string")
    weights, moves = spark.createDataFrame([*labels.WEIGHTS, ("w.lower=met", "O", 1.5), ("+2:suf2=en", "I-MISC", 4.0), ("-2:pre3=Mar", "B-ORG", 0.25)], "feature string, label string, weight double"), spark.createDataFrame(labels.MOVES, "before string, label string, weight double")
    found = chain.text_labels(docs, weights, moves)
    assert not re.search(r"\bExchange\b|\bWindow\b", plan_of(found))
    tokens, rows = enrich.span_tokens(docs, "sid", "sentence"), sorted(map(tuple, found.collect()))
    assert rows == sorted(map(tuple, chain.chain_labels(tokens, weights, moves, id_col="sid").collect()))
    monkeypatch.setattr(chain, "BROADCAST_WEIGHTS", 1)
    assert rows == sorted(map(tuple, chain.chain_labels(tokens, weights, moves, id_col="sid").collect())) and {r[3] for r in rows} > {"O", "B-PERSON"}


def test_company_of_terms_comes_out_of_one_row(spark):
    texts = ["alpha beta alpha gamma alpha beta", "delta", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near, terms = graph.companions(docs), graph.textrank_terms(docs, 2)
    for df in (near, terms):
        assert not re.search(r"\bExchange\b|\bWindow\b", plan_of(df))
    assert sorted(map(tuple, near.collect())) == [(0, "alpha", "beta", 5), (0, "alpha", "gamma", 3), (0, "beta", "gamma", 2)]
    assert sorted(map(tuple, terms.collect())) == [(0, 1, "alpha"), (0, 2, "beta"), (1, 1, "delta")]


def test_documents_of_few_edges_are_ranked_in_one_row(spark, monkeypatch):
    """Every document took up to fifty joins; now only those of very many edges do, to the same scores."""
    docs = spark.createDataFrame([(i, "Red cats run. Red dogs run far. Blue cats sleep. " * (i + 1)) for i in range(4)] + [(9, "One only.")], "doc_id long, text string")
    edges, sizes = graph.similarities(docs), scoring.sentences(docs).groupBy("doc_id").agg(F.count("*").alias("n"))
    tabled = graph._rank_by_tables
    want = sorted((r.doc_id, r.node, round(r.score, 9)) for r in tabled(edges, sizes, "doc_id").collect())
    asked = []
    monkeypatch.setattr(graph, "_rank_by_tables", lambda e, s, c: asked.append(sorted(r.doc_id for r in s.collect())) or tabled(e, s, c))
    for most, heavy in ((graph.IN_ROW, None), (20, [2, 3])):
        asked.clear()
        assert sorted((r.doc_id, r.node, round(r.score, 9)) for r in graph.rank_nodes(edges, sizes, in_row=most).collect()) == want
        assert asked == ([heavy] if heavy else [])


def test_names_are_labelled_in_their_texts_own_row(spark, monkeypatch):
    """nothing is dealt out for a table of names that can be sent; joins give the same rows."""
    texts = ["Zoë met Mary Smith. Mary, Smith & Co; of Paris of London. Dr. Mary Smith", "É. & Smith & Co of Paris! Then 'Mary' Smith Jones left. \U0001d400 Paris", "of Mary Smith of of Paris", None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "doc_id long, text string")
    names = chain.corpus_names(docs).localCheckpoint()
    assert "Exchange" not in plan_of(enrich.name_runs(docs))
    for of in (chain.label_corpus, chain.corpus_tags):
        sent = of(docs, names)
        assert "Exchange" not in plan_of(sent)
        rows = sorted(map(tuple, sent.collect()))
        with monkeypatch.context() as m:
            m.setattr(chain, "KNOWN_NAMES", 0)
            assert sorted(map(tuple, of(docs, names).collect())) == rows and len(rows) > 10
    tags = enrich.project_bio(enrich.span_tokens(docs), chain.label_corpus(docs, names))
    assert sorted(map(tuple, tags.collect())) == rows


def test_runs_of_capitals(spark):
    text = "Dr. Lee of Paris. Mary & of Rome van Gogh ... Smith & Co. Then! & Paris de la Tour"
    runs = [(r.pos, r.parts, r.starts) for r in enrich.name_runs(spark.createDataFrame([(1, text), (2, None), (3, "no names")], "doc_id long, text string")).collect()]
    assert runs == [(0, ["Dr", "Lee", "of", "Paris"], True), (6, ["Mary"], True), (9, ["Rome", "van", "Gogh"], False), (15, ["Smith", "&", "Co"], True), (19, ["Then"], True), (22, ["Paris"], False), (25, ["Tour"], False)]


def test_features_of_words_where_they_are_used(spark):
    """F8: words' features are made in a task, once for a word; they are those of ``token_features``."""
    words = ["Mary", "dr", "Dr", "'", "&", "É", "étÉ", "A-1", "42", "x9", "ÀÉ", "\U0001d400x", "ǅ", "Smithsonian's", "paris", "٣"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", enrich.token_features("w").alias("f")).collect()
    assert {r.w: r.f for r in rows} == {w: chain.word_features(w) for w in words}
    sentences = spark.createDataFrame([(i, f"Mary Smith met John Brown of Paris on day {i}.") for i in range(9)], "sid long, sentence string")
    rows = chain._tagged_rows(sentences, "sid", "sentence")
    assert "Exchange" not in plan_of(rows) and rows.columns == ["sid", "t", "y"]
    same = chain.chain_rows(chain.corpus_tags(sentences, id_col="sid", text_col="sentence"), "sid", "bio")
    assert sorted(map(str, rows.collect())) == sorted(map(str, same.collect()))


def test_dialogues_are_dealt_out_to_every_core(spark, sf_dir):
    """all texts were made, and searched, in one task."""
    rows = C.dialogues(spark, sf_dir)
    assert "REPARTITION_BY_NUM" in plan_of(rows) and plan_of(rows).count("Exchange") == 1
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_filter_on_key_facts_does_not_make_them_twice(spark, sf_dir):
    """the filter was moved below the deal of the narratives, into one task, and made all facts there once more."""
    plain, shown = extract.key_facts(C.narratives(spark, sf_dir), 4), catalog.QUERIES["key_facts_rendered"](spark, sf_dir)
    assert plan_of(shown).count("split(") == plan_of(plain).count("split(") > 0
    below = plan_of(shown)[plan_of(shown).index("REPARTITION_BY_NUM") :]
    assert "split(" not in below and "regexp" not in below
    docs = spark.createDataFrame([(1, "It cost $5. It took 7 days."), (2, "Nothing here."), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.key_facts for r in extract.key_facts(docs).collect()} == {1: ["It cost $5.", "It took 7 days."], 2: [], 3: []}


def test_sentences_are_ranked_without_their_pairs(spark):
    """all pairs of a document's sentences that share a term were joined, dealt out and summed."""
    texts = ["Red cats run. Red dogs run far. Blue cats sleep. Blue birds. Nothing else matters here. Red cats run. An. Blue birds sing, birds.", "One only.", "", None, "Red cats run. Red cats run. Dogs bark."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = graph.sentence_ranks(docs)
    for df in (found, graph.summarize_textrank(docs, 2)):
        assert not re.search(r"\bExchange\b|\bWindow\b|Join", plan_of(df))
    sizes = scoring.sentences(docs).groupBy("doc_id").agg(F.count("*").alias("n"))
    same = lambda df: sorted((r.doc_id, r.node, round(r.score, 9)) for r in df.collect())
    assert same(found) == same(graph.rank_nodes(graph.similarities(docs), sizes)) and found.count() == 12
    assert sorted(map(tuple, graph.summarize_textrank(docs, 2).collect()), key=str) == sorted(map(tuple, graph.summarize_textrank(docs, 2, distributed=True).collect()), key=str)
    n = 3000  # every pair of these shares a term; 4.5 million edges before
    assert np.allclose(graph.rank_by_terms(n, np.repeat(np.arange(n), 2), np.array([[0, i + 1] for i in range(n)]).ravel()), 1 / n)


def test_key_phrases_are_counted_in_whole_documents(spark, monkeypatch):
    """words and phrases were sorted, weighed and compared by interpreted expressions; weights are those of ``word_weights``."""
    text = "Deep learning helps. Deep learning needs data-centers. The DATA centers use NASA's data, É. Ärger Ärger 42 x9 don't. Deep Learning's end"
    docs = spark.createDataFrame([(1, text), (2, "..."), (3, None), (4, text + " " + text), (5, "One")], "doc_id long, text string")
    weights = {(r.doc_id, r.term): (r.n, r.weight) for r in keyphrases.word_weights(docs).collect()}
    pieces = [r.p for r in docs.select(keyphrases._pieces(F.col("text")).alias("p")).collect()]
    rows = pa.array(pieces, pa.list_(pa.list_(pa.string())))
    for most in (keyphrases.PIECES, 1):
        monkeypatch.setattr(keyphrases, "PIECES", most)
        portions = list(keyphrases._portions(rows))
        assert sum(map(len, portions)) == 5 and (len(portions) == 1) == (most > 1)
        seen, before = 0, 0
        for some in portions:
            p = keyphrases.counted(some, 2)
            for i in range(len(p.doc)):
                n, w = weights[before + p.doc[i] + 1, p.words[p.terms[i, 0]]]
                assert p.size[i] == 2 or (p.n[i] == n and abs(p.score[i] - w / (n * (1 + w))) < 1e-8)
                seen += 1
            before += len(some)
        assert seen == keyphrases.phrase_weights(docs).count() > 40
    assert keyphrases.rounded(np.array([0.1234567885, 0.00000000049, 2.5])).tolist() == [0.123456789, 0.0, 2.5]
    for a, b, d in (("kitten", "sitting", 3), ("abc", "abc", 0), ("", "ab", 2), ("abcdef", "abXdef", 1), ("ab", "ba", 2)):
        assert [keyphrases.within(a, b, most) for most in range(5)] == [None] * d + [d] * (5 - d)


def test_a_words_features_are_not_made_at_each_place(spark):
    """features of every token were made by interpreted expressions, and sent to Python with it."""
    docs = spark.createDataFrame([(1, "Dr. Mary Smith met Google.")], "sid long, sentence string")
    weights, moves = spark.createDataFrame(labels.WEIGHTS, "feature string, label string, weight double"), spark.createDataFrame(labels.MOVES, "before string, label string, weight double")
    assert "gaz=" not in plan_of(chain.text_labels(docs, weights, moves))
    tokens = spark.createDataFrame([(1, 0, None), (1, 1, "Mary")], "doc_id long, tok int, token string")
    assert [r.bio for r in chain.chain_labels(tokens, weights, moves).orderBy("tok").collect()] == ["O", "B-PERSON"]


def test_only_sentences_with_digits_are_taken_apart_for_nearest_facts(spark, monkeypatch):
    """the words of all sentences were dealt out, all were asked what they say, and names were found twice."""
    texts = ["Google hired 14 people. Google grew. Google paid $5 by May. All of Google has ٣ items.", "No digits for Google. Google grew.", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked, found = [], []
    tokens, spans = enrich.name_tokens, enrich.entity_spans
    monkeypatch.setattr(enrich, "name_tokens", lambda d, *a: asked.append(sorted(r.sentence for r in d.collect())) or tokens(d, *a))
    monkeypatch.setattr(enrich, "entity_spans", lambda d, *a: found.append({r.sid.doc_id for r in d.select("sid").collect()}) or spans(d, *a))
    facts = nearest.nearest_facts(docs)
    assert asked == [["Google hired 14 people.", "Google paid $5 by May."]] and found == [{0}]
    assert sorted((r.sent_idx, r.entity, r.number) for r in facts.collect()) == [(0, "google", "14 people"), (2, "google", "$5")]


def test_a_report_scores_a_text_once_for_summary_and_contents(spark):
    """F8: for the table of contents of a summary a text was scored again, dealt out by heading, and joined."""
    text = "Before. It has text.\n\n# One\n\nThe first body has a few words here. The second one has more of these words here.\n\n# Empty\n\n## Two:\n\nAnother body with words in it."
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "No heading at all, only this one.")], "doc_id long, text string")
    found, summary = extract.outline(docs), summarize(docs, 200, include_toc=True, keep_headings=True)
    for df in (found, summary):
        assert not re.search(r"\bExchange\b|\bWindow\b|Join", plan_of(df))
    rows = {r.doc_id: [tuple(o) for o in r.outline] for r in found.collect()}
    assert [o[:2] for o in rows[1]] == [(1, "One"), (2, "Two")] and rows[1][1][2] == "Another body with words in it." and not (rows[2] or rows[3] or rows[4])
    assert {r.doc_id: r.summary for r in summary.collect()}[1].startswith("One\n  Two\n\n")
