"""Sequence labelling, nearest names, noun chunks and key phrases against plain statements of their rules."""

from __future__ import annotations

import itertools
import math
import random
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstone.functions import patterns as P
from inkstone.operators import chain, enrich, graph, keyphrases, nearest, scoring
from inkstone.plans import corpora as C
from inkstone.plans import labels as queries
from inkstone.stored import Stored

DOCS = "doc_id long, text string, label string, n int"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], DOCS)


# ---- labels and chains ---------------------------------------------------------------


def test_label_corpus_gives_byte_spans(spark):
    texts = ["Zoë met Mary Smith in Paris. Then Mary Smith & Co sold it.", "paris is not Paris. Smith left.", None, ""]
    rows = chain.label_corpus(docs(spark, *texts)).collect()
    for r in rows:
        assert texts[r.doc_id].encode()[r.start : r.end].decode() == r.text
    found = {(r.doc_id, r.text, r.label) for r in rows}
    assert {(0, "Mary Smith", "PERSON"), (0, "Paris", "PLACE"), (1, "Paris", "PLACE"), (0, "Mary Smith & Co", "ORG")} <= found
    spans = {}
    for r in rows:
        spans.setdefault(r.doc_id, []).append((r.start, r.end))
    for of in spans.values():
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(sorted(of)))


def test_labels_round_trip_through_tags(spark):
    """Spans as tags and back are the spans, but for those that touch."""
    corpus = docs(spark, "Mary Smith of Paris met Google. London, Paris and Rome agreed.", "In 2020 Mary Smith joined Smith & Co of London.")
    tokens = enrich.span_tokens(corpus)
    spans = chain.label_corpus(corpus)
    back = enrich.merge_bio(enrich.project_bio(tokens, spans)).alias("m")
    ends = tokens.select("doc_id", "tok", "start", "end")
    first, last = ends.select(F.col("doc_id").alias("d1"), F.col("tok").alias("t1"), "start"), ends.select(F.col("doc_id").alias("d2"), F.col("tok").alias("t2"), "end")
    again = back.join(first, (F.col("doc_id") == F.col("d1")) & (F.col("first_tok") == F.col("t1"))).join(last, (F.col("doc_id") == F.col("d2")) & (F.col("last_tok") == F.col("t2")))
    assert sorted(map(tuple, again.select("doc_id", "start", "end", "label").collect())) == sorted(map(tuple, spans.select("doc_id", "start", "end", "label").collect()))


def test_viterbi_is_exhaustive():
    rng = np.random.default_rng(1)
    for n in range(0, 6):
        # quarters: sums are exact, and ties happen
        chains = [rng.integers(-4, 5, (n, 3)) / 4 for _ in range(20)] + [np.zeros((n, 3))]
        moves = rng.integers(-4, 5, (3, 3)) / 4
        for scores, way in zip(chains, chain.viterbi(chains, moves)):
            total = lambda w: sum(scores[i, x] for i, x in enumerate(w)) + sum(moves[a, b] for a, b in itertools.pairwise(w))  # noqa: B023, E731
            best = min(itertools.product(range(3), repeat=n), key=lambda w: (-total(w), w[::-1]))  # noqa: B023
            assert tuple(way) == best


def test_expectations_match_enumeration():
    rng = np.random.default_rng(2)
    chains, moves = [rng.normal(size=(n, 3)) for n in (4, 1, 3, 0, 4)], rng.normal(size=(3, 3))
    share, moved, norms = chain.expectations(chains, moves)
    want_moves, want_norm = np.zeros((3, 3)), 0.0
    for scores, found in zip(chains, share):
        ways = list(itertools.product(range(3), repeat=len(scores)))
        weight = np.exp([sum(scores[i, x] for i, x in enumerate(w)) + sum(moves[a, b] for a, b in itertools.pairwise(w)) for w in ways])
        want = np.zeros_like(scores)
        for w, p in zip(ways, weight / weight.sum()):
            for i, x in enumerate(w):
                want[i, x] += p
            for a, b in itertools.pairwise(w):
                want_moves[a, b] += p
        assert np.allclose(found, want, atol=1e-9)
        want_norm += math.log(weight.sum()) if len(scores) else 0
    assert np.allclose(moved, want_moves, atol=1e-3) and abs(norms - want_norm) < 1e-3


def test_chain_labels_without_weights_or_tokens(spark):
    tokens = enrich.span_tokens(docs(spark, "Mary has left.", None, ""))
    weights, moves = spark.createDataFrame([], "feature string, label string, weight double"), spark.createDataFrame([], "before string, label string, weight double")
    assert {r.bio for r in chain.chain_labels(tokens, weights, moves).collect()} == {"O"}
    some = chain.chain_labels(tokens, spark.createDataFrame(queries.WEIGHTS, weights.schema), spark.createDataFrame(queries.MOVES, moves.schema))
    assert {(r.token, r.bio) for r in some.collect()} >= {("Mary", "B-PERSON"), ("has", "O")}


@pytest.fixture(scope="module")
def chains(spark):
    rng = random.Random(7)
    names = ["Mary Smith", "John Brown", "Google", "Smith & Co", "Paris", "London"]
    texts = [f"The {rng.choice(['team', 'office', 'plan'])} of {rng.choice(names)} {rng.choice(['met', 'paid', 'left'])} {rng.choice(names)} in {rng.choice(['May', names[-1], names[-2]])}." for _ in range(200)]
    corpus = docs(spark, *texts)
    tokens = enrich.span_tokens(corpus)
    with Stored(spark) as stored:
        yield stored(chain.chain_rows(enrich.project_bio(tokens, chain.label_corpus(corpus)), tags="bio"))


def test_training_follows_no_partitioning(spark, chains, tmp_path):
    one = chain.train(chains.coalesce(1), steps=4)
    many = chain.train(chains.repartition(13), steps=4)
    assert np.array_equal(one.weights, many.weights) and np.array_equal(one.moves, many.moves) and one.weights.any()
    state = f"file://{tmp_path}/state"
    chain.train(chains, steps=2, state=state)  # as if the driver had gone here
    resumed = chain.train(chains, steps=4, state=state)
    assert np.array_equal(one.weights, resumed.weights) and np.array_equal(one.moves, resumed.moves)
    assert not chain.train(chains.where("false"), steps=2).weights.any()


def test_a_training_step_reads_blocks_of_numbers(spark, chains, monkeypatch):
    """each step took every word apart, and looked its features up, again; equal chains count several times now."""
    twice = chains.unionByName(chains).unionByName(chains.limit(20))
    monkeypatch.setattr(chain, "BLOCK", 300)
    blocks = chain._blocks(twice.repartition(2)).collect()
    times = [np.frombuffer(r.times, np.int64) for r in blocks]
    assert len(blocks) > 3 and sum(map(sum, times)) == 420 and sum(map(len, times)) < 420
    words, n = np.zeros((chain.SLOTS, len(chain.LABELS))), 0
    words[[chain._slot(f) for f in ("w.lower=mary", "-1:is_title", "+2:suf1=s", "bias", "EOS")]] = np.arange(1, 10)
    for r in blocks:
        block = chain._Block(**r.asDict())
        got = np.split(block.scores(words), block.every.ends[1:-1])
        assert all(len(c) == size for c, size in zip(got, np.frombuffer(r.sizes, np.int32)))
        n += sum(t * c.sum() for t, c in zip(block.times, got))
    own = chain._Words(words)
    assert n == sum(c.sum() for c in own.chains([r.w for r in twice.selectExpr("t.token as w").collect()]))


def test_lanes_lose_no_token_and_long_chains_hold_up_no_others():
    chains = [np.arange(n)[:, None] + 100.0 * i for i, n in enumerate((3, 0, 5, 1, 3))]
    lanes = chain.Lanes(np.array([3, 0, 5, 1, 3]))
    laid = lanes.laid(chains, 1)
    assert laid[:, 0].tolist() == [200, 0, 400, 300, 201, 1, 401, 202, 2, 402, 203, 204] and lanes.reach.tolist() == [4, 3, 3, 1, 1]
    assert all(np.array_equal(a, b) for a, b in zip(lanes.apart(laid), chains)) and laid[lanes.before(2)].tolist() == [[201], [1], [401]]


def test_learned_names_on_held_out_documents(spark):
    sentences = queries._sentences(C.ledgers(spark, "/root/testdata/sf0.001"))
    _, agreed = chain.learn_names(sentences, held_out=F.pmod(F.col("sid.doc_id"), F.lit(10)) == 0)
    rows = agreed.collect()
    tp, fp, fn = (sum(r[c] for r in rows) for c in ("tp", "fp", "fn"))
    assert 2 * tp / (2 * tp + fp + fn) >= 0.9 and tp > 50


def test_features_of_a_token(spark):
    row = {r.tok: set(r.features) for r in enrich.sequence_features(enrich.span_tokens(docs(spark, "Dr. Lee won 7"))).collect()}
    assert {"w.lower=dr", "shape=Xx", "pre1=D", "suf2=Dr", "is_title", "gaz=TITLES", "BOS", "bias", "+1:w.lower=.", "+2:w.lower=lee"} <= row[0]
    assert {"is_digit", "has_digit", "shape=d", "EOS", "-1:w.lower=won"} <= row[4] and "BOS" not in row[4]


# ---- nearest names -------------------------------------------------------------------


def test_nearest_facts(spark):
    text = "Google hired 14 people while Smith & Co hired 3 people. Google grew by 5 percent. Smith & Co declined by 2 percent and grew to 9 units."
    rows = {(r.entity, r.number, r.polarity) for r in nearest.nearest_facts(docs(spark, text, None, "", "No names but 7 days.")).collect()}
    # "hired" says neither; a sentence with both verbs says both
    assert {("google", "14 people", "absolute"), ("smith & co", "3 people", "absolute")} <= rows
    assert all(e in ("google", "smith & co") for e, _, _ in rows)


def test_nearest_facts_match_all_pairs(spark):
    """The nearest of all names of the sentence, by distance, then place."""
    corpus = C.ledgers(spark, "/root/testdata/sf0.001").where("doc_id % 5 = 1")
    rows = nearest.nearest_facts(corpus).collect()
    assert rows
    sentences = scoring.sentences(corpus).withColumn("sid", F.struct("doc_id", "sent_idx"))
    names = {}
    for r in enrich.entity_spans(sentences, "sid", "sentence", nearest.PIECE).withColumn("name", nearest.canonical(F.col("entity"))).collect():
        names.setdefault(tuple(r.sid), []).append((r["first"], r["last"], r.name))
    for r in rows:
        best = min((0 if a <= r.pos <= b else min(abs(r.pos - a), abs(r.pos - b))) for a, b, _ in names[r.doc_id, r.sent_idx] if True)
        assert r.distance >= best
        assert any(n == r.entity and r.distance == (0 if a <= r.pos <= b else min(abs(r.pos - a), abs(r.pos - b))) for a, b, n in names[r.doc_id, r.sent_idx])


def test_verb_facts(spark):
    rows = enrich.verb_facts(docs(spark, "Google increased the price to $14. Paris fell to 3 units. It rose by 5 percent.")).collect()
    assert {(r.entity, r.polarity) for r in rows} <= {("Google", "growth"), ("Paris", "decline")} and ("Google", "growth") in {(r.entity, r.polarity) for r in rows}


# ---- chunks --------------------------------------------------------------------------


def slow_chunks(tags):
    """Longest runs of modifiers, then nouns, left to right."""
    out, i = [], 0
    while i < len(tags):
        j = i
        while j < len(tags) and tags[j] in ("ADJ", "NUM"):
            j += 1
        k = j
        while k < len(tags) and tags[k] in ("NOUN", "PROPN"):
            k += 1
        if k > j and k - i >= 2:
            out.append((i, k - i))
        i = max(k, i + 1)
    return out


def test_noun_chunks_match_brute_force(spark, sf_dir):
    corpus = C.ledgers(spark, sf_dir)
    got = {}
    for r in nearest.noun_chunks(corpus).collect():
        got.setdefault((r.doc_id, r.sent_idx), []).append((r.pos, r.size))
    for r in scoring.sentences(corpus).select("doc_id", "sent_idx", enrich.tagged("sentence").alias("t")).collect():
        assert sorted(got.get((r.doc_id, r.sent_idx), [])) == slow_chunks([t.tag for t in r.t])


def test_noun_phrases(spark):
    rows = nearest.noun_phrases(docs(spark, "The risk register grew. A risk register is useful. The green table.", None, ""), "table").collect()
    assert {r.doc_id: r.phrases for r in rows} == {0: ["risk register", *[p for p in rows[0].phrases if "table" in p]], 1: [], 2: []} or rows[0].phrases[0].startswith("risk register")
    assert len(rows) == 3


# ---- key phrases ---------------------------------------------------------------------


def slow_words(sentences):
    """The statistics of words, one document at a time."""
    runs, tokens = [], []
    for s, text in enumerate(sentences):
        run = []
        for pos, piece in enumerate(re.findall(r"[^\W_]+(?:['-][^\W_]+)*|\S", text)):
            if piece[0].isalnum():
                run.append((s, pos, piece))
            elif run:
                runs.append(run)
                run = []
        runs.append(run)
    found = {}
    for run in runs:
        for i, (s, pos, word) in enumerate(run):
            x = found.setdefault(word.lower(), {"n": 0, "cap": 0, "acr": 0, "s": [], "l": [], "r": []})
            x["n"] += 1
            x["cap"] += word[0].isupper() and pos > 0
            x["acr"] += len(word) > 1 and word.isupper() and word.isalpha()
            x["s"].append(s)
            x["l"] += [run[i - 1][2].lower()] if i else []
            x["r"] += [run[i + 1][2].lower()] if i + 1 < len(run) else []
    usable = [x["n"] for w, x in found.items() if re.fullmatch(r"[a-z'-]{3,}", w) and w not in P.STOPWORDS]
    mean, spread = (statistics.fmean(usable), statistics.pstdev(usable)) if usable else (0, 0)
    most = max(x["n"] for x in found.values())
    out = {}
    for w, x in found.items():
        share = lambda a: len(set(a)) / len(a) if a else 0.0
        related = 1 + (share(x["l"]) + share(x["r"])) * x["n"] / most
        cased, early = max(x["cap"], x["acr"]) / (1 + math.log(x["n"])), math.log(math.log(3 + statistics.median(x["s"])))
        out[w] = related * early / (cased + x["n"] / max(mean + spread, 1) / related + len(set(x["s"])) / (max(s for y in found.values() for s in y["s"]) + 1) / related)
    return out


def test_word_weights(spark):
    text = "The data pipeline reads data. Data pipelines, written in SQL, are fast. NASA data is large - data is data."
    corpus = docs(spark, text)
    want = slow_words([r.sentence for r in scoring.sentences(corpus).orderBy("sent_idx").collect()])
    got = {r.term: r.weight for r in keyphrases.word_weights(corpus).collect()}
    assert got.keys() == want.keys() and all(abs(got[w] - want[w]) < 1e-8 for w in want)


def test_keyphrases(spark):
    text = "Deep learning helps. Deep learning needs data centers. The data centers use deep learnings, and data centers grow."
    rows = keyphrases.keyphrases(docs(spark, text, None, "", "of the and"), top=3).collect()
    assert {r.doc_id for r in rows} == {0} and [r.rank for r in rows] == list(range(len(rows)))
    phrases = [r.phrase for r in rows]
    assert not ({"deep learning", "deep learnings"} <= set(phrases)) and any("data" in p or "deep" in p for p in phrases)
    assert all(a.score <= b.score for a, b in itertools.pairwise(rows))
    assert len(keyphrases.keyphrases(docs(spark, text), top=3, least_words=1).collect()) == 3


# ---- stored relations ----------------------------------------------------------------


def test_stored_relations_go_with_their_owner(spark):
    with Stored(spark) as stored:
        df = stored(spark.range(5))
        assert df.count() == 5
    with pytest.raises(Exception):  # noqa: B017
        spark.read.schema(df.schema).parquet(*df.inputFiles()).count()


# ---- graphs --------------------------------------------------------------------------


def test_rank_by_tables_is_rank_by_rows(spark, sf_dir):
    corpus = C.documents(spark, sf_dir).where("doc_id % 10 = 3")
    edges = graph.similarities(corpus)
    sizes = scoring.sentences(corpus).groupBy("doc_id").agg(F.count("*").alias("n"))
    got = {(r.doc_id, r.node): r.score for r in graph.rank_nodes(edges, sizes).collect()}
    of = {}
    for r in edges.collect():
        of.setdefault(r.doc_id, []).append((r.a, r.b, r.w))
    for r in sizes.collect():
        e = sorted(of.get(r.doc_id, []))
        a, b, w = (np.array([x[i] for x in e], dtype) for i, dtype in ((0, int), (1, int), (2, float)))
        want = graph.page_rank(r.n, a, b, w)
        assert all(abs(got[r.doc_id, i] - x) < 1e-5 for i, x in enumerate(want))
    assert len(got) == sum(r.n for r in sizes.collect())


def test_similar_terms(spark):
    texts = [f"the {a} runs quickly home today while the {b} sleeps soundly tonight" for a, b in (("horse", "doctor"), ("mare", "nurse"))] * 4
    corpus = docs(spark, *texts)
    found = {(r.term, r.similar) for r in graph.similar_terms(corpus, spark.createDataFrame([("horse",), ("doctor",), ("absent",)], "term string"), top=2).collect()}
    assert ("horse", "mare") in found and ("doctor", "nurse") in found and not any(t == "absent" for t, _ in found)
    hints = spark.createDataFrame([("horse", 2.0)], "term string, weight double")
    more = {r.term: r.weight for r in enrich.expand_hints(hints, mode="similar", docs=corpus).collect()}
    assert more["horse"] == 2.0 and 0 < more["mare"] <= 1.0
    with pytest.raises(ValueError):
        enrich.expand_hints(hints, mode="similar")
