"""Word groups counted where the text is."""

from __future__ import annotations

import random

from inkstone.functions import groups as G
from inkstone.functions import patterns as P
from inkstone.operators import extract


def slow(text, least):
    marked = [[]]
    for word in G._WORDS.findall(text):
        marked.append([]) if word.decode() in P.PHRASE_STOPWORDS else marked[-1].append(word)
    every = [b" ".join(run[i : i + k]) for run in marked for k in range(2, 6) for i in range(len(run) - k + 1)]
    return sorted((g, every.count(g), every.index(g)) for g in set(every) if every.count(g) >= least)


def test_repeated_groups_match_all_groups_counted():
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["red", "fox", "sun", "the", "by", "x"]) for _ in range(rng.randrange(60))).encode() for _ in range(200)]
    for text in [b"", b"one", b"red red red red red red red", b"the the", *texts]:
        for least in (1, 2, 3):
            assert sorted(G.repeated(text, least)) == slow(text, least)


def test_only_groups_of_repeated_parts_are_made(spark):
    """Every group of a text was made, sorted and compared by expressions that are interpreted."""
    text = "Blue moon rises. Été blue moon İs here. " + " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}z" for i in range(200))
    docs = spark.createDataFrame([(1, text), (1, "blue moon blue moon"), (2, None), (None, text), (3, "")], "doc_id long, text string")
    counts = extract.phrase_counts(docs)
    assert "ArrowEvalPython" in counts._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id or 0, r.phrase, r.n, r.ord, r.size) for r in counts.collect()) == [(0, "blue moon", 2, 0, 2), (1, "blue moon", 2, 0, 2), (1, "blue moon", 2, 0, 2)]
    assert {(r.doc_id, tuple(r.phrases)) for r in extract.phrases(docs).collect()} == {(1, ("blue moon",)), (2, ()), (None, ("blue moon",)), (3, ())}
