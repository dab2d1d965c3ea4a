"""Operator 11: folding, matching against brute force, exceptions, held-out accuracy, edge cases."""

from __future__ import annotations

import random

import numpy as np
import pytest

from inkstone.llm import toxicity
from inkstone.llm.queries import QUERIES
from inkstone.llm.toxicity import Lexicon

DOCS = "doc_id long, text string, score string, toxicity int"
#: The smallest tables have too few labels to learn from.
LARGER = "/root/testdata/sf0.1"


def words(text):
    return toxicity.fold(text)[0].split()


def test_fold():
    assert words("You STUPID idiot!!") == ["you", "stupid", "idiot"]
    plain = words("loser")
    for spelled in ("l0ser", "1oser", "ⅼoser", "ｌｏｓｅｒ", "lоsеr", "lo​ser", "l.o.s.e.r", "LO$ER", "l*o*s*e*r"):
        assert words(spelled) == plain, spelled
    assert toxicity.bare(toxicity.fold("ídiot")[0]) == toxicity.fold("idiot")[0]
    assert words("call 555 1234") == ["caii", "555", "1234"]  # numbers stay numbers
    assert toxicity.fold(None) == toxicity.fold("") and toxicity.fold("") == ("  ", 0)
    assert words("a.b 3.14 x-ray well-known") == ["a", "b", "3", "14", "x", "ray", "weii", "known"]


def slow_hits(lexicon, folded):
    """Every word against every term, and every phrase by ``find``."""
    spared = []
    for phrase in lexicon.exceptions:
        at = folded.find(phrase)
        while at >= 0:
            spared.append((at, at + len(phrase)))
            at = folded.find(phrase, at + 1)
    out = []
    for i, char in enumerate(folded):
        if char == " ":
            terms = [(w, len(t)) for t, w in lexicon.terms.items() if folded.startswith(t, i + 1)]
            if terms:
                weight = max(terms)[0]
                if not any(s <= i + 1 < e for s, e in spared):
                    out.append((i + 1, weight))
    return out


def test_hits_match_brute_force():
    rng = random.Random(3)
    lexicon = Lexicon({"ab": 1.0, "abc": 2.0, "ba ": 3.0, "c": 0.5}, [" ab ba ", " c ab "])
    automaton = lexicon.automaton()
    for _ in range(500):
        text = f" {' '.join(rng.choice(['ab', 'abc', 'ba', 'bab', 'c', 'x', 'cab']) for _ in range(rng.randrange(0, 9)))} "
        assert [(s, w) for s, _, w in toxicity.hits(automaton, text)] == slow_hits(lexicon, text), text


def test_given_lexicon(spark):
    lexicon = Lexicon.of({"trash": 2.0, "idiot*": 3.0}, ["trash can"])
    rows = [(1, "take the trash can out", "x", 1), (2, "you trash", "x", 1), (3, "1d10tic", "x", 1), (4, None, "x", 1), (5, "", "x", 1), (None, "idiots", "x", 1), (2, "you trash", "x", 1), (6, "trash " + "fine words here " * 100_000, "x", 1)]
    got = {(r.doc_id, r.n_hits, r.score) for r in toxicity.toxicity(spark.createDataFrame(rows, DOCS), lexicon).collect()}
    by = {i: s for i, _, s in got}
    assert {(i, n) for i, n, _ in got} == {(1, 0), (2, 1), (3, 1), (4, 0), (5, 0), (None, 1), (6, 1)}
    assert by[4] == by[5] == by[1] < by[6] < by[2] < 1
    kept = toxicity.with_toxicity(spark.createDataFrame(rows, DOCS), lexicon, name="verdict")
    assert kept.columns == ["doc_id", "text", "score", "toxicity", "verdict"] and kept.count() == len(rows)


def test_marks_of_letters_do_not_hide_words():
    automaton = Lexicon.of({"idiot": 1.0}).automaton()
    text = toxicity.fold("Ein ídiot, schöner idiot; étés")[0]
    assert [text[s:e].strip() for s, e, _ in toxicity.hits(automaton, text)] == ["ídiot", "idiot"]


def made(n, seed):
    """Clean and toxic texts with copies, and labels; the insults are made up and often spelled otherwise."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("bdgkmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 200))]
        for _ in range(rng.randrange(2, 6) * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(["zonkhead", "flurbs", "ZONKED", "zоnkhead", "z0nkhead"]))
        if i % 10 == 7 and not toxic:
            text.append("no zonk zone")
        if i > 20 and i % 7 == 0 and not toxic:
            text = docs[i - 7][1].split() if labels[i - 7][1] == 0 else text
        docs.append((i, " ".join(text), "x", 1))
        labels.append((i, int(toxic)))
    return docs, labels


def test_learned(spark):
    docs, labels = made(1_500, 4)
    frame = spark.createDataFrame(docs, DOCS)
    given = spark.createDataFrame([*labels, *labels[:50], (3, 1), (None, 1), (5_000, 1), (8, None)], "doc_id long, toxic int")
    learned = toxicity.learn(frame.where(~toxicity.held_out()), given.where(~toxicity.held_out()))
    assert any(t.startswith("zonk") for t in learned.terms) and len(learned.terms) < 8
    truth = dict(labels)
    got = [r for r in toxicity.toxicity(frame, learned).collect() if r.held_out]
    assert all(r.predicted == truth[r.doc_id] for r in got) and len(got) > 400


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    for docs in (empty, spark.createDataFrame([(1, "some text", "x", 1)], DOCS)):
        learned = toxicity.learn(docs, labels)
        assert not learned.known and toxicity.toxicity(empty, learned).collect() == []
    got = toxicity.toxicity(spark.createDataFrame([(1, "some text", "x", 1), (1, None, "x", 1)], DOCS), learned).collect()
    assert [(r.score, r.predicted) for r in got] == [(0.0, 0)] * 2


def test_query(spark):
    rows = QUERIES["op11_toxicity"](spark, LARGER).join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    tested = [r for r in rows if r.held_out and r.toxic is not None]
    hit = sum(r.predicted and r.toxic for r in tested)
    assert hit / sum(r.predicted for r in tested) >= 0.9 and hit / sum(r.toxic for r in tested) >= 0.9


def test_curve_finds_the_border():
    x = np.array([[0.0, 0.0]] * 50 + [[2.0, 3.0]] * 5)
    a, b, c = toxicity.curve(x, np.array([0] * 50 + [1] * 5))
    assert a < -1 and a + 2 * b + 3 * c > 1


@pytest.mark.parametrize("counts, kept", [({"los": (20, 9, 20, 9, 20, 9), "lostra": (19, 0, 19, 0, 19, 0)}, ["lostra"]), ({"abc": (9, 0, 9, 0, 9, 0), "abcd": (9, 0, 9, 0, 9, 0), "abcd ": (9, 0, 9, 0, 9, 0)}, ["abcd"]), ({"abc": (9, 0, 9, 0, 9, 0), "abcd": (5, 0, 5, 0, 5, 0)}, ["abc"])])
def test_choose(counts, kept):
    assert toxicity.choose(counts, lambda a, b: toxicity.surprise(a, b, 0.5) >= 4) == kept
