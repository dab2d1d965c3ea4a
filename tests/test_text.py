"""Text functions against plain Python statements of the same rules."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from inkstone.functions import hints as H
from inkstone.functions import text as X


def apply(spark, function, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    return [r.x for r in rows.select("i", function(F.col("t")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "text,want",
    [
        (None, []),
        ("", []),
        (" \n ", []),
        ("One. Two! three? Four", ["One.", "Two! three?", "Four"]),
        ("Dr. Who met Mr. X. He left.", ["Dr. Who met Mr. X.", "He left."]),
        ("Pi is 3.14. No. 5 is alive. The U.S. Army came.", ["Pi is 3.14.", "No. 5 is alive.", "The U.S. Army came."]),
        ("a.co. Next. co.uk. More", ["a.co.", "Next. co.uk.", "More"]),
        ("no end here\n\nnew part", ["no end here", "new part"]),
        ("A\x00b. C", ["Ab.", "C"]),
        ("x y. Z\r\n\r\nw", ["x y.", "Z", "w"]),
    ],
)
def test_sentences(spark, text, want):
    assert apply(spark, X.split_sentences, [text]) == [want]


def test_trim_and_fold(spark):
    texts = [" a\t b\n", "  x ", "", "a", " \n\t "]
    assert apply(spark, X.trim_ws, texts) == [t.strip() for t in texts]
    assert apply(spark, X.fold_ws, texts) == [" ".join(t.split()) for t in texts]


def test_think(spark):
    assert apply(spark, X.strip_think, [None, "a <think>x\ny</think>\n b <think>", "<think></think>"]) == ["", "a b <think>", ""]


@pytest.mark.parametrize(
    "line,structural,heading,name,depth",
    [
        ("## Key Findings", True, True, "Key Findings", 2),
        ("TERMS OF USE:", True, True, "TERMS OF USE", 1),
        ("Notes:", True, True, "Notes", 1),
        ("Bare Title", True, True, "Bare Title", 1),
        ("3. Scope", True, True, "Scope", 1),
        ("Plan — draft of May", True, True, "Plan", 1),
        ("yes, ok.", False, True, "yes, ok.", 1),
        ("This sentence has enough words to be text.", False, False, "This sentence has enough words to be text.", 1),
        ("   ", False, False, None, 1),
        ("::", True, True, None, 1),
    ],
)
def test_headings(spark, line, structural, heading, name, depth):
    got = [apply(spark, f, [line])[0] for f in (X.is_structural_heading, X.is_heading, X.heading_name, X.heading_depth)]
    assert got == [structural, heading, name, depth]


def test_separate_headings(spark):
    assert apply(spark, X.separate_headings, ["# T\nbody text is here now\n\n## U\n\nx", "a", ""]) == ["# T\n\nbody text is here now\n\n## U\n\nx", "a", ""]


def test_truncate_and_compact(spark):
    assert apply(spark, lambda c: X.truncate(c, 5), ["abcde", "abcdef", ""]) == ["abcde", "ab...", ""]
    assert apply(spark, lambda c: X.truncate(c, -4), ["abc"]) == ["..."]
    assert apply(spark, lambda c: X.compact(c, 6), ["a  b", "abcd efgh"]) == ["a b", "abcd..."]


def test_tokens_follow_word_bounds(spark):
    assert apply(spark, X.tokens, ["The cats' caféteria ran_fast abc1 naïve dogs", None]) == [["cats", "dogs"], None]
    assert apply(spark, X.letter_words, ["café Über ab"]) == [["caf", "ber"]]


def test_keys_and_values(spark):
    assert apply(spark, X.normalize_key, [" R&D -- Cost (USD) "]) == ["r_and_d_cost_usd"]
    assert apply(spark, X.normalize_value, ["Five-Day  a/b_c"]) == ["five day a b c"]
    got = [apply(spark, lambda c, k=k: X.value_type(F.lit(k), c), [v])[0] for k, v in [("a", "1999"), ("a", "$5"), ("a", "www.x"), ("citation", "x"), ("a", "12-345"), ("a", "x, y"), ("a", "x")]]
    assert got == ["year", "money", "url", "citation", "identifier", "list", "text"]


def test_hints(spark):
    assert H.prepare([" Big  Deal", "", 5, "x"]) == [("big deal", 1.0), ("x", 1.0)]
    assert H.prepare({"A": 2}) == [("a", 2.0)] and H.prepare(None) == []
    assert [H.share(500, 0.7), H.share(5, 0.5), H.share(3, 0.5)] == [350, 3, 2]
    hints = H.prepare({"deal": 1.0, "c++": 2.0})
    assert apply(spark, lambda c: H.bonus(c, hints), ["Deal deal DEAL deal ideal", "none"]) == [1.5, 0.0]
    for bad in ({"focus": 2.0, "mode": "soft"}, {"focus": 0.5, "mode": "odd"}):
        with pytest.raises(ValueError):
            H.check(hints, **bad)


def test_adversarial_texts_stay_fast(spark):
    texts = ["1" * 50_000 + " tons", " " * 100_000 + "x", "\n" * 50_000, "Dr." * 30_000, "a:" * 30_000, ("word " * 20 + ". ") * 9_000]
    for function in (X.split_sentences, X.strip_think, X.clean_text, X.is_heading, X.trim_ws, X.tokens):
        began = time.time()
        apply(spark, function, texts)
        assert time.time() - began < 30, function


def test_sentences_random(spark):
    rng = random.Random(1)
    bits = ["a", "B", ".", " ", "!", "\n", "Mr", "No", "1", "co", "é", "U.S"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(500)]
    for text, got in zip(texts, apply(spark, X.split_sentences, texts)):
        assert all(s.strip() == s and s for s in got)
        assert "".join("".join(got).split()) == "".join(text.split())


def test_sql_functions(spark):
    from inkstone.functions import sql

    names = sql.register(spark, "ink_")
    texts = ["## A title", "Dr. No grew 3.5 percent. It ended.\n\nNew part of the text goes here", "", "<think>a</think> **b** R&D: x", "The cats sat."]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").createOrReplaceTempView("ink_texts")
    other = {**sql.SCALARS, "text_terms": X.tokens, "split_sentences": X.split_sentences, "split_paragraphs": X.split_paragraphs, "trim_text": X.trim_ws}
    assert {n.removeprefix("ink_") for n in names} == set(other)
    for name in names:
        got = [r.x for r in spark.sql(f"select i, {name}(t) as x from ink_texts order by i").collect()]
        assert got == apply(spark, other[name.removeprefix("ink_")], texts), name
