"""Structured facts: numbers, dates, outlines, phrases, terms, attributes."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import groups as G
from ..functions import hints as H
from ..functions import numbers as N
from ..functions import patterns as P
from ..functions import rows as W
from ..functions import runs as R
from ..functions import text as X
from . import scoring

STAT = "struct<stat_type:string,value:string,unit:string,phrase:string,context_sentence:string>"
#: Characters of context on either side of a fact; weight of facts per word.
CONTEXT, DENSITY = 25, 0.15


def _first(*groups: Column) -> Column:
    return F.coalesce(*(F.nullif(g, F.lit("")) for g in groups))


def sentence_stats(s: Column) -> Column:
    """Facts of one sentence: money, percent, date, duration, count, each in
    order. Sentences with a run of twenty digits have none.

    A kind's pattern runs only where its cheap gate is open; the groups are cut
    out of the hits, and places follow from the texts between the hits."""
    unit = lambda m: F.lower(m(2))
    shape = {
        "money": (lambda m: _first(m(1), m(2), m(3)), lambda m: F.lit("usd")),
        "percent": (lambda m: m(1), lambda m: F.lit("percent")),
        "date": (lambda m: m(0), lambda m: F.lit("date")),
        "duration": (lambda m: F.concat_ws(" ", m(1), unit(m)), lambda m: F.regexp_replace(unit(m), "s+$", "")),
        "count": (lambda m: m(1), unit),
    }
    none = F.array().cast(f"array<{STAT}>")

    def facts(name: str, value, of) -> Column:
        pattern, folded, gate = P.FACTS[name]
        pattern = f"(?{'i' if folded else ''}Ud){pattern}"

        def placed(hits: Column) -> Column:
            def step(state: Column, x: Column) -> Column:
                start = state["at"] + F.length(x["gap"])
                end = start + F.length(x["hit"])
                left = F.greatest(start - CONTEXT, F.lit(0))
                group = lambda g: F.regexp_extract(x["hit"], pattern, g) if g else x["hit"]
                fact = F.struct(F.lit(name).alias("stat_type"), value(group).alias("value"), of(group).alias("unit"), X.trim_ws(F.substring(s, left + 1, end + CONTEXT - left)).alias("phrase"), s.alias("context_sentence"))
                return F.struct(end.alias("at"), F.concat(state["out"], F.array(fact).cast(f"array<{STAT}>")).alias("out"))

            both = F.zip_with(F.slice(F.split(s, pattern, -1), 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
            return F.when(F.size(hits) > 0, F.aggregate(both, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda st: st["out"])).otherwise(none)

        found = X.let(F.regexp_extract_all(s, F.lit(pattern), F.lit(0)), placed)
        return F.when(s.rlike(gate), found).otherwise(none)

    kinds = [facts(name, *how) for name, how in shape.items()]
    some = s.rlike(P.ANY_DIGIT) & ~s.rlike(rf"(?U){P.LONG_RUN}")
    return F.when(some, F.concat(*kinds)).otherwise(none)


def word_stats(s: Column) -> Column:
    """Facts of one sentence, spelled-out numbers included: patterns run where
    digits stand for them, and values, phrases and places are those of the
    sentence itself. Sentences without such numbers have the facts of ``sentence_stats``."""
    none = F.array().cast(f"array<{STAT}>")

    def of(x: Column) -> Column:
        text, spans = x["text"], x["map"]

        def facts(name: str) -> Column:
            pattern, folded, _ = P.FACTS[name]
            pattern = f"(?{'i' if folded else ''}Ud){pattern}"

            def placed(hits: Column) -> Column:
                def step(state: Column, h: Column) -> Column:
                    start = state["at"] + F.length(h["gap"])
                    end = start + F.length(h["hit"])
                    left, right = N.back(start, spans, False), N.back(end, spans, True)
                    cut = lambda a, b: X.trim_ws(F.substring(s, a + 1, b - a))
                    group = lambda g: F.regexp_extract(h["hit"], pattern, g)
                    number = cut(left, N.back(start + F.length(group(1)), spans, True))
                    unit_at = N.back(end - F.length(group(2)), spans, False)
                    value, unit = {
                        "money": (cut(left, right), F.lit("usd")),
                        "percent": (number, F.lit("percent")),
                        "date": (cut(left, right), F.lit("date")),
                        "duration": (F.concat_ws(" ", number, F.lower(cut(unit_at, right))), F.regexp_replace(F.lower(group(2)), "s+$", "")),
                        "count": (number, F.lower(group(2))),
                    }[name]
                    near = F.greatest(left - CONTEXT, F.lit(0))
                    fact = F.struct(F.lit(name).alias("stat_type"), value.alias("value"), unit.alias("unit"), X.trim_ws(F.substring(s, near + 1, right + CONTEXT - near)).alias("phrase"), s.alias("context_sentence"))
                    return F.struct(end.alias("at"), F.concat(state["out"], F.array(fact).cast(f"array<{STAT}>")).alias("out"))

                both = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
                return F.when(F.size(hits) > 0, F.aggregate(both, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda st: st["out"])).otherwise(none)

            return X.let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)

        return F.concat(*map(facts, P.FACTS))

    def found(spans: Column) -> Column:
        return F.when(F.size(spans) == 0, sentence_stats(s)).otherwise(X.let(N.shadow(s, spans), of))

    return F.when(s.rlike(rf"(?U){P.LONG_RUN}"), none).otherwise(X.let(N.spans(s), found))


def _facts_of(word_names: bool):
    return word_stats if word_names else sentence_stats


def stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", convert_word_names: bool = False) -> DataFrame:
    """(id, stats): all facts of a document in order; no shuffle. With
    ``convert_word_names`` spelled-out numbers count as numbers."""
    sents = docs.select(id_col, X.split_sentences(text_col).alias("sents"))
    return sents.select(id_col, F.flatten(F.transform("sents", _facts_of(convert_word_names))).alias("stats"))


def _metadata(text_col: str) -> Column:
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = lambda p: F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    return F.struct(every(f"(?Ud){P.WHOLE_DATE}").alias("dates"), every(f"(?iUd){P.AMOUNT}").alias("amounts"), every(f"(?iUd){P.URL}").alias("urls"), F.array().cast("array<string>").alias("entities"))


def metadata(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", entities: bool = False) -> DataFrame:
    """(id, metadata): dates, amounts and urls of the whole text, each once, by
    first appearance; entities only where asked (``enrich.entities``)."""
    out = docs.select(id_col, _metadata(text_col).alias("metadata"))
    if entities:
        from .enrich import entities as names

        known = names(docs, id_col, text_col)
        out = out.join(known, id_col, "left").select(id_col, F.col("metadata").withField("entities", F.coalesce("entities", F.array().cast("array<string>"))).alias("metadata"))
    return out


def outline_of(sents: Column) -> Column:
    """(depth, name, representative_sentence) of a scored document's structural headings with
    a body and a name: the best sentence of each one's part, by score, then place."""

    def item(head: Column, body: Column) -> Column:
        best = F.array_min(F.transform(body, lambda x: F.struct((-x["composite"]).alias("by"), x["sent_idx"].alias("i"), x["sentence"].alias("t"))))
        return F.struct(X.heading_depth(head).alias("depth"), X.heading_name(head).alias("name"), best["t"].alias("representative_sentence"))

    def of(s: Column) -> Column:
        def parts(at: Column) -> Column:
            until = lambda k: F.coalesce(F.get(at, k + 1), F.size(s))
            return F.transform(at, lambda i, k: item(F.get(s, i)["sentence"], F.slice(s, i + 2, until(k) - i - 1)))

        heads = F.transform(F.filter(s, lambda x: X.is_structural_heading(x["sentence"])), lambda x: x["sent_idx"])
        return F.filter(X.let(heads, parts), lambda o: o["name"].isNotNull() & o["representative_sentence"].isNotNull())

    return X.let(sents, of)


def outline(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, outline): for each structural heading with a body, its depth, its
    name and the best sentence below it. Text before the first heading counts
    for none. All out of a document's own row."""
    return W.made(scoring.scored_documents(docs, id_col, text_col, separate=True), [id_col], outline_of(F.col("s")), "outline")


def toc(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, toc): the names of the outline."""
    return outline(docs, id_col, text_col).select(id_col, F.transform("outline", lambda o: o["name"]).alias("toc"))


def _fact_keys(facts: Column) -> Column:
    return F.array_distinct(F.transform(facts, lambda f: F.concat_ws("\x01", f["stat_type"], X.normalize_value(f["value"]))))


def _candidates(word_names: bool) -> Column:
    """(sent_idx, sentence, score, keys) of a scored document's sentences with
    facts; equal sentences count as one, at the first one's place, with all their facts."""
    some = F.filter("s", lambda x: x["sentence"].rlike(f"{P.ANY_DIGIT}|{N.ANY}" if word_names else P.ANY_DIGIT))
    found = F.transform(some, lambda x: F.struct(x["sentence"].alias("sentence"), x["sent_idx"].alias("sent_idx"), x["composite"].alias("composite"), x["words"].alias("words"), _facts_of(word_names)(x["sentence"]).alias("facts")))
    ordered = F.sort_array(F.filter(found, lambda x: F.size(x["facts"]) > 0))

    def of(a: Column) -> Column:
        def one(starts: Column):
            def row(i: Column, j: Column) -> Column:
                x, times = F.get(a, i), F.coalesce(F.get(starts, j + 1), F.size(a)) - i
                score = F.round(x["composite"] + DENSITY * (F.size(x["facts"]) * times) / F.greatest(x["words"], F.lit(1)), scoring.DECIMALS)
                return F.struct(x["sent_idx"].alias("sent_idx"), x["sentence"].alias("sentence"), score.alias("score"), _fact_keys(x["facts"]).alias("keys"))

            return F.transform(starts, row)

        return X.let(R.starts(a, lambda x: x["sentence"]), one)

    return X.let(ordered, of)


def fact_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", convert_word_names: bool = False) -> DataFrame:
    """(id, sent_idx, sentence, score, keys): sentences with facts; equal
    sentences count as one, at the first one's place, with all their facts."""
    return scoring.scored_documents(docs, id_col, text_col).select(id_col, F.inline(_candidates(convert_word_names)))


_STATE = "struct<n:int,keys:array<string>,chosen:array<int>>"


def _keep(order: Column, start: Column, quota: Column) -> Column:
    """Walk a ranking and keep candidates none of whose keys was kept before,
    ``quota`` of them; ``n`` counts those kept in this walk."""

    def step(st: Column, x: Column) -> Column:
        ok = (st["n"] < quota) & ~F.arrays_overlap(st["keys"], x["keys"]) & ~F.array_contains(st["chosen"], x["sent_idx"])
        return F.when(ok, F.struct((st["n"] + 1).alias("n"), F.concat(st["keys"], x["keys"]).alias("keys"), F.concat(st["chosen"], F.array(x["sent_idx"])).alias("chosen")).cast(_STATE)).otherwise(st)

    return F.aggregate(order, F.struct(F.lit(0).alias("n"), start["keys"].alias("keys"), start["chosen"].alias("chosen")).cast(_STATE), step)


def key_facts(docs: DataFrame, max_facts: int = 10, *, convert_word_names: bool = False, hints: H.Hints = None, hint_focus: float = 0.7, hint_mode: str = "soft", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key_facts): the best sentences with facts, no fact twice, in
    document order. With hints a share of the places goes to sentences that
    match."""
    prepared = H.prepare(hints)
    H.check(prepared, hint_focus, hint_mode)
    rows = scoring.scored_documents(docs, id_col, text_col).select(id_col, _candidates(convert_word_names).alias("c"))
    row = lambda x: F.struct((-x["score"]).alias("by"), x["sent_idx"].alias("sent_idx"), x["sentence"].alias("sentence"), x["keys"].alias("keys"), H.bonus(x["sentence"], prepared).alias("extra"))
    packed = rows.select(id_col, F.array_sort(F.transform("c", row)).alias("plain"))
    none = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("keys"), F.array().cast("array<int>").alias("chosen")).cast(_STATE)
    if prepared:
        hard = hint_mode == "hard"
        hinted = F.filter("plain", lambda x: x["extra"] > 0) if hard else F.col("plain")
        keyed = F.transform(hinted, lambda x: F.struct(F.round(x["by"] - x["extra"], scoring.DECIMALS).alias("by"), x["sent_idx"].alias("sent_idx"), x["sentence"].alias("sentence"), x["keys"].alias("keys"), x["extra"].alias("extra")))
        packed = packed.withColumn("hinted", F.array_sort(keyed))
        quota = H.share(max_facts, hint_focus)
        other = max_facts - quota
        packed = packed.withColumn("a", _keep(F.col("hinted"), none, F.lit(quota)))
        packed = packed.withColumn("b", _keep(F.col("plain"), F.col("a"), F.lit(other)))
        packed = packed.withColumn("c", _keep(F.col("hinted" if hard else "plain"), F.col("b"), quota - F.col("a.n")))
        last = "c"
        if not hard:
            packed = packed.withColumn("d", _keep(F.col("hinted"), F.col("c"), other - F.col("b.n")))
            last = "d"
        chosen = F.col(f"{last}.chosen")
    else:
        # without hints the first candidate stays even where the quota is zero
        chosen = _keep(F.col("plain"), none, F.lit(max(1, max_facts)))["chosen"]
    text_of = lambda i: F.get(F.filter("plain", lambda x: x["sent_idx"] == i), F.lit(0))["sentence"]
    return W.made(packed, [id_col], F.transform(F.array_sort(chosen), text_of), "key_facts")


def _groups(text: Column) -> Column:
    """Word groups of two to five in runs without stopwords, over the whole
    text, a run's shorter groups first."""
    marked = F.array_join(F.transform(X.letter_words(text), lambda w: F.when(w.isin(P.PHRASE_STOPWORDS), F.lit("|")).otherwise(w)), " ")
    runs = F.transform(F.filter(F.split(marked, r"\|"), lambda r: F.trim(r).contains(" ")), lambda r: F.split(F.trim(r), " "))

    def groups(run: Column) -> Column:
        n = F.size(run)
        sizes = F.sequence(F.lit(2), F.least(F.lit(5), n))
        return F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(run, i, k), " "))))

    return F.flatten(F.transform(runs, groups))


def _spread(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents, null texts empty, dealt out by their whole content, so that
    neither equal ids nor large files stay together."""
    return docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias(text_col)).repartition(F.xxhash64(F.col(id_col), F.col(text_col)))


def phrase_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 2) -> DataFrame:
    """(id, phrase, n, ord, size): word groups met at least ``least`` times."""
    rows = W.fields(_spread(docs, id_col, text_col).select(id_col, G.counted(F.col(text_col), least).alias("c")), [id_col], "c", "v")
    return rows.select(id_col, F.col("v").alias("phrase"), F.col("n").cast("long").alias("n"), F.col("at").alias("ord"), F.size(F.split("v", " ")).alias("size"))


def _words_in(phrase: Column) -> Column:
    return F.length(phrase) - F.length(F.translate(phrase, " ", "")) + 1


def _kept(groups: Column) -> Column:
    """(v, n) of repeated word groups by first appearance, without those that
    only occur inside a longer one. Where a longer one with the same count exists,
    one that is longer by one word does too: its parts less the first or the
    last word, with that count, are taken out."""
    key = lambda v, n: F.concat(v, F.lit("\x01"), n.cast("string"))

    def of(many: Column) -> Column:
        longer = F.filter(many, lambda x: _words_in(x["v"]) > 2)
        inner = F.flatten(F.transform(longer, lambda x: F.array(key(F.substr(x["v"], F.instr(x["v"], " ") + 1), x["n"]), key(F.left(x["v"], F.length(x["v"]) - F.instr(F.reverse(x["v"]), " ")), x["n"]))))
        in_order = F.transform(F.sort_array(F.transform(many, lambda x: F.struct(x["at"].alias("at"), x["v"].alias("v"), x["n"].alias("n")))), lambda x: key(x["v"], x["n"]))
        return F.transform(F.array_except(in_order, inner), lambda k: F.struct(F.substring_index(k, "\x01", 1).alias("v"), F.substring_index(k, "\x01", -1).cast("int").alias("n")))

    return X.let(F.filter(groups, lambda x: x["n"] >= 2), of)


def phrases(docs: DataFrame, keywords: str | None = None, *, hints: H.Hints = None, hint_mode: str = "soft", hint_focus: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, phrases): repeated word groups by first appearance; groups met once
    follow when they hold a keyword. With hints, matches come first, or alone.
    All of a document's phrases come out of one row."""
    prepared = H.prepare(hints)
    H.check(prepared, hint_focus, hint_mode)
    names = lambda a: F.transform(a, lambda x: x["v"])
    rows = _spread(docs, id_col, text_col)
    if keywords:
        wanted = F.array(*map(F.lit, sorted(set(re.findall("[a-z]{3,}", keywords.lower()))))).cast("array<string>")
        once = lambda c: names(F.sort_array(F.transform(F.filter(c, lambda x: (x["n"] == 1) & F.arrays_overlap(F.split(x["v"], " "), wanted)), lambda x: F.struct(x["at"].alias("at"), x["v"].alias("v")))))
        found = X.let(R.counted(_groups(F.col(text_col))), lambda c: F.concat(names(_kept(c)), once(c)))
    else:
        found = names(_kept(G.counted(F.col(text_col))))
    if prepared:
        match = lambda p: H.bonus(p, prepared) > 0
        first = lambda a: F.filter(a, match)
        found = X.let(found, lambda a: first(a) if hint_mode == "hard" else F.concat(first(a), F.filter(a, lambda p: ~match(p))))
    return rows.select(id_col, found.alias("phrases"))


SCORES = "array<struct<term:string,score:double>>"


def _word_scores(text: Column) -> Column:
    """(term, score) of a text's terms, counted in its own row."""

    def of(toks: Column) -> Column:
        raws = scoring.term_runs(toks, lambda p, w: F.struct(F.get(p, F.lit(0))["v"].alias("term"), (F.size(p) * w).alias("raw")))
        return X.let(raws, lambda a: X.let(F.array_max(F.transform(a, lambda x: x["raw"])), lambda most: F.transform(a, lambda x: F.struct(x["term"].alias("term"), (x["raw"] / most).alias("score")))))

    return X.let(F.transform(X.split_sentences(text), X.tokens), of).cast(SCORES)


def _phrase_scores(text: Column) -> Column:
    """(term, score) of a text's repeated phrases, counted in its own row."""
    raw = lambda x: x["n"] * _words_in(x["v"])
    return X.let(_kept(G.counted(text)), lambda k: X.let(F.array_max(F.transform(k, raw)), lambda most: F.transform(k, lambda x: F.struct(x["v"].alias("term"), (raw(x) / most).alias("score"))))).cast(SCORES)


def word_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, score): a document's terms by frequency and rarity among its
    sentences, the largest 1."""
    return W.fields(docs.select(id_col, _word_scores(F.col(text_col)).alias("w")), [id_col], "w", "term")


def phrase_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, score): repeated phrases by count times words, the largest 1."""
    return W.fields(_spread(docs, id_col, text_col).select(id_col, _phrase_scores(F.col(text_col)).alias("k")), [id_col], "k", "term")


def term_scores(docs: DataFrame, n: int = 10, kinds: Sequence[str] = ("words", "phrases"), *, hints: H.Hints = None, hint_focus: float = 0.7, hint_mode: str = "soft", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rank, term, score, kind): the ``n`` best words and phrases, ties by term."""
    if not kinds or set(kinds) - {"words", "phrases"}:
        raise ValueError(f"kinds must be words and phrases; got {kinds!r}")
    prepared = H.prepare(hints)
    H.check(prepared, hint_focus, hint_mode)

    def ranked(scores: Column, kind: str) -> Column:
        if prepared and hint_mode == "hard":
            scores = F.filter(scores, lambda x: H.bonus(x["term"], prepared) > 0)
        extra = (lambda x: H.bonus(x["term"], prepared)) if prepared and hint_mode != "hard" else (lambda x: F.lit(0.0))
        total = lambda x, score: F.struct((-F.round(score, scoring.DECIMALS)).alias("by"), x["term"].alias("term"), score.alias("score"), F.lit(kind).alias("kind"))
        return F.transform(scores, lambda x: X.let(x["score"] + extra(x), lambda score: total(x, score)))

    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = [ranked(of(text), kind) for name, of, kind in (("words", _word_scores, "word"), ("phrases", _phrase_scores, "phrase")) if name in kinds]
    rows = docs.select(id_col, F.slice(F.array_sort(F.concat(*parts)), F.lit(1), F.lit(max(n, 0))).alias("t"))
    rows = W.numbered(rows, [id_col], "t", "i", "x")
    return rows.select(id_col, (F.col("i") + 1).alias("rank"), "x.term", "x.score", "x.kind")


def top_terms(docs: DataFrame, n: int = 10, kinds: Sequence[str] = ("words", "phrases"), *, id_col: str = "doc_id", text_col: str = "text", **hinted) -> DataFrame:
    """(id, terms): the terms of ``term_scores`` in order."""
    rows = term_scores(docs, n, kinds, id_col=id_col, text_col=text_col, **hinted)
    listed = rows.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t")).select(F.col(id_col).alias("_of"), F.transform("t", lambda x: x["term"]).alias("t"))
    return docs.select(id_col).join(listed, F.col(id_col) == F.col("_of"), "left").select(id_col, F.coalesce("t", F.array().cast("array<string>")).alias("terms"))


CORRELATED = "array<struct<k:int,entity:string,number:string,polarity:string,sentence:string>>"


def _correlated(docs: DataFrame, id_col: str, text_col: str, word_names: bool) -> DataFrame:
    """(id, c): for each document its facts (k, entity, number, polarity, sentence),
    each with what it is about. One row's work: facts, phrases and repeated words
    are arrays of the same row."""
    # what several facts look up is bound by ``let``: a column of a projection below could be worked out again for each of them
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # a Python function cannot stand in a lambda
    rows = rows.select(id_col, "_text", G.counted(F.col("_text")).alias("_groups"))
    text = F.col("_text")
    often = F.filter(R.counted(F.filter(X.letter_words(text), lambda w: ~w.isin(P.PHRASE_STOPWORDS))), lambda x: x["n"] >= 2)
    many = F.struct(F.transform(_kept(F.col("_groups")), lambda x: x["v"]).alias("phrases"), F.transform(often, lambda x: x["v"]).alias("v"), F.transform(often, lambda x: x["n"]).alias("n"))

    def word(sentence: Column, m: Column) -> Column:
        ranked = F.transform(X.letter_words(sentence), lambda w, i: X.let(F.array_position(m["v"], w).cast("int"), lambda p: F.when(p > 0, F.struct((-F.get(m["n"], p - 1)).alias("by"), i.alias("at"), w.alias("w")))))
        return F.array_min(F.array_compact(ranked))["w"]

    def phrase(sentence: Column, m: Column) -> Column:
        return X.let(F.lower(sentence), lambda low: F.get(F.filter(m["phrases"], lambda p: F.forall(F.split(p, " "), lambda w: low.contains(w))), F.lit(0)))

    def fact(f: Column, k: Column, m: Column) -> Column:
        return F.struct(k.alias("k"), F.coalesce(phrase(f["context_sentence"], m), word(f["context_sentence"], m)).alias("entity"), f["value"].alias("number"), f["context_sentence"].alias("sentence"))

    def met(named: Column) -> Column:
        twice = F.transform(F.filter(R.counted(F.transform(named, lambda x: x["entity"])), lambda x: x["n"] >= 2), lambda x: x["v"])
        full = lambda x: F.struct(x["k"].alias("k"), x["entity"].alias("entity"), x["number"].alias("number"), X.polarity(x["sentence"]).alias("polarity"), x["sentence"].alias("sentence"))
        return X.let(twice, lambda t: F.transform(F.filter(named, lambda x: F.array_contains(t, x["entity"])), full))

    def of(facts: Column) -> Column:
        named = lambda m: F.filter(F.transform(facts, lambda f, k: fact(f, k, m)), lambda x: x["entity"].isNotNull())
        # two facts at least name an entity twice; phrases of other texts are not looked for
        return F.when(F.size(facts) >= 2, X.let(many, lambda m: X.let(named(m), met))).otherwise(F.array().cast(CORRELATED))

    facts = F.flatten(F.transform(X.split_sentences("_text"), _facts_of(word_names)))
    return rows.select(id_col, X.let(facts, of).alias("c"))


def correlated_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", convert_word_names: bool = False) -> DataFrame:
    """(id, k, entity, number, polarity, sentence): each fact with what it is
    about: the first repeated phrase whose words are all in its sentence, else
    the sentence's most frequent repeated word. Entities with one fact drop out."""
    return W.fields(_correlated(docs, id_col, text_col, convert_word_names), [id_col], "c", "k")


def correlate_facts(docs: DataFrame, *, convert_word_names: bool = False, hints: H.Hints = None, hint_focus: float = 0.7, hint_mode: str = "soft", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, correlated_facts) in document order; with hints, matches first, or alone."""
    prepared = H.prepare(hints)
    H.check(prepared, hint_focus, hint_mode)
    rows = _correlated(docs, id_col, text_col, convert_word_names)
    found = F.col("c")
    if prepared:
        match = lambda x: H.bonus(F.concat_ws(" ", x["entity"], x["number"]), prepared) > 0
        first = F.filter("c", match)
        found = first if hint_mode == "hard" else F.concat(first, F.filter("c", lambda x: ~match(x)))
    item = lambda x: F.struct(*(x[n].alias(n) for n in ("entity", "number", "polarity", "sentence")))
    return rows.select(id_col, F.transform(found, item).alias("correlated_facts"))


ATTRIBUTE = "array<struct<key:string,label:string,value:string,value_type:string,source:string,evidence:string,confidence:double>>"


def attributes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, attributes): ``**Label:** value`` pairs, then ``Label: value``
    lines without bold marks; a key and value once, at its first place."""
    return _attributed(docs, id_col, text_col, ()).select(id_col, "attributes")


def _attributed(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    bold = f"(?sUd){P.BOLD_ATTRIBUTE}"
    bolds = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(bold), F.lit(g)).alias(f"_{g}") for g in range(3)))
    line = f"(?Ud){P.LINE_ATTRIBUTE}"
    lines = F.filter(F.split(text, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]", -1), lambda x: ~x.contains("**") & x.rlike(line))
    tidy = lambda x: X.fold_ws(F.regexp_replace(x, r"^[ *]+|[ *]+$", ""))

    def made(label: Column, value: Column, evidence: Column, source: str, sure: float) -> Column:
        label, value = tidy(label), tidy(value)
        key = X.normalize_key(label)
        return F.struct(key.alias("key"), label.alias("label"), value.alias("value"), X.value_type(key, value).alias("value_type"), F.lit(source).alias("source"), X.compact(evidence).alias("evidence"), F.lit(sure).alias("confidence"))

    found = F.concat(
        F.transform(bolds, lambda m: made(m["_1"], m["_2"], m["_0"], "header_kv", 0.99)),
        F.transform(lines, lambda x: made(F.regexp_extract(x, line, 1), F.regexp_extract(x, line, 2), x, "line_kv", 0.9)),
    ).cast(ATTRIBUTE)
    found = F.filter(found, lambda a: (a["label"] != "") & (a["value"] != "") & (a["key"] != "") & (F.length(a["key"]) <= 80))
    # equal keys and values side by side, the first of each ahead; then back in order
    rows = docs.select(id_col, *carry, F.array_sort(F.transform(found, lambda a, i: F.struct(a["key"].alias("key"), a["value"].alias("value"), i.alias("i"), a.alias("a")))).alias("a"))
    new = lambda x, i: F.coalesce((F.get(F.col("a"), i - 1)["key"] != x["key"]) | (F.get(F.col("a"), i - 1)["value"] != x["value"]), F.lit(True))
    first = F.array_sort(F.transform(F.filter("a", new), lambda x: F.struct(x["i"].alias("i"), x["a"].alias("a"))))
    return rows.select(id_col, *carry, F.transform(first, lambda x: x["a"]).alias("attributes"))


def _records(attributes: Column, stats: Column) -> Column:
    record = lambda p, o, t, e, c: F.struct(F.lit("document").alias("subject"), p.alias("predicate"), o.alias("object"), F.lit(t).alias("fact_type"), e.alias("evidence"), c.alias("confidence"))
    return F.concat(
        F.transform(attributes, lambda a: record(a["key"], a["value"], "attribute", a["evidence"], a["confidence"])),
        F.transform(stats, lambda s: record(s["stat_type"], s["value"], "numeric", X.compact(s["context_sentence"]), F.lit(0.8))),
    )


def _promotions(attributes: Column, prefix: str) -> Column:
    path = lambda a: F.concat(F.lit(f"{prefix}.attributes."), a["key"], F.lit(".value"))
    return F.transform(attributes, lambda a: F.struct(path(a).alias("path"), a["key"].alias("key"), a["value_type"].alias("value_type"), F.lit(True).alias("promote"), a["confidence"].alias("confidence")))


def details(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: str = "report") -> DataFrame:
    """(id, stats, metadata, attributes, fact_records, promotions): everything
    that a row says by itself, each worked out once; no shuffle."""
    split = docs.select(id_col, text_col, F.flatten(F.transform(X.split_sentences(text_col), sentence_stats)).alias("stats"), _metadata(text_col).alias("metadata"))
    rows = _attributed(split, id_col, text_col, ("stats", "metadata"))
    return rows.select(id_col, "stats", "metadata", "attributes", _records(F.col("attributes"), F.col("stats")).alias("fact_records"), _promotions(F.col("attributes"), prefix).alias("promotions"))


def fact_records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fact_records): attributes and numbers as subject, predicate, object."""
    return details(docs, id_col, text_col).select(id_col, "fact_records")


def promotion_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: str = "report") -> DataFrame:
    """(id, promotions): for each attribute the JSON path under which a report has it."""
    return attributes(docs, id_col, text_col).select(id_col, _promotions(F.col("attributes"), prefix).alias("promotions"))
ATTACHED = {"stats": stats, "outline": outline, "metadata": metadata, "phrases": lambda d, i, t: phrases(d, id_col=i, text_col=t), "correlated_facts": lambda d, i, t: correlate_facts(d, id_col=i, text_col=t)}
