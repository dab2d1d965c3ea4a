"""Named queries over the driver's tables and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hints as H
from ..functions import patterns as P
from ..functions import rows as W
from ..functions import text as X
from ..operators import enrich, evals, extract, graph, pins, report, scoring, selection
from ..operators.summarize import extract_keyword, summarize
from . import corpora as C
from . import oracle as O
from .corpora import quoted as q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Hints of the queries that lean towards some sentences.
HINTS = {"items": 1.0, "records": 2.0}


def query(sql: str | None = None):
    """Register a function under its own name, with the SQL that agrees."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def lines(c: str) -> F.Column:
    return F.array_join(c, "\n")


# ---- preparing text ------------------------------------------------------------------


@query(rf"select doc_id, {O.trim(O.replace_all('text', r'(?s)<think>.*?</think>\s*', chr(39) * 2))} as text from ({C.THOUGHTS})")
def strip_think(spark, sf_dir):
    return C.thoughts(spark, sf_dir).select("doc_id", X.strip_think("text").alias("text"))


def _clean_sql(x: str) -> str:
    steps = [r"\*{1,3}", r"_{1,3}", r"(?m)^#{1,6}\s*", r"(?m)^-{3,}$", r"(?m)^\s*[-*+]\s+", r"(?m)^\s*\d+\.\s+", rf"(?i)\b(?:{P.FILLER_PHRASES})\b", rf"(?i)\b(?:{P.FILLER_WORDS})\b", *(f"(?i){p}" for p in P.CRM_LINES)]
    for pattern in steps:
        x = O.replace_all(x, pattern, "''")
    x = f"lower({x})"
    for pattern, to in ((r"[ \t]+", "' '"), (r"\n\s*\n+", "chr(10)"), (r"(?m)^\s+", "''"), (r"(?m)\s+$", "''"), (r"(?m)^\s*$\n?", "''")):
        x = O.replace_all(x, pattern, to)
    return O.trim(x)


@query(f"select doc_id, {_clean_sql('text')} as text from ({C.NARRATIVES})")
def clean_text(spark, sf_dir):
    return C.narratives(spark, sf_dir).select("doc_id", X.clean_text("text").alias("text"))


@query(f"select doc_id, {_clean_sql('text')} as text from ({C.PAGE_TEXT})")
def clean_pages(spark, sf_dir):
    return C.page_text(spark, sf_dir).select("doc_id", X.clean_text("text").alias("text"))


def _sentence_sql(corpus: str, separate: bool = False) -> str:
    return f"select doc_id, unnest(s) as sentence, generate_subscripts(s, 1) - 1 as sent_idx from (select doc_id, {O.sentences(O.separated('text') if separate else 'text')} as s from ({corpus}))"


@query(f"select doc_id, cast(sent_idx as integer) as sent_idx, sentence from ({_sentence_sql(C.DOCUMENTS)})")
def sentences(spark, sf_dir):
    return scoring.sentences(C.documents(spark, sf_dir))


@query(f"select doc_id, cast(sent_idx as integer) as sent_idx, sentence from ({_sentence_sql(C.NARRATIVES, True)})")
def sentences_with_headings(spark, sf_dir):
    return scoring.sentences(C.narratives(spark, sf_dir), separate=True)


def _short_lines(x: str) -> str:
    marked = O.replace_all(O.replace_all(x, r"\n+", "'. '"), r"([.!?])\s+", r"'\1' || chr(3)")
    return f"list_filter(list_transform(string_split({marked}, chr(3)), lambda p: {O.trim('p')}), lambda p: length(p) > 20)"


@query(f"select doc_id, cast(generate_subscripts(s, 1) - 1 as integer) as i, unnest(s) as sentence from (select doc_id, {_short_lines('text')} as s from documents)")
def keyword_sentences(spark, sf_dir):
    return C.documents(spark, sf_dir).select("doc_id", F.posexplode(X.split_lines_to_sentences("text")).alias("i", "sentence"))


@query(f"select doc_id, cast(generate_subscripts(s, 1) - 1 as integer) as para_idx, unnest(s) as paragraph from (select doc_id, {O.paragraphs('text')} as s from ({C.NARRATIVES}))")
def paragraphs(spark, sf_dir):
    return scoring.paragraphs(C.narratives(spark, sf_dir))


@query(f"select doc_id, cast(generate_subscripts(s, 1) - 1 as integer) as para_idx, unnest(s) as paragraph from (select doc_id, {O.paragraphs('text', 50)} as s from ({C.PAGE_TEXT}))")
def page_chunks(spark, sf_dir):
    return scoring.paragraphs(C.page_text(spark, sf_dir), least=50)


@query(f"select doc_id, {O.separated('text')} as text from ({C.NARRATIVES})")
def separate_headings(spark, sf_dir):
    return C.narratives(spark, sf_dir).select("doc_id", X.separate_headings("text").alias("text"))


_COMPACT = f"case when length({O.fold('text')}) <= 260 then {O.fold('text')} else regexp_replace({O.fold('text')}[1:259], '\\s+$', '') || '...' end"


@query(f"select doc_id, {O.truncated('text', '120')} as cut, {_COMPACT} as compact from documents")
def truncate_and_compact(spark, sf_dir):
    return C.documents(spark, sf_dir).select("doc_id", X.truncate("text", 120).alias("cut"), X.compact("text").alias("compact"))


@query(
    "select p_partkey, trim(regexp_replace(replace(lower(trim(p_name || ' & ' || p_type)), '&', ' and '), '[^a-z0-9]+', '_', 'g'), '_') as key,"
    f" {O.fold(O.replace_all('lower(p_brand || p_type)', '[-_/#]+'.replace('#', ''), chr(39) + ' ' + chr(39)))} as value from part"
)
def normalized_keys(spark, sf_dir):
    part = C.table(spark, sf_dir, "part")
    return part.select("p_partkey", X.normalize_key(F.concat_ws(" & ", "p_name", "p_type")).alias("key"), X.normalize_value(F.concat("p_brand", "p_type")).alias("value"))


@query(f"with s as ({_sentence_sql(C.DOCUMENTS)}), t as (select doc_id, sent_idx, {O.tokens('sentence')} as t from s) select doc_id, cast(sent_idx as integer) as sent_idx, cast(generate_subscripts(t, 1) - 1 as integer) as pos, unnest(t) as term from t")
def tokens(spark, sf_dir):
    return scoring.tokens(C.documents(spark, sf_dir))


# ---- predicates ----------------------------------------------------------------------


@query(
    f"select doc_id, cast(sent_idx as integer) as sent_idx, {O.structural('sentence')} as structural, {O.heading('sentence')} as heading, coalesce({O.heading_name('sentence')}, '') as name,"
    f" cast(greatest(length(regexp_extract(sentence, '^\\s*(#+)\\s+', 1)), 1) as integer) as depth, regexp_matches(sentence, {q('(?i)' + P.CUE)}) as cue,"
    f" regexp_matches(sentence, '\\p{{Nd}}') as digit, regexp_matches(lower(sentence), {q(P.CAUSAL)}) as causal, regexp_matches(sentence, {q(P.LONG_RUN)}) as long_run from ({_sentence_sql(C.NARRATIVES, True)})"
)
def sentence_predicates(spark, sf_dir):
    s = F.col("sentence")
    return scoring.sentences(C.narratives(spark, sf_dir), separate=True).select(
        "doc_id", "sent_idx", X.is_structural_heading(s).alias("structural"), X.is_heading(s).alias("heading"), F.coalesce(X.heading_name(s), F.lit("")).alias("name"), X.heading_depth(s).alias("depth"),
        s.rlike(f"(?iU){P.CUE}").alias("cue"), s.rlike(r"(?U)\d").alias("digit"), F.lower(s).rlike(P.CAUSAL).alias("causal"), s.rlike(rf"(?U){P.LONG_RUN}").alias("long_run"),
    )


def _polarity_sql(x: str) -> str:
    w = f"regexp_extract_all(lower({x}), '[a-z]+')"
    return f"case when list_has_any({w}, {O.words_in(P.GROWTH)}) then 'growth' when list_has_any({w}, {O.words_in(P.DECLINE)}) then 'decline' else 'absolute' end"


@query(f"select doc_id, cast(sent_idx as integer) as sent_idx, {_polarity_sql('sentence')} as polarity from ({_sentence_sql(C.NARRATIVES)})")
def polarity(spark, sf_dir):
    return scoring.sentences(C.narratives(spark, sf_dir)).select("doc_id", "sent_idx", X.polarity("sentence").alias("polarity"))


def _matches_sql(hint: str, x: str) -> str:
    return f"len(regexp_extract_all(lower({x}), {q(chr(92) + 'b' + hint + chr(92) + 'b')}))"


def _bonus_sql(x: str) -> str:
    return "(" + " + ".join(f"least({_matches_sql(h, x)}, 3) * {w} * 0.5" for h, w in HINTS.items()) + ")"


@query(f"select doc_id, cast(sent_idx as integer) as sent_idx, cast({_bonus_sql('sentence')} as double) as bonus from ({_sentence_sql(C.NARRATIVES)})")
def hint_bonus(spark, sf_dir):
    return scoring.sentences(C.narratives(spark, sf_dir)).select("doc_id", "sent_idx", H.bonus(F.col("sentence"), H.prepare(HINTS)).alias("bonus"))


# ---- scores --------------------------------------------------------------------------


@query(f"with {O.scored(C.DOCUMENTS)} select doc_id, cast(sent_idx as integer) as sent_idx, term, tf from tf")
def term_frequency(spark, sf_dir):
    return scoring.tokens(C.documents(spark, sf_dir)).groupBy("doc_id", "sent_idx", "term").agg(F.count("*").alias("tf"))


@query(f"with {O.scored(C.DOCUMENTS)} select doc_id, term, count(*) as df, round(ln((min(n) + 1) / (count(*) + 1)) + 1, 6) as idf from tf group by doc_id, term")
def inverse_document_frequency(spark, sf_dir):
    s = C.documents(spark, sf_dir).select("doc_id", X.split_sentences("text").alias("s"))
    rows = W.numbered(s, ["doc_id", F.size("s").alias("n")], "s", "i", "t").select("doc_id", "n", "i", F.explode(X.tokens("t")).alias("term"))
    per = rows.groupBy("doc_id", "term").agg(F.count_distinct("i").alias("df"), F.first("n").alias("n"))
    return per.select("doc_id", "term", "df", F.round(F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1, 6).alias("idf"))


@query(f"with {O.scored(C.DOCUMENTS)} select doc_id, cast(sent_idx as integer) as sent_idx, round(tfidf, 6) as tfidf from parts")
def tfidf_scores(spark, sf_dir):
    return scoring.tfidf_scores(C.documents(spark, sf_dir)).withColumn("tfidf", F.round("tfidf", 6))


@query(f"with {O.scored(C.DOCUMENTS)} select doc_id, cast(sent_idx as integer) as sent_idx, round(position, 6) as position, round(length, 6) as length, round(composite, 6) as composite from parts")
def sentence_scores(spark, sf_dir):
    rows = W.fields(scoring.scored_documents(C.documents(spark, sf_dir)), ["doc_id"], "s", "sent_idx")
    return rows.select("doc_id", "sent_idx", *(F.round(c, 6).alias(c) for c in ("position", "length", "composite")))


@query(f"with {O.scored(C.NARRATIVES, True)}, {O.defaults()} select doc_id, cast(sent_idx as integer) as sent_idx, section from sectioned")
def section_map(spark, sf_dir):
    return scoring.section_map(C.narratives(spark, sf_dir))


@query(f"with {O.scored(C.NARRATIVES, True)}, {O.defaults()} select doc_id, cast(sent_idx as integer) as sent_idx, round(score, 6) as score, not heading as eligible from rated")
def default_scores(spark, sf_dir):
    rows = scoring.scored_documents(C.narratives(spark, sf_dir), separate=True)
    return rows.select("doc_id", F.inline(scoring.default_scores(F.col("s")))).select("doc_id", "sent_idx", F.round("score", 6).alias("score"), "eligible")


@query(f"with {O.scored(C.NARRATIVES)} select doc_id, cast(sent_idx as integer) as sent_idx, round(composite, 6) as score, not heading as eligible from parts")
def coverage_scores(spark, sf_dir):
    rows = scoring.scored_documents(C.narratives(spark, sf_dir))
    return rows.select("doc_id", F.inline(scoring.plain_scores(F.col("s"), headings=False))).select("doc_id", "sent_idx", F.round("score", 6).alias("score"), "eligible")


@query(
    f"with {O.scored(C.DOCUMENTS)}, n as (select doc_id, sent_idx, sqrt(sum(tf * tf)) as norm from tf group by all), t as (select * from tf join n using (doc_id, sent_idx))"
    " select a.doc_id, cast(a.sent_idx as integer) as a, cast(b.sent_idx as integer) as b, round(sum(a.tf * b.tf) / min(a.norm * b.norm), 6) as w"
    " from t a join t b on a.doc_id = b.doc_id and a.term = b.term and a.sent_idx < b.sent_idx group by a.doc_id, a.sent_idx, b.sent_idx"
)
def sentence_similarity(spark, sf_dir):
    return graph.similarities(C.documents(spark, sf_dir)).withColumn("w", F.round("w", 6))


@query(f"with {O.scored(C.DOCUMENTS)} select doc_id, cast(sent_idx as integer) as sent_idx, cast(row_number() over (partition by doc_id order by composite desc, sent_idx) as integer) as rank from parts qualify rank <= 5")
def ranked_sentences(spark, sf_dir):
    rows = scoring.scored_documents(C.documents(spark, sf_dir))
    scored = scoring.plain_scores(F.col("s"), headings=True)
    best = rows.select("doc_id", F.posexplode(selection.by_count(selection.ranked(scored), 5)).alias("i", "sent_idx"))
    return best.select("doc_id", "sent_idx", (F.col("i") + 1).alias("rank"))


# ---- summaries -----------------------------------------------------------------------


def _summary_sql(corpus: str, mode: str, most: int = 500) -> str:
    default = mode == "default"
    ctes = f"with {O.scored(corpus, default)}, {O.defaults()}, " if default else f"with {O.scored(corpus)}, rated as (select *, composite as score from parts), "
    fill = O.filled("rated", str(most), "not heading" if default else "true")
    short = f"case when coalesce(len(s), 0) < 3 and length(text) <= {most} then text else {O.truncated('text', str(most))} end" if default else O.truncated("text", str(most))
    body = f"case when len(s) >= 3 and len(chosen) > 0 then array_to_string(list_transform(list_sort(chosen), lambda i: s[i + 1]), ' ') else {short} end"
    if not default:
        body = f"case when length(text) <= {most} then text else {body} end"
    return f"{ctes} f as ({fill}) select doc_id, {body} as summary from base left join f using (doc_id)"


@query(_summary_sql(C.DOCUMENTS, "default"))
def summarize_default(spark, sf_dir):
    return summarize(C.documents(spark, sf_dir)).select("doc_id", "summary")


@query(_summary_sql(C.DOCUMENTS, "legacy"))
def summarize_legacy(spark, sf_dir):
    return summarize(C.documents(spark, sf_dir), mode="legacy").select("doc_id", "summary")


@query(_summary_sql(C.NARRATIVES, "default", 400))
def summarize_narratives(spark, sf_dir):
    return summarize(C.narratives(spark, sf_dir), 400).select("doc_id", "summary")


def _coverage_sql(corpus: str, most: int) -> str:
    """The best sentence of each paragraph, in order while it fits, then others of paragraphs not met."""
    walk = lambda items, start, also: f"""list_reduce(list_prepend({start}, {items}), lambda st, x: case when st.used + x.cost <= {most}{also}
        then {{'used': st.used + x.cost, 'chosen': list_append(st.chosen, x.i), 'met': list_append(st.met, x.para), 'i': -1::bigint, 'para': -1::bigint, 'cost': 0::bigint}} else st end)"""  # noqa: E731
    item = "{'used': 0::bigint, 'chosen': []::bigint[], 'met': []::bigint[], 'i': sent_idx::bigint, 'para': para::bigint, 'cost': (length(sentence) + 1)::bigint}"
    zero = "{'used': 0::bigint, 'chosen': []::bigint[], 'met': []::bigint[], 'i': -1::bigint, 'para': -1::bigint, 'cost': 0::bigint}"
    return f"""with {O.scored(corpus)},
    paras as (select doc_id, generate_subscripts(p, 1) - 1 as para, unnest(p) as paragraph from (select doc_id, {O.paragraphs('text')} as p from base)),
    numbered as (select *, row_number() over (partition by doc_id, sentence order by sent_idx) as k from parts),
    hits as (select n.doc_id, n.sent_idx, para, row_number() over (partition by n.doc_id, n.sent_idx order by para) as j, k from numbered n join paras p on n.doc_id = p.doc_id and contains(paragraph, sentence)),
    placed as (select n.doc_id, n.sent_idx, sentence, composite, para from numbered n join hits h on n.doc_id = h.doc_id and n.sent_idx = h.sent_idx and j = h.k where not heading),
    best as (select * from placed qualify row_number() over (partition by doc_id, para order by composite desc, sent_idx) = 1),
    first as (select doc_id, {walk(f'list({item} order by para)', zero, '')} as st from best group by doc_id),
    rest as (select p.doc_id, list({item} order by composite desc, sent_idx) as items from placed p join first f on p.doc_id = f.doc_id and not list_contains(f.st.met, p.para) group by p.doc_id),
    done as (select doc_id, case when items is null then st.chosen else ({walk('items', 'st', f' and st.used < {most}')}).chosen end as chosen from first left join rest using (doc_id))
    select doc_id, case when coalesce(len(s), 0) = 0 then text else array_to_string(list_transform(list_sort(coalesce(chosen, [])), lambda i: s[i + 1]), ' ') end as summary from base left join done using (doc_id)"""


@query(_coverage_sql(C.NARRATIVES, 450))
def summarize_coverage(spark, sf_dir):
    return summarize(C.narratives(spark, sf_dir), 450, mode="coverage").select("doc_id", "summary")


def _hints_sql(corpus: str, most: int, hard: bool, focus: float = 0.7) -> str:
    """Four greedy walks; each leaves out what the walks before it took."""
    hint_budget = (most * int(focus * 10_000) + 5_000) // 10_000
    plain_budget = most - hint_budget

    def walk(name: str, by: str, ok: str, budget: str, but: list[str]) -> str:
        joins = " ".join(f"left join {b} using (doc_id)" for b in but)
        free = " and ".join([ok, *(f"not coalesce(list_contains({b}.c_{b}, sent_idx), false)" for b in but)])
        need = f"case when st.used + x.len + (case when len(st.chosen) > 0 then 1 else 0 end) <= x.budget"
        return f"""{name} as (select doc_id, list_reduce(list_prepend({{'used': 0::bigint, 'chosen': []::bigint[], 'i': -1::bigint, 'len': 0::bigint, 'budget': 0::bigint}},
            list({{'used': 0::bigint, 'chosen': []::bigint[], 'i': sent_idx::bigint, 'len': length(sentence)::bigint, 'budget': ({budget})::bigint}} order by {by} desc, sent_idx)),
            lambda st, x: {need} then {{'used': st.used + x.len + (case when len(st.chosen) > 0 then 1 else 0 end), 'chosen': list_append(st.chosen, x.i), 'i': -1::bigint, 'len': 0::bigint, 'budget': 0::bigint}} else st end).chosen as c_{name}
            from pool {joins} where {free} and ({budget}) > 0 group by doc_id)"""

    used = lambda cols, also="[]": f"coalesce(list_sum(list_transform(list_concat({cols}), lambda i: length(ss[i + 1]))), 0) + greatest(len(list_concat({cols})) - 1, 0)"
    left_hint = f"{hint_budget} - ({used('coalesce(w1.c_w1, [])')})"
    left_plain = f"{plain_budget} - ({used('coalesce(w2.c_w2, []), coalesce(w3.c_w3, [])')})"
    walks = [
        walk("w1", "hint_score", "matched" if hard else "not heading", str(hint_budget), []),
        walk("w2", "score", "not heading", str(plain_budget), ["w1"]),
        walk("w3", "hint_score" if hard else "score", "matched" if hard else "not heading", left_hint, ["w1", "w2"]),
    ]
    if not hard:
        walks.append(walk("w4", "hint_score", "not heading", left_plain, ["w1", "w2", "w3"]))
    names = ["w1", "w2", "w3", *([] if hard else ["w4"])]
    both = "list_sort(list_concat(" + ", ".join(f"coalesce(c_{n}, [])" for n in names) + "))"
    joins = " ".join(f"left join {n} using (doc_id)" for n in names)
    return f"""with {O.scored(corpus, True)}, {O.defaults()},
    pool as (select r.*, b.s as ss, round(score + {_bonus_sql('r.sentence')}, 10) as hint_score, not heading and {_bonus_sql('r.sentence')} > 0 as matched from rated r join base b using (doc_id)),
    {', '.join(walks)}, done as (select doc_id, s, text, {both} as chosen from base {joins})
    select doc_id, case when len(s) >= 3 and len(chosen) > 0 then array_to_string(list_transform(chosen, lambda i: s[i + 1]), ' ')
        when coalesce(len(s), 0) < 3 and length(text) <= {most} then text else {O.truncated('text', str(most))} end as summary from done"""


@query(_hints_sql(C.NARRATIVES, 400, hard=False))
def summarize_hints_soft(spark, sf_dir):
    return summarize(C.narratives(spark, sf_dir), 400, hints=HINTS).select("doc_id", "summary")


@query(_hints_sql(C.NARRATIVES, 400, hard=True))
def summarize_hints_hard(spark, sf_dir):
    return summarize(C.narratives(spark, sf_dir), 400, hints=HINTS, hint_mode="hard").select("doc_id", "summary")


_KEYWORDS = "The items ordered and REDUCED cost"
_WANTED = sorted({w.lower() for w in _KEYWORDS.split() if len(w) > 2})
_KEYWORD_SCORE = " + ".join(f"(case when contains(lower(t), {q(w)}) then 1.0 else 0.0 end)" for w in _WANTED) + " + (case when length(t) > 200 then 0.5 else 0.0 end) + (case when regexp_matches(t, '\\p{Nd}') then 0.3 else 0.0 end) + (case when regexp_matches(lower(t), " + q(P.CAUSAL) + ") then 1.0 else 0.0 end)"


def _keyword_sql(corpus: str) -> str:
    return f"""with d as (select doc_id, text, {_short_lines('text')} as s from ({corpus})), r as (select doc_id, unnest(s) as t, generate_subscripts(s, 1) as i from d),
    b as (select *, row_number() over (partition by doc_id order by round({_KEYWORD_SCORE}, 10) desc, i) as rank from r qualify rank <= 10),
    j as (select doc_id, string_agg(t, chr(10) order by rank) as e from b group by doc_id) select doc_id, coalesce(e, text) as extract from d left join j using (doc_id)"""


@query(_keyword_sql(C.NARRATIVES))
def keyword_extract(spark, sf_dir):
    return extract_keyword(C.narratives(spark, sf_dir), _KEYWORDS)


@query(_keyword_sql(C.DOCUMENTS))
def keyword_extract_documents(spark, sf_dir):
    return extract_keyword(C.documents(spark, sf_dir), _KEYWORDS)


@query()
def summarize_textrank(spark, sf_dir):
    return graph.summarize_textrank(C.documents(spark, sf_dir))


@query()
def textrank_terms(spark, sf_dir):
    return graph.textrank_terms(C.documents(spark, sf_dir))


@query(
    f"with t as (select doc_id, {O.tokens('text')} as t from documents), p as (select doc_id, t, unnest(range(1, len(t) + 1)) as i from t), k as (select *, unnest([1, 2, 3]) as d from p)"
    " select doc_id, least(t[i], t[i + d]) as term_a, greatest(t[i], t[i + d]) as term_b, count(*) as w from k where i + d <= len(t) and t[i] <> t[i + d] group by 1, 2, 3"
)
def term_companions(spark, sf_dir):
    return graph.companions(C.documents(spark, sf_dir))


# ---- headings and pins ---------------------------------------------------------------


@query(
    f"with s as ({_sentence_sql(C.NARRATIVES, True)}), h as (select *, {O.structural('sentence')} as h from s)"
    " select doc_id, cast(sent_idx as integer) as sent_idx, cast(case when not h then last_value(case when h then sent_idx end ignore nulls) over (partition by doc_id order by sent_idx) end as integer) as heading_idx from h"
)
def nearest_headings(spark, sf_dir):
    return pins.nearest_headings(C.narratives(spark, sf_dir))


@query(f"with s as ({_sentence_sql(C.NARRATIVES, True)}) select doc_id, case when {O.structural('sentence')} and greatest(length(regexp_extract(sentence, '^\\s*(#+)\\s+', 1)), 1) = 1 then sentence end as title from s where sent_idx = 0")
def document_titles(spark, sf_dir):
    return pins.document_titles(C.narratives(spark, sf_dir))


def _outline_sql(corpus: str) -> str:
    return f"""with {O.scored(corpus, True)}, h as (select *, {O.structural('sentence')} as head from parts), p as (select *, count(*) filter (head) over (partition by doc_id order by sent_idx) as part from h),
    g as (select doc_id, part, max(case when head then sentence end) as head, arg_max(case when not head then sentence end, case when not head then [composite, -sent_idx] end) as best from p where part > 0 group by doc_id, part)
    select doc_id, part, greatest(length(regexp_extract(head, '^\\s*(#+)\\s+', 1)), 1) as depth, {O.heading_name('head')} as name, best as representative_sentence from g where best is not null and {O.heading_name('head')} is not null"""


@query(f"select doc_id, cast(row_number() over (partition by doc_id order by part) - 1 as integer) as i, cast(depth as integer) as depth, name, representative_sentence from ({_outline_sql(C.NARRATIVES)})")
def outline(spark, sf_dir):
    rows = extract.outline(C.narratives(spark, sf_dir))
    return rows.select("doc_id", F.posexplode("outline").alias("i", "o")).select("doc_id", "i", "o.*")


@query(f"select doc_id, string_agg(repeat('  ', depth - 1) || name, chr(10) order by part) as toc from ({_outline_sql(C.NARRATIVES)}) group by doc_id")
def toc(spark, sf_dir):
    rows = extract.outline(C.narratives(spark, sf_dir))
    return rows.select("doc_id", F.array_join(F.transform("outline", lambda o: F.concat(F.repeat(F.lit("  "), o["depth"] - 1), o["name"])), "\n").alias("toc"))


@query(f"with s as ({_summary_sql(C.NARRATIVES, 'default', 400)}), t as (select doc_id, string_agg(repeat('  ', depth - 1) || name, chr(10) order by part) as toc from ({_outline_sql(C.NARRATIVES)}) group by doc_id) select doc_id, concat_ws(chr(10) || chr(10), 'Pinned line', nullif(toc, ''), nullif(summary, '')) as summary from s left join t using (doc_id)")
def summarize_pinned(spark, sf_dir):
    return summarize(C.narratives(spark, sf_dir), 400, pin=["Pinned line"], include_toc=True).select("doc_id", "summary")


@query()
def summarize_keep_headings(spark, sf_dir):
    rows = summarize(C.narratives(spark, sf_dir), 400, keep_headings=True)
    return rows.select("doc_id", "summary", lines("pinned_headings").alias("pinned"))


@query()
def summarize_given_headings(spark, sf_dir):
    rows = summarize(C.narratives(spark, sf_dir), 400, keep_headings=True, include_toc=True, headings=["## Overview", "Not there", "Conclusion"])
    return rows.select("doc_id", "summary", lines("pinned_headings").alias("pinned"))


# ---- facts ---------------------------------------------------------------------------


def _facts_sql(source: str) -> str:
    """One row for each fact of the sentences in ``source`` (doc_id, sent_idx, sentence)."""
    first = "coalesce(nullif(g1, ''), nullif(g2, ''), nullif(g3, ''))"
    shape = {"money": (3, first, "'usd'"), "percent": (2, "g1", "'percent'"), "date": (3, first, "'date'"), "duration": (2, "g1 || ' ' || lower(g2)", "rtrim(lower(g2), 's')"), "count": (2, "g1", "lower(g2)")}
    parts = []
    for order, (name, (groups, value, unit)) in enumerate(shape.items()):
        pattern, folded, _ = P.FACTS[name]
        pattern = q(("(?i)" if folded else "") + pattern)
        found = ", ".join(f"unnest(regexp_extract_all(sentence, {pattern}, {g})) as g{g}" for g in range(1, groups + 1))
        rows = f"select doc_id, sent_idx, sentence, string_split_regex(sentence, {pattern}) as gaps, regexp_extract_all(sentence, {pattern}) as hits, generate_subscripts(regexp_extract_all(sentence, {pattern}), 1) as k, {found} from {source} where regexp_matches(sentence, '\\d') and not regexp_matches(sentence, {q(P.LONG_RUN)})"
        start = "coalesce(list_sum(list_transform(gaps[1:k], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda g: length(g))), 0)"
        placed = f"select *, {start} as b, {start} + length(hits[k]) as e from ({rows})"
        parts.append(f"select doc_id, sent_idx, {order} as o, k, '{name}' as stat_type, {value} as value, {unit} as unit, {O.trim('sentence[greatest(b - 25, 0)::bigint + 1 : (e + 25)::bigint]')} as phrase, sentence as context_sentence from ({placed})")
    return " union all ".join(parts)


@query(f"with s as ({_sentence_sql(C.NARRATIVES)}), f as ({_facts_sql('s')}) select doc_id, cast(row_number() over (partition by doc_id order by sent_idx, o, k) - 1 as integer) as i, stat_type, value, unit, phrase, context_sentence from f")
def stats(spark, sf_dir):
    return W.numbered(extract.stats(C.narratives(spark, sf_dir)), ["doc_id"], "stats", "i", "s").select("doc_id", "i", "s.*")


def _distinct_sql(pattern: str) -> str:
    hits = f"regexp_extract_all(text, {q(pattern)})"
    return f"array_to_string(list_filter({hits}, lambda x, i: list_position({hits}, x) = i), '|')"


@query(f"select doc_id, {_distinct_sql(P.WHOLE_DATE)} as dates, {_distinct_sql('(?i)' + P.AMOUNT)} as amounts, {_distinct_sql('(?i)' + P.URL)} as urls from ({C.NARRATIVES})")
def metadata(spark, sf_dir):
    return extract.metadata(C.narratives(spark, sf_dir)).select("doc_id", *(F.array_join(f"metadata.{n}", "|").alias(n) for n in ("dates", "amounts", "urls")))


_NORM = O.fold("regexp_replace(lower(value), '[-_/]+', ' ', 'g')")
_CANDIDATES = f"""{O.scored(C.NARRATIVES)}, f as ({_facts_sql('parts')}),
    first as (select doc_id, sentence, min(sent_idx) as place from parts group by all),
    c as (select f.doc_id, context_sentence as sentence, min(place) as sent_idx, count(*) as facts, list_sort(list_distinct(list(stat_type || chr(1) || {_NORM}))) as keys
        from f join first on f.doc_id = first.doc_id and f.context_sentence = first.sentence group by f.doc_id, context_sentence),
    candidates as (select c.*, round(composite + 0.15 * facts / greatest(words, 1), 10) as score from c join parts p on c.doc_id = p.doc_id and c.sent_idx = p.sent_idx)"""


@query(f"with {_CANDIDATES} select doc_id, cast(sent_idx as integer) as sent_idx, round(score, 6) as score, array_to_string(keys, '|') as keys from candidates")
def fact_candidates(spark, sf_dir):
    rows = extract.fact_candidates(C.narratives(spark, sf_dir))
    return rows.select("doc_id", "sent_idx", F.round("score", 6).alias("score"), F.array_join(F.array_sort("keys"), "|").alias("keys"))


_KEPT = f"""{_CANDIDATES}, w as (select doc_id, list_reduce(list_prepend({{'n': 0::bigint, 'met': []::varchar[], 'chosen': []::bigint[], 'i': -1::bigint, 'keys': []::varchar[]}},
    list({{'n': 0::bigint, 'met': []::varchar[], 'chosen': []::bigint[], 'i': sent_idx::bigint, 'keys': keys}} order by score desc, sent_idx)),
    lambda st, x: case when st.n < 4 and not list_has_any(st.met, x.keys) then {{'n': st.n + 1, 'met': list_concat(st.met, x.keys), 'chosen': list_append(st.chosen, x.i), 'i': -1::bigint, 'keys': []::varchar[]}} else st end).chosen as chosen from candidates group by doc_id)"""


@query(f"with {_KEPT} select base.doc_id, coalesce(array_to_string(list_transform(list_sort(chosen), lambda i: s[i + 1]), chr(10)), '') as key_facts from base left join w on base.doc_id = w.doc_id")
def key_facts(spark, sf_dir):
    return extract.key_facts(C.narratives(spark, sf_dir), 4).select("doc_id", lines("key_facts").alias("key_facts"))


def _walk_sql(state: str, items: str, quota: str) -> str:
    """Walk a list of candidates; keep those that share no key with what was kept, ``quota`` of them."""
    blank = "{'n': 0::bigint, 'met': []::varchar[], 'chosen': []::bigint[], 'i': -1::bigint, 'keys': []::varchar[]}"
    start = f"{{'n': 0::bigint, 'met': {state}.met, 'chosen': {state}.chosen, 'i': -1::bigint, 'keys': []::varchar[]}}" if state else blank
    return (
        f"list_reduce(list_prepend({start}, coalesce({items}, [])), lambda st, x: case when st.n < {quota} and not list_has_any(st.met, x.keys) and not list_contains(st.chosen, x.i)"
        " then {'n': st.n + 1, 'met': list_concat(st.met, x.keys), 'chosen': list_append(st.chosen, x.i), 'i': -1::bigint, 'keys': []::varchar[]} else st end)"
    )


_ITEM = "{'n': 0::bigint, 'met': []::varchar[], 'chosen': []::bigint[], 'i': sent_idx::bigint, 'keys': keys}"
_HINTED = f"""{_CANDIDATES}, e as (select *, {_bonus_sql('sentence')} as extra from candidates),
    l as (select doc_id, list({_ITEM} order by score desc, sent_idx) as plain, list({_ITEM} order by round(score + extra, 10) desc, sent_idx) filter (extra > 0) as hinted from e group by doc_id),
    wa as (select *, {_walk_sql('', 'hinted', '3')} as a from l), wb as (select *, {_walk_sql('a', 'plain', '1')} as b from wa), wc as (select *, {_walk_sql('b', 'hinted', '3 - a.n')} as c from wb)"""


@query(f"with {_HINTED} select base.doc_id, coalesce(array_to_string(list_transform(list_sort(c.chosen), lambda i: s[i + 1]), chr(10)), '') as key_facts from base left join wc on base.doc_id = wc.doc_id")
def key_facts_hinted(spark, sf_dir):
    return extract.key_facts(C.narratives(spark, sf_dir), 4, hints=HINTS, hint_mode="hard").select("doc_id", lines("key_facts").alias("key_facts"))


def _ngram_sql(corpus: str) -> str:
    return f"""w as (select doc_id, array_to_string(list_transform(regexp_extract_all(lower(text), '[a-z]{{3,}}'), lambda x: case when list_contains({O.words_in(P.PHRASE_STOPWORDS)}, x) then '|' else x end), ' ') as t from ({corpus})),
    r as (select doc_id, unnest(string_split(t, '|')) as r, generate_subscripts(string_split(t, '|'), 1) as run from w),
    l as (select doc_id, run, string_split(trim(r), ' ') as r from r where contains(trim(r), ' ')),
    k as (select *, unnest([2, 3, 4, 5]) as size from l), i as (select *, unnest(range(1, len(r) - size + 2)) as i from k where size <= len(r)),
    grams as (select doc_id, array_to_string(r[i:i + size - 1], ' ') as phrase, size, row_number() over (partition by doc_id order by run, size, i) - 1 as ord from i),
    counted as (select doc_id, phrase, size, count(*) as n, min(ord) as ord from grams group by all having count(*) >= 2),
    kept as (select * from counted a where not exists (select 1 from counted b where a.doc_id = b.doc_id and a.n = b.n and b.size > a.size and contains(' ' || b.phrase || ' ', ' ' || a.phrase || ' ')))"""


@query(f"with {_ngram_sql(C.DOCUMENTS)} select doc_id, phrase, n, cast(ord as integer) as ord from counted")
def phrase_counts(spark, sf_dir):
    return extract.phrase_counts(C.documents(spark, sf_dir)).drop("size")


@query(f"with {_ngram_sql(C.DOCUMENTS)}, j as (select doc_id, string_agg(phrase, chr(10) order by ord) as p from kept group by doc_id) select doc_id, coalesce(p, '') as phrases from documents left join j using (doc_id)")
def phrases(spark, sf_dir):
    return extract.phrases(C.documents(spark, sf_dir)).select("doc_id", lines("phrases").alias("phrases"))


@query(f"with {_ngram_sql(C.NARRATIVES)} select doc_id, string_agg(phrase, chr(10) order by case when {_bonus_sql('phrase').replace('records', 'volume')} > 0 then 0 else 1 end, ord) as phrases from kept group by doc_id")
def phrases_hinted(spark, sf_dir):
    return extract.phrases(C.narratives(spark, sf_dir), hints=["items", "volume"]).select("doc_id", lines("phrases").alias("phrases"))


_WORDS = "per as (select doc_id, term, sum(tf) as tf, count(*) as df, min(n) as n from tf group by all), rw as (select doc_id, term, tf * (ln((n + 1) / (df + 1)) + 1) as raw from per), words as (select doc_id, term, raw / max(raw) over (partition by doc_id) as score from rw)"


@query(f"with {O.scored(C.DOCUMENTS)}, {_WORDS} select doc_id, term, round(score, 6) as score from words")
def word_scores(spark, sf_dir):
    return extract.word_scores(C.documents(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"with {_ngram_sql(C.DOCUMENTS)} select doc_id, phrase as term, round(n * size / max(n * size) over (partition by doc_id), 6) as score from kept")
def phrase_scores(spark, sf_dir):
    return extract.phrase_scores(C.documents(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(
    f"with {O.scored(C.DOCUMENTS)}, {_WORDS}, {_ngram_sql(C.DOCUMENTS)}, every as (select doc_id, term, score, 'word' as kind from words union all select doc_id, phrase, n * size / max(n * size) over (partition by doc_id), 'phrase' from kept)"
    " select doc_id, cast(row_number() over (partition by doc_id order by round(score, 10) desc, term) as integer) as rank, term, round(score, 6) as score, kind from every qualify rank <= 10"
)
def top_terms(spark, sf_dir):
    return extract.term_scores(C.documents(spark, sf_dir)).withColumn("score", F.round("score", 6))


_CORRELATED = f"""s as ({_sentence_sql(C.NARRATIVES)}), f as ({_facts_sql('s')}), facts as (select doc_id, row_number() over (partition by doc_id order by sent_idx, o, k) - 1 as k, value as number, context_sentence as sentence from f),
    {_ngram_sql(C.NARRATIVES)},
    m as (select f.doc_id, f.k, arg_min(phrase, ord) as phrase from facts f join kept on f.doc_id = kept.doc_id and len(list_filter(string_split(phrase, ' '), lambda w: not contains(lower(sentence), w))) = 0 group by f.doc_id, f.k),
    often as (select doc_id, w, count(*) as n from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) as w from ({C.NARRATIVES})) where not list_contains({O.words_in(P.PHRASE_STOPWORDS)}, w) group by all having count(*) >= 2),
    sw as (select doc_id, k, unnest(regexp_extract_all(lower(sentence), '[a-z]{{3,}}')) as w, generate_subscripts(regexp_extract_all(lower(sentence), '[a-z]{{3,}}'), 1) as place from facts),
    bw as (select sw.doc_id, sw.k, arg_max(sw.w, [n, -place]) as word from sw join often using (doc_id, w) group by all),
    named as (select facts.*, coalesce(phrase, word) as entity from facts left join m using (doc_id, k) left join bw using (doc_id, k)),
    linked as (select *, count(*) over (partition by doc_id, entity) as met from named where entity is not null)"""


@query(f"with {_CORRELATED} select doc_id, cast(k as integer) as k, entity, number, {_polarity_sql('sentence')} as polarity, sentence from linked where met >= 2")
def correlate_facts(spark, sf_dir):
    return extract.correlated_rows(C.narratives(spark, sf_dir))


_TIDY = lambda x: O.fold(O.replace_all(x, r"^[ *]+|[ *]+$", "''"))
_TYPE = (
    "case when regexp_full_match(value, '\\d{4}') then 'year' when regexp_matches(lower(value), '\\$|usd|eur|gbp') then 'money' when regexp_matches(lower(value), 'https?://|www\\.') then 'url'"
    " when contains(key, 'citation') or regexp_matches(lower(value), '\\b\\d+\\s+u\\.s\\.') then 'citation' when contains(key, 'docket') or regexp_full_match(value, '\\d{1,4}-\\d+[A-Za-z]?') then 'identifier'"
    " when contains(value, ',') or contains(value, ';') then 'list' else 'text' end"
)


def _attributes_sql(corpus: str) -> str:
    """Attributes of texts whose bold pairs end their lines."""
    bold = r"\*\*[ \t]*([^:\n*][^:\n]{0,80}?)[ \t]*:[ \t]*\*\*[ \t]*([^\n]*)"
    key = lambda x: f"trim(regexp_replace(replace(lower({O.trim(x)}), '&', ' and '), '[^a-z0-9]+', '_', 'g'), '_')"
    return f"""d as ({corpus}), bold as (select doc_id, 0 as o, unnest(regexp_extract_all(text, {q(bold)}, 1)) as l, unnest(regexp_extract_all(text, {q(bold)}, 2)) as v, unnest(regexp_extract_all(text, {q(bold)})) as evidence, generate_subscripts(regexp_extract_all(text, {q(bold)}), 1) as i from d),
    ln as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from d),
    plain as (select doc_id, 1 as o, regexp_extract(line, {q(P.LINE_ATTRIBUTE)}, 1) as l, regexp_extract(line, {q(P.LINE_ATTRIBUTE)}, 2) as v, line as evidence, i from ln where not contains(line, '**') and regexp_matches(line, {q(P.LINE_ATTRIBUTE)})),
    every as (select * from bold union all select * from plain), tidy as (select doc_id, o, i, {_TIDY('l')} as label, {_TIDY('v')} as value, {O.fold('evidence')} as e from every),
    keyed as (select *, {key('label')} as key from tidy), good as (select * from keyed where label <> '' and value <> '' and key <> '' and length(key) <= 80),
    attributes as (select doc_id, o, i, key, label, value, {_TYPE} as value_type, case when o = 0 then 'header_kv' else 'line_kv' end as source,
        case when length(e) <= 260 then e else rtrim(e[1:259]) || '...' end as evidence, case when o = 0 then 0.99::double else 0.9::double end as confidence
        from good qualify row_number() over (partition by doc_id, key, value order by o, i) = 1)"""


@query(f"with {_attributes_sql(C.NARRATIVES)} select doc_id, cast(row_number() over (partition by doc_id order by o, i) - 1 as integer) as i, key, label, value, value_type, source, evidence, confidence from attributes")
def attributes(spark, sf_dir):
    return W.numbered(extract.attributes(C.narratives(spark, sf_dir)), ["doc_id"], "attributes", "i", "a").select("doc_id", "i", "a.*")


@query(f"with {_attributes_sql(C.DIALOGUES)} select doc_id, cast(row_number() over (partition by doc_id order by o, i) - 1 as integer) as i, key, value_type, confidence from attributes")
def dialogue_attributes(spark, sf_dir):
    rows = W.numbered(extract.attributes(C.dialogues(spark, sf_dir)), ["doc_id"], "attributes", "i", "a")
    return rows.select("doc_id", "i", "a.key", "a.value_type", "a.confidence")


_E260 = f"case when length({O.fold('context_sentence')}) <= 260 then {O.fold('context_sentence')} else rtrim({O.fold('context_sentence')}[1:259]) || '...' end"


@query(
    f"with {_attributes_sql(C.NARRATIVES)}, s as ({_sentence_sql(C.NARRATIVES)}), f as ({_facts_sql('s')}),"
    " u as (select doc_id, 0 as part, o as a, i as b, 0 as c, key as predicate, value as object, 'attribute' as fact_type, evidence, confidence from attributes"
    f" union all select doc_id, 1, sent_idx, o, k, stat_type, value, 'numeric', {_E260}, 0.8::double from f)"
    " select doc_id, cast(row_number() over (partition by doc_id order by part, a, b, c) - 1 as integer) as i, 'document' as subject, predicate, object, fact_type, evidence, confidence from u"
)
def fact_records(spark, sf_dir):
    return W.numbered(extract.fact_records(C.narratives(spark, sf_dir)), ["doc_id"], "fact_records", "i", "r").select("doc_id", "i", "r.*")


@query(f"with {_attributes_sql(C.NARRATIVES)} select doc_id, cast(row_number() over (partition by doc_id order by o, i) - 1 as integer) as i, 'report.attributes.' || key || '.value' as path, key, value_type, true as promote, confidence from attributes")
def promotion_candidates(spark, sf_dir):
    return W.numbered(extract.promotion_candidates(C.narratives(spark, sf_dir)), ["doc_id"], "promotions", "i", "p").select("doc_id", "i", "p.*")


# ---- names, classes, forms -----------------------------------------------------------


def _in(x: str, *lists: list[str]) -> str:
    return f"coalesce(list_contains({O.words_in([w for of in lists for w in of])}, lower({x})), false)"


def _entities_sql(corpus: str, piece: str = r"[\p{L}\p{N}']+|[&.!?]") -> str:
    piece = q(piece)
    common = _in("parts[1]", P.SENTENCE_STOPWORDS, P.TITLES, P.CALENDAR, P.COMMON_NOUNS, P.CURRENCY_CODES, P.POSSESSIVES)
    known = f"len(list_filter(parts, lambda w: {_in('w', P.ORG_SUFFIXES, P.ORGS, P.COUNTRIES, P.PLACES, P.FIRST_NAMES)})) > 0"
    return f"""pc as (select doc_id, unnest(regexp_extract_all(text, {piece})) as word, generate_subscripts(regexp_extract_all(text, {piece}), 1) as pos from ({corpus})),
    pw as (select *, last_value(case when word not in ('.', '!', '?') then word end ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding) as before from pc),
    pe as (select *, word in ('.', '!', '?') as mark, word in ('!', '?') or (word = '.' and not {_in('before', P.TITLES)}) as stop from pw),
    ps as (select *, count(*) filter (stop) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding) as ends from pe),
    wd as (select doc_id, pos, word, ends > coalesce(lag(ends) over o, -1) as starts, regexp_matches(word, '^\\p{{Lu}}') as cap from ps where not mark window o as (partition by doc_id order by pos)),
    br as (select *, {_in('word', P.CONNECTORS)} and not cap and not starts and coalesce(lag(cap) over o, false) and coalesce(lead(cap and not starts) over o, false) as bridge from wd window o as (partition by doc_id order by pos)),
    mb as (select *, cap or bridge as member from br), lk as (select *, member and not (bridge or (cap and not starts and coalesce(lag(member) over o, false))) as new from mb window o as (partition by doc_id order by pos)),
    rn as (select *, count(*) filter (new) over (partition by doc_id order by pos) as run from lk), runs as (select doc_id, min(pos) as pos, list(word order by pos) as parts, list(pos order by pos) as places, arg_min(starts, pos) as starts from rn where member group by doc_id, run),
    st as (select *, len(parts) > 1 and {_in('parts[1]', P.TITLES)} as titled, len(parts) > 1 and {_in('parts[1]', P.POSSESSIVES)} as owner, len(parts) > 1 and starts and {_in('parts[1]', P.SENTENCE_STOPWORDS)} as opener from runs),
    cut as (select doc_id, pos, titled, starts and not (titled or owner or opener) as starts, case when titled or owner or opener then parts[2:] else parts end as parts, case when titled or owner or opener then places[2] else places[1] end as first, places[len(places)] as last from st),
    names as (select doc_id, pos, first, last, array_to_string(parts, ' ') as entity from cut where not (len(parts) = 1 and {common}) and (titled or {known} or len(parts) > 1 or not starts))"""


@query(f"with {_entities_sql(C.NARRATIVES)}, u as (select doc_id, entity, min(pos) as pos from names group by all) select doc_id, string_agg(entity, '|' order by pos) as entities from u group by doc_id")
def entities(spark, sf_dir):
    return enrich.entities(C.narratives(spark, sf_dir)).select("doc_id", F.array_join("entities", "|").alias("entities"))


@query(f"with {_entities_sql(C.PAGE_TEXT)}, u as (select doc_id, entity, min(pos) as pos from names group by all) select doc_id, string_agg(entity, '|' order by pos) as entities from u group by doc_id")
def page_entities(spark, sf_dir):
    return enrich.entities(C.page_text(spark, sf_dir)).where(F.size("entities") > 0).select("doc_id", F.array_join("entities", "|").alias("entities"))


def _class_sql(w: str) -> str:
    parts = [f"when starts_with({w}, '$') or ends_with({w}, '%') or regexp_matches({w}, '^[0-9]') then 'NUM'"]
    parts += [f"when {_in(w, words)} then '{name}'" for name, words in P.WORD_CLASSES.items()]
    parts += [f"when {_in(w, P.GROWTH_VERBS, P.DECLINE_VERBS, P.OTHER_VERBS)} or regexp_matches(lower({w}), '(?:ing|ed)$') then 'VERB'", f"when ends_with(lower({w}), 'ly') then 'ADV'"]
    parts += [f"when regexp_matches(lower({w}), '(?:tion|ment|ness|ity)$') then 'NOUN'", f"when regexp_matches(lower({w}), '(?:ous|ful|ive|able)$') then 'ADJ'", f"when regexp_matches({w}, '^\\p{{Lu}}') then 'PROPN'"]
    return "case " + " ".join(parts) + " else 'NOUN' end"


_EDGE = r"[^\p{L}\p{N}$%']+"
_TAGGED = f"tg as (select doc_id, sent_idx, sentence, list_filter(list_transform(string_split({O.fold('sentence')}, ' '), lambda w: {O.replace_all('w', f'^{_EDGE}|{_EDGE}$', chr(39) * 2)}), lambda w: w <> '') as t from s)"


@query(f"with s as ({_sentence_sql(C.NARRATIVES)}), {_TAGGED}, r as (select doc_id, sent_idx, unnest(t) as token, generate_subscripts(t, 1) - 1 as pos from tg) select doc_id, cast(sent_idx as integer) as sent_idx, cast(pos as integer) as pos, token, {_class_sql('token')} as tag from r")
def pos_tags(spark, sf_dir):
    rows = scoring.sentences(C.narratives(spark, sf_dir)).select("doc_id", "sent_idx", F.posexplode(enrich.tagged("sentence")).alias("pos", "x"))
    return rows.select("doc_id", "sent_idx", "pos", "x.token", "x.tag")


def _lemma_sql(w: str) -> str:
    n, cut = f"length({w})", lambda k: f"{w}[1:length({w}) - {k}]"
    # no back-references here: each doubled letter is spelled out
    single = lambda x: f"case when regexp_matches({x}, '(?:bb|dd|gg|mm|nn|pp|rr|tt)$') then {x}[1:length({x}) - 1] else {x} end"
    irregular = " ".join(f"when {_in(w, forms.split())} then '{base}'" for base, forms in P.IRREGULAR.items())
    return (
        f"case {irregular} when regexp_matches({w}, '[^\\x00-\\x7F]') then {w} when {n} > 4 and regexp_matches({w}, 'ie[sd]$') then {cut(3)} || 'y' when {n} > 5 and ends_with({w}, 'ing') then {single(cut(3))}"
        f" when {n} > 4 and ends_with({w}, 'ed') then {single(cut(2))} when {n} > 4 and regexp_matches({w}, '(?:[sxz]|ch|sh)es$') then {cut(2)} when {n} > 3 and regexp_matches({w}, '[^s]s$') then {cut(1)} else {w} end"
    )


@query(f"with w as (select distinct unnest(regexp_extract_all(text, '\\p{{L}}+')) as word from (select text from ({C.NARRATIVES}) union all select text from documents)) select word, {_lemma_sql('lower(word)')} as lemma from w")
def lemmas(spark, sf_dir):
    texts = C.narratives(spark, sf_dir).select("text").union(C.documents(spark, sf_dir).select("text"))
    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", enrich.lemma("word").alias("lemma"))


@query(f"with {_CORRELATED}, kf as (select * from linked where met >= 2), sid as (select distinct doc_id || chr(1) || sentence as doc_id, sentence as text from kf), {_entities_sql('select * from sid')}, fn as (select doc_id, arg_min(entity, pos) as named from names group by doc_id) select kf.doc_id, cast(k as integer) as k, coalesce(named, entity) as entity, number, {_polarity_sql('sentence')} as polarity, sentence from kf left join fn on fn.doc_id = kf.doc_id || chr(1) || sentence")
def named_facts(spark, sf_dir):
    return enrich.named_facts(C.narratives(spark, sf_dir))


@query()
def verb_facts(spark, sf_dir):
    return enrich.verb_facts(C.narratives(spark, sf_dir))


_SPANS = q(r"[\p{L}\p{N}']+|[^\s\p{L}\p{N}']")
_SPAN_SQL = f"""sp as (select doc_id, regexp_extract_all(text, {_SPANS}) as h, string_split_regex(text, {_SPANS}) as g from documents), sk as (select doc_id, unnest(h) as token, unnest(g[1:len(h)]) as gap, generate_subscripts(h, 1) - 1 as tok from sp),
    se as (select *, sum(strlen(gap) + strlen(token)) over (partition by doc_id order by tok) as e from sk), spans as (select doc_id, cast(tok as integer) as tok, token, cast(e - strlen(token) as integer) as "start", cast(e as integer) as "end" from se)"""


@query(f'with {_SPAN_SQL} select doc_id, tok, token, "start", "end" from spans')
def span_tokens(spark, sf_dir):
    return enrich.span_tokens(C.documents(spark, sf_dir))


@query()
def sequence_features(spark, sf_dir):
    rows = enrich.text_features(C.documents(spark, sf_dir))
    return rows.select("doc_id", "tok", F.array_join("features", " ").alias("features"))


# ---- rendering -----------------------------------------------------------------------


@query(f"with s as ({_sentence_sql(C.NARRATIVES)}), f as ({_facts_sql('s')}) select doc_id, string_agg(concat_ws(chr(9), stat_type, value, unit, context_sentence), chr(10) order by sent_idx, o, k) as text from f group by doc_id")
def stats_text(spark, sf_dir):
    return extract.stats(C.narratives(spark, sf_dir)).select("doc_id", report.render("stats", "stats").alias("text"))


@query(f"select doc_id, string_agg(repeat('  ', depth - 1) || '- ' || name || ': ' || representative_sentence, chr(10) order by part) as text, '## Outline' || chr(10) || chr(10) || string_agg(repeat('  ', depth - 1) || '- **' || name || '**: ' || representative_sentence, chr(10) order by part) as markdown from ({_outline_sql(C.NARRATIVES)}) group by doc_id")
def outline_rendered(spark, sf_dir):
    rows = extract.outline(C.narratives(spark, sf_dir))
    return rows.select("doc_id", report.render("outline", "outline").alias("text"), report.render("outline", "outline", "markdown").alias("markdown"))


@query()
def brief(spark, sf_dir):
    return report.brief(C.narratives(spark, sf_dir), include_phrases=True)


@query()
def full_report(spark, sf_dir):
    return report.render_report(report.report(C.narratives(spark, sf_dir)))


# ---- agreement -----------------------------------------------------------------------


def _rouge_sql() -> str:
    c, r = O.tokens("summary"), O.tokens("text")
    pairs = lambda t: f"list_transform({t}[2:], lambda w, i: {t}[i] || ' ' || w)"
    part = lambda a, b, k: f"len(list_intersect(list_distinct({a}), list_distinct({b}))) / greatest(len(list_distinct({a})), 1) as r{k}_p, len(list_intersect(list_distinct({a}), list_distinct({b}))) / greatest(len(list_distinct({b})), 1) as r{k}_r"
    f = lambda k: f"round(case when r{k}_p + r{k}_r > 0 then 2 * r{k}_p * r{k}_r / (r{k}_p + r{k}_r) else 0.0 end, 6) as r{k}_f"
    return f"with z as ({_summary_sql(C.DOCUMENTS, 'legacy')}), t as (select z.doc_id, {c} as c, {r} as r from z join documents d using (doc_id)), m as (select doc_id, {part('c', 'r', 1)}, {part(pairs('c'), pairs('r'), 2)} from t) select doc_id, round(r1_p, 6) as r1_p, round(r1_r, 6) as r1_r, {f(1)}, round(r2_p, 6) as r2_p, round(r2_r, 6) as r2_r, {f(2)} from m"


@query(_rouge_sql())
def rouge(spark, sf_dir):
    docs = C.documents(spark, sf_dir)
    both = summarize(docs, mode="legacy").select("doc_id", "summary").join(docs, "doc_id")
    rows = both.select("doc_id", evals.rouge("summary", "text").alias("r")).select("doc_id", "r.*")
    return rows.select("doc_id", *(F.round(c, 6).alias(c) for c in rows.columns[1:]))


@query(
    f"with f as (select doc_id, unnest(list_distinct(regexp_extract_all(text, {q(P.WHOLE_DATE)}))) as date from ({C.NARRATIVES})), g as (select distinct o_custkey as doc_id, strftime(o_orderdate, '%Y-%m-%d') as date from orders),"
    " b as (select g.doc_id, f.date as fd, g.date as gd from f full join g on f.doc_id = g.doc_id and f.date = g.date) select count(*) filter (fd is not null and gd is not null) as tp, count(*) filter (gd is null) as fp, count(*) filter (fd is null) as fn from b"
)
def date_agreement(spark, sf_dir):
    found = extract.metadata(C.narratives(spark, sf_dir)).select("doc_id", F.explode("metadata.dates").alias("date"))
    gold = C.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    rows = evals.set_agreement(found.withColumn("all", F.lit(1)), gold.withColumn("all", F.lit(1)), ["doc_id", "date"], ["all"])
    return rows.select("tp", "fp", "fn")


# ---- the same operators over whole documents, and results beside results ------------------


@query(f"with s as ({_sentence_sql(C.LEDGERS)}), f as ({_facts_sql('s')}) select doc_id, cast(row_number() over (partition by doc_id order by sent_idx, o, k) - 1 as integer) as i, stat_type, value, unit, phrase, context_sentence from f")
def stats_documents(spark, sf_dir):
    return W.numbered(extract.stats(C.ledgers(spark, sf_dir)), ["doc_id"], "stats", "i", "s").select("doc_id", "i", "s.*")


@query(f"select doc_id, {_distinct_sql(P.WHOLE_DATE)} as dates, {_distinct_sql('(?i)' + P.AMOUNT)} as amounts, {_distinct_sql('(?i)' + P.URL)} as urls from documents")
def metadata_documents(spark, sf_dir):
    return extract.metadata(C.documents(spark, sf_dir)).select("doc_id", *(F.array_join(f"metadata.{n}", "|").alias(n) for n in ("dates", "amounts", "urls")))


@query(f"with {_entities_sql(C.DOCUMENTS)}, u as (select doc_id, entity, min(pos) as pos from names group by all) select doc_id, string_agg(entity, '|' order by pos) as entities from u group by doc_id")
def entities_documents(spark, sf_dir):
    return enrich.entities(C.documents(spark, sf_dir)).where(F.size("entities") > 0).select("doc_id", F.array_join("entities", "|").alias("entities"))


@query(ORACLE["stats"])
def attached_stats(spark, sf_dir):
    rows = summarize(C.narratives(spark, sf_dir), 400, attach=["stats"])
    return W.numbered(rows, ["doc_id"], "stats", "i", "s").select("doc_id", "i", "s.*")


@query(f"with z as ({_summary_sql(C.NARRATIVES, 'default', 400)}), s as ({_sentence_sql(C.NARRATIVES)}), f as ({_facts_sql('s')}), t as (select doc_id, string_agg('| ' || concat_ws(' | ', stat_type, value, unit, context_sentence) || ' |', chr(10) order by sent_idx, o, k) as rows from f group by doc_id)"
    " select z.doc_id, '## Summary' || chr(10) || chr(10) || regexp_replace(summary, '\\s+$', '') || coalesce(chr(10) || chr(10) || '## Stats' || chr(10) || chr(10) || '| Type | Value | Unit | Context |' || chr(10) || '|---|---|---|---|' || chr(10) || rows, '') as markdown from z left join t using (doc_id)")
def summary_markdown(spark, sf_dir):
    return report.render_summary(summarize(C.narratives(spark, sf_dir), 400, attach=["stats"]))


@query(f"with m as ({ORACLE['metadata']}), e as ({ORACLE['entities']}) select m.doc_id, dates, amounts, urls, coalesce(entities, '') as entities from m left join e using (doc_id)")
def metadata_with_names(spark, sf_dir):
    rows = extract.metadata(C.narratives(spark, sf_dir), entities=True)
    return rows.select("doc_id", *(F.array_join(f"metadata.{n}", "|").alias(n) for n in ("dates", "amounts", "urls", "entities")))


@query(f"with {_KEPT}, k as (select base.doc_id, list_transform(list_sort(chosen), lambda i: s[i + 1]) as k from base join w on base.doc_id = w.doc_id where len(chosen) > 0) select doc_id, array_to_string(k, chr(10)) as text, '## Key Facts' || chr(10) || chr(10) || array_to_string(list_transform(k, lambda x: '- ' || x), chr(10)) as markdown from k")
def key_facts_rendered(spark, sf_dir):
    rows = extract.key_facts(C.narratives(spark, sf_dir), 4).where(F.size("key_facts") > 0)
    return rows.select("doc_id", report.render("key_facts", "key_facts").alias("text"), report.render("key_facts", "key_facts", "markdown").alias("markdown"))


_VERBS = f"list_filter(list_transform(t, lambda w: case when {_class_sql('w')} = 'VERB' then lower(w) else '' end), lambda w: list_contains({O.words_in(P.GROWTH_VERBS + P.DECLINE_VERBS)}, w))"


@query(f"with s as ({_sentence_sql(C.NARRATIVES)}), {_TAGGED} select doc_id, cast(sent_idx as integer) as sent_idx, case when list_contains({O.words_in(P.GROWTH_VERBS)}, {_VERBS}[1]) then 'growth' when len({_VERBS}) > 0 then 'decline' else 'absolute' end as polarity from tg")
def verb_polarity(spark, sf_dir):
    return scoring.sentences(C.narratives(spark, sf_dir)).select("doc_id", "sent_idx", enrich.verb_polarity("sentence").alias("polarity"))


@query(f"with h as (select distinct unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]+')) as term from part), a as (select term, 1.0 as weight from h union all select {_lemma_sql('term')}, 0.5 from h) select term, cast(max(weight) as double) as weight from a group by term")
def expanded_hints(spark, sf_dir):
    words = C.table(spark, sf_dir, "part").select(F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lit("[a-z]+"), F.lit(0))).alias("term")).distinct()
    return enrich.expand_hints(words.withColumn("weight", F.lit(1.0)))


def _overlap_sql(a: str, b: str) -> str:
    return f"len(list_filter({a}, lambda x: len(list_filter({b}, lambda y: contains(lower(x), lower(y)) or contains(lower(y), lower(x)))) > 0))"


@query(
    f"with e as ({ORACLE['entities']}), g as (select doc_id, string_split(entities, '|') as f, ['Paris', 'Smith', 'Google of London', 'Nowhere'] as g from e)"
    f" select doc_id, cast({_overlap_sql('f', 'g')} as bigint) as tp, cast(len(f) - {_overlap_sql('f', 'g')} as bigint) as fp, cast(4 - {_overlap_sql('g', 'f')} as bigint) as fn, round({_overlap_sql('f', 'g')} / len(f), 6) as precision, round({_overlap_sql('g', 'f')} / 4, 6) as recall from g"
)
def name_agreement(spark, sf_dir):
    gold = F.array(*map(F.lit, ["Paris", "Smith", "Google of London", "Nowhere"]))
    rows = enrich.entities(C.narratives(spark, sf_dir)).where(F.size("entities") > 0).select("doc_id", evals.overlap_agreement("entities", gold).alias("x"))
    return rows.select("doc_id", "x.tp", "x.fp", "x.fn", F.round("x.precision", 6).alias("precision"), F.round("x.recall", 6).alias("recall"))


from . import labels as _labels  # noqa: E402, F401  more queries register themselves
