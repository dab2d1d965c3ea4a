"""SQL for DuckDB, put together from pieces: expressions over a text or a
sentence, and common table expressions from documents to scores.

Its patterns know no look-around, so boundaries are marked by control
characters first and split afterwards.
"""

from __future__ import annotations

from ..functions import patterns as P
from .corpora import quoted as q

_W = r"[^\p{L}\p{N}_]"


def replace_all(x: str, pattern: str, to: str) -> str:
    """``to`` is an SQL expression."""
    return f"regexp_replace({x}, {q(pattern)}, {to}, 'g')"


def trim(x: str) -> str:
    return replace_all(x, r"^\s+|\s+$", "''")


def fold(x: str) -> str:
    return trim(replace_all(x, r"\s+", "' '"))


def words_in(words: list[str]) -> str:
    return "[" + ", ".join(map(q, words)) + "]"


def sentences(x: str) -> str:
    short = "|".join(a.replace(".", r"\.") for a in P.ABBREVIATIONS)
    x = replace_all(x, r"(\d)\.(\d)", r"'\1' || chr(1) || '\2'")
    x = replace_all(x, rf"(^|{_W})No\.(\s*\d)", r"'\1No' || chr(1) || '\2'")
    x = replace_all(x, rf"(^|{_W})([A-Za-z]+(?:\.[A-Za-z]+)*)\.", r"'\1\2' || chr(2)")
    x = f"regexp_replace({x}, {q(rf'(^|[^\p{{L}}\p{{N}}_.])((?i:{short}))')} || chr(2), '\\1\\2' || chr(1), 'g')"
    x = f"replace({x}, chr(2), '.')"
    x = replace_all(x, r"([.!?])\s+([A-Z])", r"'\1' || chr(3) || '\2'")
    x = replace_all(x, r"\n\s*\n", "chr(3)")
    parts = f"list_transform(string_split({x}, chr(3)), lambda p: {trim('p')})"
    return f"list_transform(list_filter({parts}, lambda p: p <> ''), lambda p: replace(p, chr(1), '.'))"


def paragraphs(x: str, least: int = 20) -> str:
    x = replace_all(x, r"\n\s*\n+", "chr(3)")
    return f"list_filter(list_transform(string_split({x}, chr(3)), lambda p: {trim('p')}), lambda p: length(p) >= {least})"


def structural(x: str) -> str:
    return f"(regexp_matches({x}, {q(P.HEADING)}) and regexp_matches({x}, '\\S'))"


def heading(x: str) -> str:
    return f"(regexp_matches({x}, '\\S') and (regexp_matches({x}, {q(P.HEADING)}) or len(regexp_extract_all({x}, '[A-Za-z]{{3,}}')) < 4))"


def heading_name(x: str) -> str:
    x = trim(x)
    for pattern in (r"^#+\s+", r"^\d+\.\s+", r"\s+[—–\-]\s+.*$", r":+$"):
        x = f"regexp_replace({x}, {q(pattern)}, '')"
    return f"nullif({trim(x)}, '')"


def separated(x: str) -> str:
    lines = f"string_split({x}, chr(10))"
    one = f"case when {heading('l')} and coalesce(regexp_matches({lines}[i + 1], '\\S'), false) then l || chr(10) else l end"
    return f"array_to_string(list_transform({lines}, lambda l, i: {one}), chr(10))"


def tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}') and not list_contains({words_in(P.STOPWORDS)}, w))"


def word_count(x: str) -> str:
    return f"len(regexp_extract_all({x}, '\\S+'))"


def scored(corpus: str, separate: bool = False) -> str:
    """CTEs base, sents, tf, raw, parts: a row for each sentence with tfidf,
    position, length, composite, heading."""
    text = separated("text") if separate else "text"
    return f"""
    docs as ({corpus}),
    prepared as (select doc_id, text, {text} as ready from docs),
    base as (select doc_id, text, {sentences('ready')} as s from prepared),
    sents as (select doc_id, len(s) as n, unnest(s) as sentence, generate_subscripts(s, 1) - 1 as sent_idx from base),
    tok as (select doc_id, n, sent_idx, unnest({tokens('sentence')}) as term from sents),
    tf as (select doc_id, sent_idx, term, n, count(*) as tf from tok group by all),
    weighted as (select *, tf * (ln((n + 1) / (count(*) over (partition by doc_id, term) + 1)) + 1) as w from tf),
    raw as (select doc_id, sent_idx, sum(w) / sum(tf) as raw from weighted group by all),
    joined as (select s.*, coalesce(raw, 0.0) as raw, {word_count('sentence')} as words from sents s left join raw using (doc_id, sent_idx)),
    longs as (select *, case when words < 10 then words / 10.0 when words <= 30 then 1.0 else greatest(0.0, 1 - (words - 30) / 50.0) end as long from joined),
    parts0 as (select *,
        case when max(raw) over d > 0 then raw / max(raw) over d else 0.0 end as tfidf,
        greatest(0.0, 1 - 2.0 * least(sent_idx, n - 1 - sent_idx) / greatest(n - 1, 1)) as position,
        case when max(long) over d > 0 then long / max(long) over d else 0.0 end as length,
        {heading('sentence')} as heading
        from longs window d as (partition by doc_id)),
    parts as (select *, round(0.60 * tfidf + 0.25 * position + 0.15 * length, 10) as composite from parts0)"""


def defaults() -> str:
    """CTEs on top of ``scored``: section and default score."""
    return f"""
    named as (select *, case when heading then coalesce(lower({heading_name('sentence')}), '') end as own from parts),
    sectioned as (select *, coalesce(last_value(own ignore nulls) over (partition by doc_id order by sent_idx), '') as section from named),
    rated as (select *, round(0.60 * tfidf * (case when list_contains({words_in(P.BOOSTED_SECTIONS)}, section) then 1.3 else 1.0 end) + 0.25 * position + 0.15 * length
        + (case when regexp_matches(sentence, {q('(?i)' + P.CUE)}) then 2.0 else 0.0 end) + (case when regexp_matches(sentence, '\\p{{Nd}}') then 0.3 else 0.0 end), 10) as score from sectioned)"""


def filled(source: str, budget: str, eligible: str) -> str:
    """A CTE body: the greedy character fill by falling score, as (doc_id, chosen)."""
    return f"""select doc_id, list_reduce(list_prepend({{'used': 0::bigint, 'chosen': []::bigint[], 'i': -1::bigint, 'len': 0::bigint}},
        list({{'used': 0::bigint, 'chosen': []::bigint[], 'i': sent_idx::bigint, 'len': length(sentence)::bigint}} order by score desc, sent_idx)),
        lambda st, x: case when st.used + x.len + (case when len(st.chosen) > 0 then 1 else 0 end) <= {budget}
            then {{'used': st.used + x.len + (case when len(st.chosen) > 0 then 1 else 0 end), 'chosen': list_append(st.chosen, x.i), 'i': -1::bigint, 'len': 0::bigint}} else st end).chosen as chosen
        from {source} where {eligible} group by doc_id"""


def truncated(x: str, most: str) -> str:
    return f"case when length({x}) <= {most} then {x} else {x}[1:greatest({most} - 3, 0)] || '...' end"
