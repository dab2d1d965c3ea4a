"""Queries of sequence labelling, nearest names, noun chunks and key phrases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import chain, enrich, graph, keyphrases, nearest, scoring
from . import catalog as K
from . import corpora as C
from . import oracle as O
from .corpora import quoted as q

query = K.query

# ---- labels for a corpus -------------------------------------------------------------


def _label_sql(parts: str) -> str:
    has = lambda *lists: f"len(list_filter({parts}, lambda w: list_contains({O.words_in([x for of in lists for x in of])}, w))) > 0"
    return f"case when {has(P.ORG_SUFFIXES, P.ORGS)} or list_contains({parts}, '&') then 'ORG' when {has(P.FIRST_NAMES)} then 'PERSON' when {has(P.COUNTRIES, P.PLACES)} then 'PLACE' else 'MISC' end"


def _corpus_labels_sql(corpus: str) -> str:
    """CTEs up to ``labelled`` (doc_id, start, end, label, text); names by their words, without a mark between."""
    reach = "{'reach': 0::bigint, 'taken': []::bigint[], 'spot': 0::bigint, 'n': 0::bigint}"
    grown = "{'reach': x.spot + x.n, 'taken': list_append(z.taken, x.spot), 'spot': 0::bigint, 'n': 0::bigint}"
    return f"""corpus as ({corpus}), {K._entities_sql('select * from corpus')},
    nm as (select distinct entity as name, len(string_split(entity, ' ')) as n, {_label_sql("string_split(lower(entity), ' ')")} as label from names where len(string_split(entity, ' ')) <= {chain.LONGEST_NAME}),
    sp0 as (select doc_id, regexp_extract_all(text, {K._SPANS}) as h, string_split_regex(text, {K._SPANS}) as g from corpus), sk0 as (select doc_id, unnest(h) as token, unnest(g[1:len(h)]) as gap, generate_subscripts(h, 1) - 1 as tok from sp0),
    se0 as (select *, sum(strlen(gap) + strlen(token)) over (partition by doc_id order by tok) as e from sk0), wl as (select *, row_number() over (partition by doc_id order by tok) as spot from se0 where regexp_matches(token, '^[\\p{{L}}\\p{{N}}'']|^&$')),
    wa as (select doc_id, list(token order by spot) as w, list(e order by spot) as e from wl group by doc_id), st0 as (select wl.doc_id, spot, e - strlen(token) as s from wl where regexp_matches(token, '^\\p{{Lu}}')),
    tr as (select st0.doc_id, spot, s, k, array_to_string(w[spot:spot + k - 1], ' ') as name, wa.e[spot + k - 1] as e from st0 join wa using (doc_id), (select unnest(range(1, {chain.LONGEST_NAME + 1})) as k) where spot + k - 1 <= len(w)),
    mt as (select tr.*, label from tr join nm on tr.name = nm.name and tr.k = nm.n),
    taken as (select doc_id, list_reduce(list_prepend({reach}, list({{'reach': 0::bigint, 'taken': []::bigint[], 'spot': spot::bigint, 'n': k::bigint}} order by spot, k desc)), lambda z, x: case when x.spot >= z.reach then {grown} else z end).taken as taken from mt group by doc_id),
    labelled as (select mt.doc_id, cast(s as integer) as "start", cast(mt.e as integer) as "end", label, name as text from mt join taken on mt.doc_id = taken.doc_id and list_contains(taken, spot) qualify row_number() over (partition by mt.doc_id, spot order by k desc) = 1)"""


@query(f'with {_corpus_labels_sql(C.LEDGERS)} select doc_id, "start", "end", label, text from labelled')
def label_corpus(spark, sf_dir):
    return chain.label_corpus(C.ledgers(spark, sf_dir))


_GOLD_BIO = f"""{_corpus_labels_sql(C.DOCUMENTS)}, {K._SPAN_SQL},
    bio as (select spans.doc_id, tok, token, case when label is null then 'O' when tok = min(tok) over (partition by spans.doc_id, labelled."start") then 'B-' || label else 'I-' || label end as bio
        from spans left join labelled on spans.doc_id = labelled.doc_id and spans."start" >= labelled."start" and spans."end" <= labelled."end")"""


def _tags(spark, sf_dir):
    return chain.corpus_tags(C.documents(spark, sf_dir))


@query(f"with {_GOLD_BIO} select doc_id, tok, token, bio from bio")
def project_bio(spark, sf_dir):
    return _tags(spark, sf_dir)


@query(f"""with {_GOLD_BIO}, m as (select *, count(*) filter (bio like 'B-%') over (partition by doc_id order by tok) as run from bio)
    select doc_id, bio[3:] as label, min(tok) as first_tok, max(tok) as last_tok, string_agg(token, ' ' order by tok) as text from m where bio <> 'O' group by doc_id, run, bio[3:]""")
def merge_bio(spark, sf_dir):
    return enrich.merge_bio(_tags(spark, sf_dir))


# ---- chains --------------------------------------------------------------------------

#: A small model by hand: quarters, so that sums are exact in any order.
WEIGHTS = [
    ("bias", "O", 1.0), ("is_title", "B-MISC", 1.25), ("is_title", "I-MISC", 0.75), ("BOS", "O", 0.75), ("is_upper", "B-ORG", 0.5), ("is_digit", "O", 0.5),
    ("gaz=ORGS", "B-ORG", 3.0), ("gaz=ORG_SUFFIXES", "I-ORG", 3.25), ("gaz=FIRST_NAMES", "B-PERSON", 3.0), ("-1:gaz=FIRST_NAMES", "I-PERSON", 0.25), ("is_title", "I-PERSON", 1.0), ("-1:gaz=TITLES", "B-PERSON", 2.0),
    ("gaz=COUNTRIES", "B-PLACE", 3.0), ("gaz=PLACES", "B-PLACE", 3.0), ("+1:is_title", "B-MISC", 0.25), ("-1:is_title", "I-MISC", 0.5), ("gaz=CALENDAR", "O", 2.0), ("EOS", "O", 0.25),
]
MOVES = [(a, b, -4.0) for a in chain.LABELS for b in chain.LABELS if b[0] == "I" and a[1:] != b[1:]] + [(f"{p}-{x}", f"I-{x}", 0.75) for p in "BI" for x in ("ORG", "PERSON", "PLACE", "MISC")] + [("O", "O", 0.25)]


def _chain_sql() -> str:
    """Tokens of sentences, their features in the table, and a fold over each sentence that carries the best way to every label."""
    n, last = len(chain.LABELS), len(chain.LABELS) - 1
    gaz = {"ORGS": P.ORGS, "ORG_SUFFIXES": P.ORG_SUFFIXES, "COUNTRIES": P.COUNTRIES, "PLACES": P.PLACES, "FIRST_NAMES": P.FIRST_NAMES, "TITLES": P.TITLES, "CALENDAR": P.CALENDAR}
    plain = {"bias": "true", "is_title": "regexp_matches({w}, '^\\p{{Lu}}')", "is_upper": "regexp_full_match({w}, '\\p{{Lu}}+')", "is_digit": "regexp_full_match({w}, '[0-9]+')", "BOS": "tok = 1", "EOS": "tok = len(h)"} | {f"gaz={k}": "list_contains(%s, lower({w}))" % O.words_in(v) for k, v in gaz.items()}

    def test(feature: str) -> str:
        spot, name = (int(feature[:2]), feature[3:]) if feature[2:3] == ":" else (0, feature)
        inside = f"tok + {spot} between 1 and len(h) and " if spot else ""
        return f"coalesce({inside}{plain[name].format(w=f'h[tok + {spot}]')}, false)"

    score = lambda label: " + ".join(["0.0::double", *(f"case when {test(f)} then {w} else 0.0 end" for f, x, w in WEIGHTS if x == label)])
    moves = {(a, b): sum(w for x, y, w in MOVES if (x, y) == (a, b)) for a in chain.LABELS for b in chain.LABELS}
    # the largest sum, and of equal ones the first label: its number is kept as a digit of the way
    best = lambda j: f"list_sort([{', '.join(f'{{v: -(s.v[{i + 1}] + {moves[a, chain.LABELS[j]]}), i: {i}}}' for i, a in enumerate(chain.LABELS))}])[1]"
    step = f"list_transform([[{', '.join(best(j) for j in range(n))}]], lambda b: {{v: [{', '.join(f'x.v[{j + 1}] - b[{j + 1}].v' for j in range(n))}], p: [{', '.join(f's.p[b[{j + 1}].i + 1] || {j}' for j in range(n))}]}})[1]"
    rows = f"""tk as (select doc_id, sent_idx, regexp_extract_all(sentence, {K._SPANS}) as h from s), te as (select doc_id, sent_idx, h, unnest(range(1, len(h) + 1)) as tok from tk),
    sc as (select doc_id, sent_idx, tok, h[tok] as token, [{', '.join(score(x) for x in chain.LABELS)}] as v from te)"""
    fold = f"list_reduce(list({{v: v, p: [{', '.join(repr(str(j)) for j in range(n))}]}} order by tok), lambda s, x: {step})"
    return f"""with s as ({K._sentence_sql(C.LEDGERS)}), {rows}, fo as (select doc_id, sent_idx, {fold} as f, list(token order by tok) as t from sc group by doc_id, sent_idx),
    w as (select doc_id, sent_idx, t, f.p[list_position(f.v, list_max(f.v))] as way from fo)
    select doc_id, cast(sent_idx as integer) as sent_idx, cast(generate_subscripts(t, 1) - 1 as integer) as tok, unnest(t) as token, unnest(list_transform(string_split(way, ''), lambda c: {O.words_in(list(chain.LABELS))}[cast(c as integer) + 1])) as bio from w"""


def _sentences(docs):
    return scoring.sentences(docs).withColumn("sid", F.struct("doc_id", "sent_idx")).select("sid", "sentence")


@query(_chain_sql())
def chain_labels(spark, sf_dir):
    weights, moves = spark.createDataFrame(WEIGHTS, "feature string, label string, weight double"), spark.createDataFrame(MOVES, "before string, label string, weight double")
    return chain.text_labels(_sentences(C.ledgers(spark, sf_dir)), weights, moves).select("sid.doc_id", "sid.sent_idx", "tok", "token", "bio")


@query()
def learned_names(spark, sf_dir):
    """Agreement on every tenth document with a model trained on the others."""
    sentences = _sentences(C.ledgers(spark, sf_dir))
    _, agreed = chain.learn_names(sentences, held_out=F.pmod(F.col("sid.doc_id"), F.lit(10)) == 0)
    return agreed.select("label", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


# ---- nearest names, chunks -----------------------------------------------------------


def _nearest_sql(corpus: str) -> str:
    canon = "regexp_replace(regexp_replace(lower(entity), '^(?:the|an?) ', ''), ' ?''s?$', '')"
    number = "regexp_matches(word, '^[$€£]?[0-9]')"
    said = f"list_filter(list_distinct(list_transform(list_filter(t, lambda w: {K._class_sql('w')} = 'VERB'), lambda w: case when {K._in('w', P.GROWTH_VERBS)} then 'growth' when {K._in('w', P.DECLINE_VERBS)} then 'decline' end)), lambda x: x is not null)"
    return f"""with s as ({K._sentence_sql(corpus)}), sid as (select {{'d': doc_id, 'i': sent_idx}} as doc_id, sentence as text from s), {K._entities_sql('select * from sid', nearest.PIECE)},
    cn as (select doc_id, first, last, {canon} as entity from names where length({canon}) >= 3), pl as (select doc_id.d as d, entity, count(distinct doc_id) as n from cn group by all),
    kn as (select d, entity from pl where n >= 2 or (len(string_split(entity, ' ')) between 2 and 3 and len(list_filter(string_split(entity, ' '), lambda w: length(w) < 3)) = 0)),
    an as (select cn.* from cn join kn on cn.doc_id.d = kn.d and cn.entity = kn.entity),
    tn as (select *, lead(word) over o as nw, lead(pos) over o as np from wd window o as (partition by doc_id order by pos)),
    nu as (select doc_id, pos, case when np = pos + 1 and {K._class_sql('nw')} = 'NOUN' then word || ' ' || nw else word end as number from tn where {number}),
    al as (select nu.*, an.entity, an.first, case when nu.pos between an.first and an.last then 0 when nu.pos > an.last then nu.pos - an.last else an.first - nu.pos end as distance from nu join an using (doc_id)),
    ne as (select doc_id, pos, number, entity, distance from al qualify row_number() over (partition by doc_id, pos order by distance, first) = 1),
    {K._TAGGED}, po as (select {{'d': doc_id, 'i': sent_idx}} as doc_id, sentence, unnest(case when len({said}) > 0 then {said} else ['absolute'] end) as polarity from tg),
    fa as (select doc_id, entity, number, polarity, sentence, min(pos) as pos, arg_min(distance, pos) as distance from ne join po using (doc_id) group by all)
    select doc_id.d as doc_id, cast(doc_id.i as integer) as sent_idx, cast(pos - 1 as integer) as pos, entity, number, polarity, cast(distance as integer) as distance, sentence from fa qualify count(*) over (partition by doc_id.d, entity) >= 2"""


@query(_nearest_sql(C.LEDGERS))
def nearest_facts(spark, sf_dir):
    return nearest.nearest_facts(C.ledgers(spark, sf_dir))


@query(_nearest_sql(C.NARRATIVES))
def nearest_facts_narratives(spark, sf_dir):
    return nearest.nearest_facts(C.narratives(spark, sf_dir))


def _chunks_sql(corpus: str) -> str:
    """Chunks as islands: modifiers and nouns side by side, cut before a modifier behind a noun, and behind the last noun."""
    return f"""s as ({K._sentence_sql(corpus)}), {K._TAGGED}, tr as (select doc_id, sent_idx, unnest(t) as token, generate_subscripts(t, 1) - 1 as pos from tg),
    kd as (select *, case {K._class_sql('token')} when 'ADJ' then 'J' when 'NUM' then 'J' when 'NOUN' then 'N' when 'PROPN' then 'N' else '.' end as k from tr),
    il as (select *, k <> '.' and not coalesce(lag(k) over o in ('J', 'N') and not (lag(k) over o = 'N' and k = 'J'), false) as new from kd window o as (partition by doc_id, sent_idx order by pos)),
    ru as (select *, count(*) filter (new) over (partition by doc_id, sent_idx order by pos) as run from il), rl as (select *, max(case when k = 'N' then pos end) over (partition by doc_id, sent_idx, run) as until from ru where k <> '.'),
    chunks as (select doc_id, sent_idx, min(pos) as pos, count(*) as size, string_agg(lower(token), ' ' order by pos) as chunk from rl where pos <= until group by doc_id, sent_idx, run having count(*) >= 2)"""


@query(f"with {_chunks_sql(C.LEDGERS)} select doc_id, cast(sent_idx as integer) as sent_idx, cast(pos as integer) as pos, cast(size as integer) as size, chunk from chunks")
def noun_chunks(spark, sf_dir):
    return nearest.noun_chunks(C.ledgers(spark, sf_dir))


@query(
    f"with {_chunks_sql(C.NARRATIVES)}, c as (select doc_id, chunk, count(*) as n, min({{'a': sent_idx, 'b': pos}}) as spot from chunks group by all), k as (select * from c where n >= 2 or list_has_any(string_split(chunk, ' '), ['segment', 'london']))"
    f" select d.doc_id, coalesce(string_agg(chunk, '|' order by n < 2, spot), '') as phrases from ({C.NARRATIVES}) d left join k using (doc_id) group by d.doc_id"
)
def noun_phrases(spark, sf_dir):
    rows = nearest.noun_phrases(C.narratives(spark, sf_dir), "segment, London")
    return rows.select("doc_id", F.array_join("phrases", "|").alias("phrases"))


# ---- key phrases ---------------------------------------------------------------------


def _keyphrase_sql(corpus: str) -> str:
    usable = lambda w: f"(regexp_full_match({w}, '[\\p{{L}}''-]{{3,}}') and not list_contains({O.words_in(P.STOPWORDS)}, {w}))"
    share = lambda a, b: f"case when {b} > 0 then {a} / {b} else 0.0 end"
    related = f"(1 + ({share('left_words', 'lefts')} + {share('right_words', 'rights')}) * n / most)"
    return f"""with s as ({K._sentence_sql(corpus)}), pc as (select doc_id, sent_idx, unnest(regexp_extract_all(sentence, {q(keyphrases.PIECE)})) as word, generate_subscripts(regexp_extract_all(sentence, {q(keyphrases.PIECE)}), 1) - 1 as pos from s),
    pr as (select *, regexp_matches(word, '^[\\p{{L}}\\p{{N}}]') as w, count(*) filter (not regexp_matches(word, '^[\\p{{L}}\\p{{N}}]')) over (partition by doc_id, sent_idx order by pos) as run from pc), tk as (select *, lower(word) as term from pr where w),
    nb as (select *, lag(term) over o as l, lead(term) over o as r from tk window o as (partition by doc_id, sent_idx, run order by pos)),
    wd as (select doc_id, term, count(*) as n, count(*) filter (regexp_matches(word, '^\\p{{Lu}}') and pos > 0) as capitals, count(*) filter (regexp_full_match(word, '\\p{{Lu}}{{2,}}')) as acronyms, count(distinct sent_idx) as sentences, median(sent_idx) as middle,
        count(l) as lefts, count(distinct l) as left_words, count(r) as rights, count(distinct r) as right_words from nb group by doc_id, term),
    dl as (select *, max(n) over d as most, coalesce(avg(case when {usable('term')} then n end) over d, 0.0) as mean, coalesce(stddev_pop(case when {usable('term')} then n end) over d, 0.0) as spread, (select max(sent_idx) + 1 from tk where tk.doc_id = wd.doc_id) as in_all from wd window d as (partition by doc_id)),
    wt as (select doc_id, term, round({related} * ln(ln(3 + middle)) / (greatest(capitals, acronyms) / (1 + ln(n)) + n / greatest(mean + spread, 1.0) / {related} + sentences / in_all / {related}), {keyphrases.DECIMALS}) as weight from dl),
    ng as (select doc_id, sent_idx, pos, [term] as t from tk union all select doc_id, sent_idx, pos, [term, r] from nb where r is not null),
    ph as (select doc_id, t, count(*) as n, min({{'a': sent_idx, 'b': pos}}) as spot from ng where {usable('t[1]')} and {usable('t[len(t)]')} group by doc_id, t),
    sc as (select ph.doc_id, t, n, spot, round(coalesce(x.weight * y.weight, x.weight) / (n * (1 + x.weight + coalesce(y.weight, 0.0))), {keyphrases.DECIMALS}) as score from ph join wt x on x.doc_id = ph.doc_id and x.term = t[1] left join wt y on y.doc_id = ph.doc_id and y.term = t[2]),
    scored as (select doc_id, array_to_string(t, ' ') as phrase, cast(len(t) as integer) as size, n, score, spot from sc)"""


def _ranked_sql(corpus: str, top: int = 40, alike: float = 0.9) -> str:
    zero = "{'k': []::struct(p varchar, s double, z integer)[], 'p': '', 's': 0.0::double, 'z': 0::integer}"
    near = f"len(list_filter(s.k, lambda y: 1 - levenshtein(y.p, x.p) / greatest(length(y.p), length(x.p)) > {alike})) > 0"
    grown = "{'k': list_append(s.k, {'p': x.p, 's': x.s, 'z': x.z}), 'p': '', 's': 0.0::double, 'z': 0::integer}"
    return f"""{_keyphrase_sql(corpus)}, kp as (select doc_id, list_filter(list_reduce(list_prepend({zero}, list({{'k': []::struct(p varchar, s double, z integer)[], 'p': phrase, 's': score, 'z': size}} order by score, spot, phrase)), lambda s, x: case when len(s.k) < {top} and not {near} then {grown} else s end).k, lambda y: y.z >= 2) as k from scored group by doc_id)
    select doc_id, cast(generate_subscripts(k, 1) - 1 as integer) as rank, unnest(k).p as phrase, unnest(k).s as score from kp"""


@query(_ranked_sql(C.DOCUMENTS))
def keyphrases_documents(spark, sf_dir):
    return keyphrases.keyphrases(C.documents(spark, sf_dir)).select("doc_id", "rank", "phrase", "score")


@query(f"{_keyphrase_sql(C.DOCUMENTS)} select doc_id, phrase, size, n, score from scored")
def phrase_weights(spark, sf_dir):
    return keyphrases.phrase_weights(C.documents(spark, sf_dir)).select("doc_id", "phrase", "size", "n", "score")


# ---- terms that keep like company ----------------------------------------------------

_ASKED = ["apache", "license", "software", "there", "then"]


def _similar_sql(corpus: str, top: int = 5, least: float = 0.2) -> str:
    near = f"flatten(list_transform(range(1, len(t) + 1), lambda i: list_transform(t[i + 1:i + {graph.WINDOW - 1}], lambda b: {{'a': least(t[i], b), 'b': greatest(t[i], b)}})))"
    return f"""with t as (select doc_id, {O.tokens('text')} as t from ({corpus})), p as (select unnest({near}) as p from t), w as (select p.a as a, p.b as b, count(*) as w from p where p.a <> p.b group by all),
    bo as (select a as term, b as context, w from w union all select b, a, w from w), d as (select term, sum(w) as d from bo group by term), tot as (select sum(d) as n from d),
    v as (select bo.term, bo.context, ln(w * n / (x.d * y.d)) as x from bo join d x on x.term = bo.term join d y on y.term = bo.context, tot where w >= 2 and ln(w * n / (x.d * y.d)) > 0), nm as (select term, sqrt(sum(x * x)) as norm from v group by term),
    ds as (select q.term as asked, v.term, sum(q.x * v.x) as dot from v q join v using (context) where q.term <> v.term and q.term in ({', '.join(map(q, _ASKED))}) group by all),
    c as (select asked, ds.term, round(dot / (m.norm * n.norm), 8) as cosine from ds join nm m on m.term = ds.term join nm n on n.term = asked)
    select asked as term, term as similar, cosine from c where cosine >= {least} qualify row_number() over (partition by asked order by cosine desc, term) <= {top}"""


@query(_similar_sql(C.DOCUMENTS))
def similar_terms(spark, sf_dir):
    return graph.similar_terms(C.documents(spark, sf_dir), spark.createDataFrame([(t,) for t in _ASKED], "term string"))


@query()
def ranked_nodes(spark, sf_dir):
    """The rank of every sentence of a document."""
    # the order of a sum decides decimals from the fifteenth on, and so how a score like 1 / 128 is rounded
    return graph.sentence_ranks(C.documents(spark, sf_dir)).withColumn("score", F.round(F.round("score", 12), 6))
