"""DuckDB SQL for those of the queries that SQL can state."""

from __future__ import annotations

from . import decontam, linededup, pii, warc
from . import prefix_trie as trie
from . import repair as r


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def merkle_fixity() -> str:
    """Both replicas record by record: equal places first, then equal bytes, then equal ids."""
    n = warc.ARCHIVE_RECORDS
    crlf = "chr(13) || chr(10)"

    def record(html: str) -> str:
        return (
            f"'WARC/1.0' || {crlf} || 'WARC-Type: resource' || {crlf} || 'WARC-Date: {warc.DATE}' || {crlf} || 'WARC-Record-ID: <urn:record:' || coalesce(cast(page_id as varchar), '') || '>' || {crlf} || 'WARC-Target-URI: ' || coalesce(url, '')"
            f" || {crlf} || 'Content-Type: text/html' || {crlf} || 'Content-Length: ' || strlen(coalesce({html}, '')) || {crlf} || {crlf} || coalesce({html}, '') || {crlf} || {crlf}"
        )

    def placed(name: str, rows: str) -> str:
        return f"""{name} as (select page_id, archive, row_number() over o - 1 as seq, sum(size) over o - size as s, sum(size) over o as e, digest
        from (select page_id, floor(page_id / {n}.0) as archive, first, sha256(b) as digest, strlen(b) as size from ({rows})) window o as (partition by archive order by first, page_id, digest))"""

    def pair(number: int, left: str, right: str, by: str) -> str:
        ranked = lambda t: f"(select *, row_number() over (partition by archive, {by} order by seq) as k from {t})"
        same = f"a.archive is not distinct from b.archive and a.{by} is not distinct from b.{by} and a.k = b.k"
        return f"""p{number} as (select a.* exclude (k) from {ranked(left)} a semi join {ranked(right)} b on {same}), l{number} as (select a.* exclude (k) from {ranked(left)} a anti join {ranked(right)} b on {same}), r{number} as (select b.* exclude (k) from {ranked(right)} b anti join {ranked(left)} a on {same})"""

    other = "left(html, greatest(length(html) - 1, 0)) || case when right(html, 1) = '?' then '!' else '?' end"
    same = "a.archive is not distinct from b.archive and a.seq = b.seq and a.s = b.s and a.e = b.e and a.digest = b.digest"
    return f"""with g as (select page_id, url, html, sha256({record('html')}) as good from pages where true), kept as (select * from g where not starts_with(good, '1a')),
    t as (select page_id, url, case when starts_with(good, '0') then coalesce({other}, '?') else html end as html, cast(starts_with(good, '3c') as int) as first from kept
        union all select page_id, url, coalesce(html, '') || '+', 0 from kept where starts_with(good, '2b')),
    {placed('ours', f"select page_id, 0 as first, {record('html')} as b from pages")}, {placed('theirs', f"select page_id, first, {record('html')} as b from t")},
    p0 as (select a.* from ours a semi join theirs b on {same}), l0 as (select a.* from ours a anti join theirs b on {same}), r0 as (select b.* from theirs b anti join ours a on {same}),
    {pair(1, 'l0', 'r0', 'digest')}, {pair(2, 'l1', 'r1', 'page_id')},
    f as (select *, 'intact' as status from p0 union all select *, 'moved' from p1 union all select *, 'changed' from p2 union all select *, 'missing' from l2 union all select *, 'extra' from r2)
    select page_id, cast(archive as bigint) as archive, seq, cast(s as bigint) as start_offset, cast(e as bigint) as end_offset, digest, status from f"""


def line_dedup() -> str:
    """Equal lines by their words; long enough lines less each of their symbols, as whole strings.
    A space follows each word and is before each character, so that the two never meet."""
    chars = "list_transform(regexp_extract_all(whole, '(?s).'), lambda c: ' ' || c)"
    words = "list_transform(w, lambda x: x || ' ')"
    return f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as no from documents),
    w as (select *, regexp_extract_all(lower(line), '\\S+') as w, array_to_string(regexp_extract_all(lower(line), '\\S+'), ' ') as whole, [doc_id, no] as place from l),
    every as (select * from w where len(w) > 0),
    k as (select doc_id, no, place, case when len(w) >= {linededup.MIN_WORDS} then {words} else {chars} end as w from every where len(w) >= {linededup.MIN_WORDS} or length(whole) >= {linededup.MIN_CHARS}),
    s as (select *, array_to_string(w, '') as whole from k), v as (select *, unnest(range(1, len(w) + 1)) as cut from k),
    d as (select doc_id, no, place, len(w) as n, cut, array_to_string(list_concat(w[1:cut - 1], w[cut + 1:]), '') as rest from v),
    gone as (
        select doc_id, no from every qualify min(place) over (partition by whole) < place
        union select doc_id, no from d qualify min(place) over (partition by n, cut, rest) < place
        union select d.doc_id, d.no from d join s on d.rest = s.whole where s.place < d.place
        union select s.doc_id, s.no from d join s on d.rest = s.whole where d.place < s.place)
    select l.doc_id, count(*) as n_lines, count(g.no) as n_dropped, coalesce(string_agg(case when g.no is null then line end, chr(10) order by l.no), '') as text from l left join gone g on l.doc_id = g.doc_id and l.no = g.no group by l.doc_id"""


def embedding_dedup(threshold: float = 0.95) -> str:
    """All pairs, and the closure of the links."""
    return f"""with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings), n as (select vec_id, e, sqrt(list_dot_product(e, e)) as norm from v),
    links as (select a.vec_id as a, b.vec_id as b from n a join n b on a.vec_id <> b.vec_id where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {threshold}),
    reach as (select vec_id as a, vec_id as b from v union select r.a, l.b from reach r join links l on r.b = l.a),
    c as (select a, min(b) as component_id from reach group by a), d as (select a, count(*) as n from links group by a)
    select vec_id, coalesce(d.n, 0) as n_links, component_id, vec_id = component_id as kept from v join c on vec_id = c.a left join d on vec_id = d.a"""


def decontamination() -> str:
    words = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""with i as (select item_id, {words} as w from benchmark), s as (select item_id, w, least({decontam.WINDOW}, len(w)) as n from i where len(w) > 0),
    iw as (select distinct item_id, n, array_to_string(w[j:j + n - 1], ' ') as win from (select *, unnest(range(1, len(w) - n + 2)) as j from s)), sizes as (select distinct n from iw),
    d as (select doc_id, {words} as w from documents), dw as (select doc_id, n, j, array_to_string(w[j:j + n - 1], ' ') as win from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as j from d, sizes where len(w) >= n)),
    hits as (select doc_id, item_id, j, dw.n from dw join iw on dw.n = iw.n and dw.win = iw.win), marked as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(j, j + n)) as p from hits) group by doc_id),
    met as (select doc_id, count(item) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
    select doc_id, cast(coalesce(len(w), 0) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
    coalesce(n_hit, 0) > 0 and {decontam.ONE_IN} * coalesce(n_hit, 0) >= len(w) as contaminated from d left join marked using (doc_id) left join met using (doc_id)"""


def personal_data() -> str:
    """The plain patterns, leftmost first, then the checks, then the words around what is left."""
    digits = "regexp_replace(hit, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(list_reverse(string_split({digits}, '')), lambda c, i: case when i % 2 = 1 then cast(c as integer) else 2 * cast(c as integer) - (case when cast(c as integer) > 4 then 9 else 0 end) end)) % 10 = 0"
    small = "len(list_filter(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) > 3 or cast('0' || right(p, 3) as integer) > 255)) = 0"
    value = "case when regexp_matches(c, '[0-9]') then c else cast(ascii(c) - 55 as varchar) end"
    plain = "replace(hit, ' ', '')"
    # the remainder of a long number, digit by digit
    mod97 = f"list_reduce(list_prepend(0, list_transform(string_split(array_to_string(list_transform(string_split({plain}[5:] || {plain}[1:4], ''), lambda c: {value}), ''), ''), lambda c: cast(c as integer))), lambda a, b: (a * 10 + b) % 97) = 1"
    shape = "[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)"
    local = f"length({digits}) between 7 and 12 and not ends_with(gap, '+') and not regexp_matches(hit, '^[0-9]+(\\.[0-9]+){{2,3}}$|^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')"
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", small),
        ("card", r"[0-9](?:[ -]?[0-9])+", f"length({digits}) between 16 and 19 and {luhn}"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) between 8 and 15"),
        ("iban", "", mod97),
        ("local", r"[0-9][0-9().\x20/-]*[0-9]", local),
    ]
    parts = []
    for order, ((kind, pattern, valid), rule) in enumerate(zip(kinds, pii.KINDS)):
        p = _q(pattern)
        if kind == "iban":  # every place where one can start; the longest shape that ends with its word
            begins = "list_filter(range(1, length(text) + 1), lambda i: regexp_matches(substr(text, i, 4), '[A-Z]{2}[0-9]{2}') and not regexp_matches(substr(text, i - 1, 1), '[A-Za-z0-9]'))"
            some = "select doc_id, text, unnest(%s) as i from documents where regexp_matches(text, '[A-Z]{2}[0-9]{2}[ A-Z0-9][A-Z0-9]')" % begins
            ends = f"select doc_id, i, regexp_extract(substr(text, i, 60), '^({shape})(?:[^A-Za-z0-9]|$)', 1) as hit from ({some})"
            placed = f"select doc_id, hit, '' as gap, i - 1 + length(hit) as e from ({ends}) where hit <> ''"
        else:
            ends = f"select doc_id, unnest(h) as hit, unnest(g[1:len(h)]) as gap, generate_subscripts(h, 1) as k from (select doc_id, regexp_extract_all(coalesce(text, ''), {p}) as h, string_split_regex(coalesce(text, ''), {p}) as g from documents)"
            placed = f"select doc_id, hit, gap, sum(length(gap) + length(hit)) over (partition by doc_id order by k) as e from ({ends})"
        checked = f"select doc_id, cast(e - length(hit) as bigint) as s, cast(e as bigint) as e from ({placed}) where {valid}"
        near = lambda text: f"regexp_matches(lower({text}), '\\b(?:{rule.near})')"  # noqa: B023, E731
        score = f"{rule.score} + case when {near(f'substr(text, greatest(s - {pii.BEFORE}, 0) + 1, least(s, {pii.BEFORE}))')} then {pii.ADDS_BEFORE} else 0 end + case when {near(f'substr(text, e + 1, {pii.BEHIND})')} then {pii.ADDS_BEHIND} else 0 end"
        scored = f"select doc_id, {order} as o, '{kind}' as kind, s, e, {score} as score from ({checked}) join documents using (doc_id)"
        parts.append(f"select * from ({scored}) where score >= {rule.least or 0}")
    counts = ", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k, _, _ in kinds)
    one = "kind || ':' || s || ':' || e"
    return f"""with spans as ({' union all '.join(parts)}), a as (select doc_id, {counts}, string_agg({one}, ',' order by o, s) filter (o < 4) as base, string_agg({one}, ',' order by o, s) as spans, string_agg(cast(score as varchar), ',' order by o, s) as scores from spans group by doc_id)
    select documents.doc_id, {', '.join(f'coalesce(n_{k}, 0) as n_{k}' for k, _, _ in kinds)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(scores, '') as scores from documents left join a on documents.doc_id = a.doc_id"""


def _crc32(text: str) -> str:
    """The checksum bit by bit: a byte enters, and seven steps without one follow."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [cast(ascii(c) as bigint), 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {steps}), lambda x, e: xor(xor(x, e) >> 1, 3988292384::bigint * (xor(x, e) & 1))), 4294967295::bigint)"


def prefix_trie() -> str:
    """Prefixes as hashes of joined turns; a node's subtree by the prefixes of its smallest conversation."""
    block, shared = trie.BLOCK, trie.SHARED_TURNS
    role, text = "coalesce(role, '')", "coalesce(text, '')"
    return f"""with t as (select conv_id, turn, length({role}) || ':' || {role} || ':' || {text} as e, len(regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')) as n from conversations where conv_id is not null),
    c as (select conv_id, list({{e: sha256(e), n: n}} order by turn nulls first, sha256(e)) as own, {_crc32('cast(conv_id as varchar)')} % {shared} as h from t group by conv_id),
    r as (select c.conv_id, list_concat(coalesce(f.own, [])[1:c.h], c.own[c.h + 1:]) as l from c left join c f on f.conv_id = c.conv_id - c.conv_id % {block}),
    m as (select conv_id, d, md5(array_to_string(list_transform(l[1:d], lambda x: x.e), ',')) as k, md5(array_to_string(list_transform(l[1:d - 1], lambda x: x.e), ',')) as pk, d = len(l) as ends, coalesce(l[d].n, 0) as n from (select *, unnest(range(0, len(l) + 1)) as d from r)),
    v as (select d, k, min(pk) as pk, min(conv_id) as conv_id, count(*) as n_convs, min(n) as n, sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends), '')) as ends_sha256 from m group by d, k),
    kids as (select d - 1 as d, pk as k, count(*) as n_children from v where d > 0 group by 1, 2),
    below as (select m.d, m.k, sum(case when kids.k is null then 1 else 0 end) as n_leaves, sum((v.n_convs - 1) * v.n) as saved from v left join kids on kids.d = v.d and kids.k = v.k join m on m.conv_id = v.conv_id and m.d <= v.d group by 1, 2)
    select v.conv_id, v.d as depth, p.conv_id as parent_conv_id, v.n_convs, coalesce(n_children, 0) as n_children, cast(n_leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, v.ends_sha256
    from v left join v p on p.d = v.d - 1 and p.k = v.pk left join kids on kids.d = v.d and kids.k = v.k join below on below.d = v.d and below.k = v.k"""


def conversation_repair() -> str:
    """A fold over the rows of a conversation: for each role so far the cheapest
    edits, least by letters among equals, with what they leave."""
    role, text = "case when code = 4 then 'user' else role end", "case code when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end"
    key = "coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')"
    least = lambda *ways: f"list_sort(list_filter([{', '.join(ways)}], lambda w: w.cost is not null))[1]"
    step = lambda way, cost, letter, line="''": f"{{cost: {way}.cost + {cost}, audit: {way}.audit || '{letter}', out: {way}.out || {line}}}"
    none = "{cost: null::bigint, audit: null::varchar, out: null::varchar}"
    insert = lambda way, name: step(way, r.INSERT, "I", f"chr(10) || '{name}:'")
    only = lambda rule, way: f"case when {rule} then {way} else {none} end"
    b = [f"s.best[{i + 1}]" for i in range(4)]
    charge = f"case when e.code in ('S', 'U', 'A', 'X') then {r.TRUNCATED} else 0 end"
    stays = "e.code not in ('b', 'd')"
    keep = lambda i, letter: only(f"lower(e.code) = '{letter}'", step(b[i], charge, "K", "chr(10) || e.role || ':' || e.text"))
    rerole = lambda i, name: only(stays, step(b[i], f"{r.REROLE} + {charge}", "R", f"chr(10) || '{name}:' || e.text"))
    gone = lambda i: step(b[i], r.DELETE, "D")
    after = [gone(0), least(gone(1), keep(0, "s")), least(gone(2), *(f(i, x) for i in (0, 1, 3) for f, x in ((keep, "u"), (rerole, "user")))), least(gone(3), keep(2, "a"), rerole(2, "assistant"))]
    more = lambda n: "[" + ", ".join([f"{n}[1]", f"{n}[2]", least(f"{n}[3]", *(insert(f"{n}[{i}]", "user") for i in (1, 2, 4))), least(f"{n}[4]", insert(f"{n}[3]", "assistant"), *(insert(insert(f"{n}[{i}]", "user"), "assistant") for i in (1, 2)))]) + "]"
    # a list of one, so that a step's four ways have a name
    closed = lambda ways: f"list_transform([[{', '.join(ways)}]], lambda n: {more('n')})[1]"
    zero = "{cost: 0::bigint, audit: ''::varchar, out: ''::varchar}"
    begin = f"{{code: '', role: '', text: '', best: {closed([zero, none, none, none])}}}"
    return f"""with k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_crc32(key)} % 20 as code from conversations),
    d as (select conv_id, turn, {role} as role, {text} as text from k, (select unnest([1, 2]) as copy) where code <> 0 and (copy = 1 or code = 3)),
    o as (select *, row_number() over (partition by conv_id order by turn nulls first, sha256(length(role) || ':' || role || ':' || text)) as pos from d),
    f as (select *, case when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else 'x' end as initial, row_number() over (partition by conv_id, role, text order by pos) > 1 as again, lag(left(role, 1)) over (partition by conv_id order by pos) as before from o),
    c as (select *, case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'b' when again then 'd' when regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') then initial else upper(initial) end as code from f),
    g as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (code = 'b') as blank, count(*) filter (code = 'd') as duplicate, count(*) filter (code in ('S', 'U', 'A', 'X')) as truncated,
        count(*) filter (before || left(role, 1) not in ('su', 'ua', 'au')) as illegal, list_reduce(list_prepend({begin}, list({{code: code, role: role, text: text, best: null}} order by pos)), lambda s, e: {{code: '', role: '', text: '', best: {closed(after)}}}).best as best from c group by conv_id),
    h as (select *, {least("best[1]", "best[4]")} as way from g), ids as (select distinct conv_id from conversations)
    select ids.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(way.cost, 0) as cost, coalesce(way.audit, '') as audit, sha256(coalesce(substr(way.out, 2), '')) as repaired_sha256
    from ids left join h on ids.conv_id is not distinct from h.conv_id"""
