"""Operators 1, 5 and 6 against brute force."""

from __future__ import annotations

import numpy as np
import pytest
import xxhash

from inkstone.llm import embed_hnsw, linededup, simhash
from inkstone.llm.queries import QUERIES
from inkstone.llm.shared import connected_components

DOCS = "doc_id long, text string, fp string, component_id long"


def union(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def slow_print(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").split(" ")]
    words = [w for x in words for w in x.replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(p.encode(), 42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    prints = [slow_print(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    roots = union(len(rows), links)
    least = {}
    for (doc, _), r in zip(rows, roots):
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    return sorted((str(d), f"{p:016x}", least.get(r)) for (d, _), p, r in zip(rows, prints, roots))


def test_simhash_query_matches_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in QUERIES["op1_simhash"](spark, sf_dir).collect())
    assert got == slow_components(rows)


def test_simhash_edges(spark):
    long = " ".join(f"w{i % 977}" for i in range(70_000))
    rows = [(1, None), (2, ""), (3, "One two"), (4, "one  TWO"), (None, "one two"), (5, long), (5, long), (6, long + " x"), (7, "É é ß")]
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.simhash_components(spark.createDataFrame([(d, t, "x", 0) for d, t in rows], DOCS)).collect())
    assert got == slow_components(rows)
    empty = spark.createDataFrame([], DOCS)
    assert simhash.simhash_components(empty).collect() == []
    kept = simhash.keep_one(spark.createDataFrame([(d, t, "x", 0) for d, t in rows], DOCS))
    assert kept.columns == ["doc_id", "text", "fp", "component_id"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "5", "5", "7", "None"]


def test_keep_one_judges_rows_that_share_an_id(spark):
    text = "the same text of some words here"
    rows = [(1, text), (5, text), (5, "something unrelated to all the others of this table"), (7, "another one of which there is no copy at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for keep in (simhash.keep_one, simhash.keep_one_similar):
        assert sorted(tuple(r) for r in keep(docs).collect()) == sorted([rows[0], *rows[2:]])


def slow_similar(rows, width=5, least=0.8):
    def sets(text):
        words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()

    known = [sets(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(known[i] & known[j]) >= least * len(known[i] | known[j])]
    return union(len(rows), links)


def test_similar_documents_match_brute_force(spark, sf_dir):
    rng = np.random.default_rng(6)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    for i in range(60):  # groups of near copies of one to five changed words
        words = [f"w{x}" for x in rng.integers(0, 900, rng.integers(40, 300))]
        for k in range(int(rng.integers(1, 5))):
            copy = list(words)
            for _ in range(int(rng.integers(0, 6))):
                copy[int(rng.integers(0, len(copy)))] = "changed"
            rows.append((100_000 + 10 * i + k, " ".join(copy)))
    rows += [(200_000, None), (200_001, ""), (200_002, "two words"), (200_003, "Two  words"), (None, "two words"), (200_004, rows[-1][1])]
    want, least = slow_similar(rows), {}
    for (doc, _), root in zip(rows, want):
        if doc is not None:
            least[root] = min(doc, least.get(root, doc))
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, component_id int")
    found = {r.id: r.component_id for r in simhash.similar_components(docs).collect()}
    wrong = sum(found[d] != least[r] for (d, _), r in zip(rows, want))
    assert wrong <= 0.01 * len(rows)  # a pair at the limit is met with probability 0.98
    kept = simhash.keep_one_similar(docs)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1
    assert kept.count() == len(set(found.values())) + 1
    assert simhash.keep_one_similar(docs.limit(0)).collect() == []


def crowd(apart):
    """Sixteen texts in eight similar pairs, and sketches of which all pairs meet in the first table and in no other."""
    texts = []
    for i in range(8):
        words = [f"w{i}x{j}" for j in range(60)]
        texts += [" ".join(words), " ".join([*words, "end"])]
    place = {simhash.shingle_set(t).tobytes(): k for k, t in enumerate(texts)}
    # two bits of their own in each table but the first: 4 bits between any two, 124 of all, which is neither certain nor unlikely
    bits = [[(1 << k if apart else 0) if t == 0 else 3 << 2 * k for t in range(simhash.TABLES)] for k in range(len(texts))]
    made = [np.array([b << 32 | t for t, b in enumerate(row)], np.uint64).view(np.int64) for row in bits]
    return texts, lambda sets: np.array([made[place[s.tobytes()]] for s in sets])


@pytest.mark.parametrize("apart", [False, True])
def test_every_link_of_a_crowd_is_followed(spark, monkeypatch, apart):
    """Only links of a spanning forest, and those to the first text of a value, were checked."""
    texts, made = crowd(apart)
    monkeypatch.setattr(simhash, "sketches", made)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.id: r.component_id for r in simhash.similar_components(docs).collect()} == {k: k - k % 2 for k in range(len(texts))}


def test_short_texts_with_one_sketch_are_not_similar(spark):
    seen = {}
    for i in range(2_000):
        value = int(simhash.shingle_set(f"word{i}")[0])
        seen.setdefault((value % simhash.BUCKETS, value >> 63), []).append(f"word{i}")
    one, two = next(words for words in seen.values() if len(words) > 1)[:2]
    four = " ".join("abcdefgh")
    docs = spark.createDataFrame([(1, one), (2, two), (3, one.upper()), (4, four), (5, four + " i")], "doc_id long, text string")
    assert {r.id: r.component_id for r in simhash.similar_components(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4}


def test_gray_index_meets_all_pairs():
    rng = np.random.default_rng(9)
    values = np.unique(np.concatenate([rng.integers(0, 1 << 63, 300, dtype=np.uint64), rng.integers(0, 1 << 10, 200, dtype=np.uint64)]))
    other = np.concatenate([values[::3] ^ np.uint64(1 << 9), rng.integers(0, 1 << 63, 7, dtype=np.uint64)])
    index = simhash.GrayIndex(values)
    near = np.bitwise_count(values[:, None] ^ values[None]) <= 2
    assert sorted((int(max(a, b)), int(min(a, b))) for x, y in index.meetings(None, 2) for a, b in zip(x, y)) == [(i, j) for i in range(len(values)) for j in range(i) if near[i, j]]
    near = np.bitwise_count(values[:, None] ^ other[None]) <= 2
    for few in (other, other[:3], other[:1]):
        got = sorted((int(a), int(b)) for x, y in index.meetings(simhash.GrayIndex(few), 2) for a, b in zip(x, y))
        assert got == [(i, j) for i in range(len(values)) for j in range(len(few)) if near[i, j]]


@pytest.mark.parametrize("planned,most", [(1 << 20, 1 << 20), (16, 32), (64, 40)])
def test_fingerprint_links_at_every_depth(spark, planned, most):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    near = [base[:40] ^ np.uint64((1 << int(a)) | (1 << int(b))) for a, b in rng.integers(0, 64, (6, 2))]
    crowd = np.uint64(0xABCDEF) ^ np.array([1 << a | 1 << b for a in range(20) for b in range(a)], np.uint64)
    values = np.unique(np.concatenate([base, *near, crowd])).view(np.int64)
    unsigned = values.view(np.uint64)
    links = [(i, int(j)) for i in range(len(values)) for j in np.nonzero(np.bitwise_count(unsigned ^ unsigned[i]) <= 2)[0] if j < i]
    want = union(len(values), links)
    edges = simhash.fingerprint_links(spark.createDataFrame([(int(v),) for v in values], "fp long"), 2, planned, most)
    place = {int(v): i for i, v in enumerate(values)}
    assert union(len(values), [(place[r.u], place[r.v]) for r in edges.collect()]) == want


def test_components(spark):
    edges = [(5, 4), (4, 3), (9, 8), (8, 10), (3, 1), (7, 7), (None, 2), (5, 4)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {5: 1, 4: 1, 3: 1, 1: 1, 9: 8, 10: 8, 8: 8}
    chain = spark.range(200).selectExpr("id as u", "id + 1 as v")
    assert {r.component for r in connected_components(chain).collect()} == {0}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def slow_all_lines(rows):
    lines = [(d, i, linededup.line_words(x)) for d, t in rows if t is not None for i, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2]]

    def symbols(words):
        return words if len(words) >= 5 else list(" ".join(words)) if len(" ".join(words)) >= 40 else None

    gone = {}
    for k, (d, i, w) in enumerate(lines):
        for _, _, v in lines[:k]:
            alike = (len(w) >= 5) == (len(v) >= 5) and symbols(w) and symbols(v)
            if w == v or alike and linededup.edit_distance(symbols(w), symbols(v)) <= 1:
                gone.setdefault(d, set()).add(i)
                break
    return gone


def test_line_dedup_matches_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    gone = slow_all_lines(rows)
    assert gone
    got = {r.doc_id: r for r in QUERIES["op5_line_dedup"](spark, sf_dir).collect()}
    for doc, text in rows:
        kept = [x for i, x in enumerate(text.split("\n")) if i not in gone.get(doc, ())]
        assert (got[doc].text, got[doc].n_dropped) == ("\n".join(kept), len(gone.get(doc, ())))


def test_line_dedup_random_edits(spark):
    rng = np.random.default_rng(4)
    lines = []
    for _ in range(60):
        line = [f"w{x}" for x in rng.integers(0, 4, rng.integers(4, 14))]
        for _ in range(4):
            copy, at = list(line), int(rng.integers(0, len(line)))
            [lambda: copy.pop(at), lambda: copy.insert(at, "new"), lambda: copy.__setitem__(at, "other"), lambda: None][rng.integers(0, 4)]()
            lines.append(" ".join(copy))
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[i * 8 : i * 8 + 8])) for i in range(30)]
    got = linededup.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc: set(r.lines) for r in got.collect()} == slow_all_lines(rows)


def test_line_dedup_edges(spark):
    line = "the same five words here"
    rows = [(None, line), (3, line), (3, line), (1, None), (2, ""), (4, f"{line}\nshort one\n" + "long " * 9_000), (5, "SAME  the same five words here")]
    docs = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, f string")
    got = sorted((str(r.doc_id), r.line_dedup.text, r.line_dedup.n_dropped, r.line_dedup.long_kept) for r in linededup.dedup_lines(docs).collect())
    assert [(d, n, k) for d, _, n, k in got] == [("1", 0, False), ("2", 0, True), ("3", 0, True), ("3", 0, True), ("4", 1, True), ("5", 1, False), ("None", 1, False)]
    assert linededup.dedup_lines(docs.limit(0)).collect() == []


def test_short_lines_match_brute_force(spark):
    url, han = "https://host.example/" + "a1b2" * 12, "這是一個沒有空格的很長的句子" * 4
    rows = [
        (1, f"les.\n\n{url}\n{han}\nPage 1\n  \n \u3000\na b c d e"),
        (2, f"LES.\n\nabcde\n{url}x\n{han[:20]}X{han[21:]}\nPage 2\nown line\n  \nsix words are on this line"),
        (3, f"{url[:30]}zz{url[30:]}\n{han[:5]}XY{han[5:]}\nown  Line\nPage 1\nfive are on this line\nles.\n" + " ".join("a" * 40) + "\n" + "a" * 40 + "\n" + "a" * 41),
        (4, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc: set(r.lines) for r in linededup.duplicate_lines(docs, short_lines=True).collect()}
    assert got == slow_all_lines(rows)
    assert {0, 3, 4} <= got[2] and {2, 3, 5, 8} <= got[3] and 5 not in got[2] and not {0, 1} & got[3]


def test_edit_distance():
    assert linededup.edit_distance(list("abcde"), list("abXde")) == 1
    assert linededup.edit_distance(list("abcde"), list("bcdef")) == 2
    assert linededup.edit_distance(list("abc"), list("abc")) == 0
    assert linededup.edit_distance(list("abcde"), list("abde")) == 1


def slow_vectors(rows, threshold=0.95):
    def usable(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = [i for i, (k, v) in enumerate(rows) if k is not None and usable(v)]
    x = np.array([rows[i][1] for i in good], np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    roots = union(len(good), [(int(a), int(b)) for a, b in zip(*np.nonzero(near))])
    out = {i: (k, 0, k) for i, (k, _) in enumerate(rows)}
    least = {}
    for i, r in zip(good, roots):
        least[r] = min(rows[i][0], least.get(r, rows[i][0]))
    for n, (i, r) in enumerate(zip(good, roots)):
        out[i] = (rows[i][0], int(near[n].sum()), least[r])
    return sorted(map(str, out.values()))


def test_vectors_query_has_the_links(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = QUERIES["op6_embedding_dedup"](spark, sf_dir).collect()
    assert sorted(str((r.vec_id, r.n_links, r.component_id)) for r in got) == slow_vectors(rows)


def test_vectors_recall_and_edges(spark):
    rng = np.random.default_rng(8)
    seen, base = [], rng.standard_normal((600, 32))
    close = base[:120] + 0.15 * rng.standard_normal((120, 32))
    crowd = base[7] + 0.12 * rng.standard_normal((150, 32))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(np.concatenate([base, close, crowd]))]
    rows += [(2_000, rows[3][1]), (2_001, rows[3][1]), (2_002, None), (2_003, []), (2_004, [0.0] * 32), (2_005, [float("nan")] * 32), (2_006, [None] * 32), (2_007, [3e38] * 32), (2_008, [2e38] * 32), (None, rows[3][1])]
    got = embed_hnsw.near_vectors(spark.createDataFrame([(k, v, 0) for k, v in rows], "vec_id long, embedding array<float>, shard int"), shard=200, lane=128, audits=seen.extend).collect()
    assert len(seen) > 3 and all(r.found >= 0.99 * r.probed for r in seen)
    want = slow_vectors(rows)
    found = sorted(str((r.vec_id, r.n_links, r.component_id)) for r in got)
    links = lambda x: sum(int(s.split(", ")[1]) for s in x)
    assert links(found) >= 0.99 * links(want)
    assert sum(a == b for a, b in zip(found, want)) >= 0.95 * len(want)
    assert all(r.kept == (r.component_id is None or r.vec_id == r.component_id) for r in got)
    assert embed_hnsw.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_vectors_keep_doubles_and_tell_rows_of_one_id_apart(spark):
    rows = [(1, [1e39, 0.0]), (2, [1.0, 0.0]), (3, [1e-50, 0.0]), (5, [0.0, 1.0]), (5, [1.0, 1.0]), (6, [0.05, 1.0]), (7, [1.02, 1.0]), (8, [1.0, 1.03]), (9, [-1.0, -1.0])]
    got = embed_hnsw.near_vectors(spark.createDataFrame([(k, v, 0, 0) for k, v in rows], "vec_id long, embedding array<double>, n_links int, cid int"))
    assert sorted(str((r.vec_id, r.n_links, r.component_id)) for r in got.collect()) == slow_vectors(rows)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]


def test_vectors_of_many_components_make_small_shards(spark):
    rng, seen = np.random.default_rng(4), []
    base = rng.standard_normal((60, 3_000))
    x = np.concatenate([base, base[:30] + 0.2 * rng.standard_normal((30, 3_000)), base[:10] + 0.4 * rng.standard_normal((10, 3_000))])
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = embed_hnsw.near_vectors(given, shard_bytes=500_000, audits=seen.extend)
    assert sorted(str((r.vec_id, r.n_links, r.component_id)) for r in got.collect()) == slow_vectors(rows)
    assert len(seen) > 3


def test_vectors_compare_with_all_where_the_audit_fails(spark, monkeypatch):
    """Graphs that find nothing: every shard falls back to comparing with all its members."""
    rng = np.random.default_rng(3)
    rows = [(i, list(map(float, v))) for i, v in enumerate(np.repeat(rng.standard_normal((60, 8)), 3, axis=0) + 0.05 * rng.standard_normal((180, 8)))]

    def blind(self, queries, beam, level=0, there=None, threshold=None):
        if threshold is None:
            return plain(self, queries, beam, level, there)
        return np.full((len(queries), 1), -1), np.full((len(queries), 1), -3, np.float32)

    plain = embed_hnsw.Graph.search
    monkeypatch.setattr(embed_hnsw.Graph, "search", blind)
    x = np.array([v for _, v in rows])
    graph = embed_hnsw.Graph.build((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32))
    beam, probed, found = embed_hnsw._audited(graph, 0.95)
    assert beam == len(rows) and probed == found > 0
    q = graph.vectors[:20]
    pairs = {(int(a), int(b)) for a, b in zip(*map(np.concatenate, zip(*embed_hnsw._near(graph, q, beam, 0.95))))}
    assert pairs == set(zip(*(x.tolist() for x in np.nonzero(q @ graph.vectors.T >= 0.95))))
