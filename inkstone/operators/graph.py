"""Rank by graph: sentences by similarity, terms by company; and terms that keep like company.

A document's sentences are ranked out of its own row, without their pairs: a step
of the power iteration goes from sentences to the terms they share and back. Of
graphs that are given as tables, the edges of a document are ranked in an Arrow
batch, and by joins of tables where they do not fit one (``rank_nodes``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rows as W
from ..functions import text as X
from ..stored import Stored, kept
from . import scoring

WINDOW, DAMPING, STEPS, CLOSE = 4, 0.85, 50, 1e-6
#: Edges of a document up to which it is ranked in one row.
IN_ROW = 200_000


def page_rank(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Scores of ``n`` nodes by weighted undirected edges (each given once)."""
    source, target, weight = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
    degree = np.bincount(source, weight, n)
    share = weight / degree[source] if len(source) else weight
    return _following(n, lambda score: np.bincount(target, share * score[source], n))


def _following(n: int, spread) -> np.ndarray:
    """The power iteration: ``spread`` passes the scores of ``n`` nodes on to their neighbours."""
    score = np.full(n, 1 / n)
    for _ in range(STEPS):
        following = (1 - DAMPING) / n + DAMPING * spread(score)
        done = np.abs(following - score).sum() < CLOSE
        score = following
        if done:
            break
    return score


def rank_by_terms(n: int, sentence: np.ndarray, term: np.ndarray) -> np.ndarray:
    """Scores of ``n`` sentences, linked by the cosine of their term counts, from a row
    (sentence, term) for each term. Edges are never made: work and memory grow with the terms."""
    _, term = np.unique(term, return_inverse=True)
    both, tf = np.unique(sentence * (len(term) + 1) + term, return_counts=True)
    sentence, term = both // (len(term) + 1), both % (len(term) + 1)
    weight = tf / np.sqrt(np.bincount(sentence, tf * tf, n))[sentence]
    # terms of one sentence alone link none; without them a sentence that has no link has no weight at all
    shared = np.bincount(term)[term] > 1
    sentence, term, weight = sentence[shared], term[shared], weight[shared]
    own = np.bincount(sentence, weight * weight, n)

    def met(x: np.ndarray) -> np.ndarray:
        return np.bincount(sentence, weight * np.bincount(term, weight * x[sentence])[term], n) - own * x

    degree = met(np.ones(n))
    linked = np.bincount(sentence, minlength=n) > 0
    return _following(n, lambda score: met(np.where(linked, score / np.where(linked, degree, 1.0), 0.0)))


def _sentence_scores(terms: Column) -> Column:
    """The ranks of a document's sentences from the terms of each."""

    def of(rows: pa.Array) -> pa.Array:
        lists = rows.flatten()
        code = lists.flatten().dictionary_encode()
        code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sizes, inner = (pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (rows, lists))
        ends, stops, out = np.cumsum([0, *sizes]), np.cumsum([0, *inner]), [np.zeros(0)]
        for a, b in zip(ends[:-1], ends[1:]):
            if b > a:
                out.append(rank_by_terms(b - a, np.repeat(np.arange(b - a), inner[a:b]), code[stops[a] : stops[b]]))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out)))

    return F.arrow_udf(of, "array<double>")(terms)


def sentence_ranks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, node, score): the rank of every sentence, as ``rank_nodes`` of ``similarities``
    finds it, out of its document's own row: nothing is dealt out, and no pair is made."""
    rows = docs.select(id_col, _sentence_scores(F.transform(X.split_sentences(text_col), X.tokens)).alias("scores"))
    return W.numbered(rows, [id_col], "scores", "node", "score")


def rank_nodes(edges: DataFrame, sizes: DataFrame, id_col: str = "doc_id", in_row: int = IN_ROW) -> DataFrame:
    """(id, node, score) from edges (id, a, b, w), each given once, and (id, n).
    A document of no more than ``in_row`` edges is ranked out of one row, the
    others by joins of tables, to the same scores."""
    edges = kept(edges)
    crowded = kept(edges.groupBy(F.col(id_col).alias("_of")).count().where(F.col("count") > in_row).select("_of"))
    here = lambda df, how: df.join(crowded, F.col(id_col) == F.col("_of"), how)
    some = not crowded.isEmpty()
    if not some:
        here = lambda df, how: df
    rows = W.numbered(_ranked(here(edges, "left_anti"), here(sizes.where("n > 0"), "left_anti"), id_col), [id_col], "scores", "node", "score")
    return rows.unionByName(_rank_by_tables(here(edges, "left_semi"), here(sizes, "left_semi"), id_col)) if some else rows


def _rank_by_tables(edges: DataFrame, sizes: DataFrame, id_col: str) -> DataFrame:
    """Each step is a join of shares and scores and a sum by target; it is stored,
    so that the loss of an executor costs one step. A document whose scores have
    settled is set aside and not worked on again."""
    spark = edges.sparkSession
    key = F.col(id_col)
    with Stored(spark) as stored:
        both = edges.select(id_col, F.col("a").alias("source"), F.col("b").alias("target"), "w").unionByName(edges.select(id_col, F.col("b").alias("source"), F.col("a").alias("target"), "w"))
        degrees = both.groupBy(key.alias("_of"), F.col("source").alias("_s")).agg(F.sum("w").alias("degree"))
        shares = stored(both.join(degrees, (key == F.col("_of")) & (F.col("source") == F.col("_s"))).select(id_col, "source", "target", (F.col("w") / F.col("degree")).alias("share")))
        now = stored(sizes.where("n > 0").select(id_col, "n", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("node")).withColumn("score", 1 / F.col("n")))
        settled = []
        for step in range(STEPS):
            sent = shares.join(now.select(key.alias("_of"), F.col("node").alias("_s"), "score"), (key == F.col("_of")) & (F.col("source") == F.col("_s")))
            met = sent.groupBy(key.alias("_of"), F.col("target").alias("_t")).agg(F.sum(F.col("share") * F.col("score")).alias("met"))
            new = (1 - DAMPING) / F.col("n") + DAMPING * F.coalesce("met", F.lit(0.0))
            following = now.join(met, (key == F.col("_of")) & (F.col("node") == F.col("_t")), "left").select(id_col, "n", "node", new.alias("score"), F.abs(new - F.col("score")).alias("moved"))
            away = F.sum("moved").over(Window.partitionBy(id_col))
            following = stored(following.withColumn("done", (away < CLOSE) | F.lit(step == STEPS - 1)).drop("moved"))
            settled.append(following.where("done").select(id_col, "node", "score"))
            now = following.where("not done").drop("done")
            if now.isEmpty():
                break
        out = settled[0]
        for more in settled[1:]:
            out = out.unionByName(more)
        return kept(out)


def _ranked(edges: DataFrame, sizes: DataFrame, id_col: str, distributed: bool = False) -> DataFrame:
    """(id, scores) from edges (id, a, b, w) and (id, n)."""
    if distributed:
        rows = _rank_by_tables(edges, sizes, id_col)
        return rows.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "score"))), lambda x: x["score"]).alias("scores"))
    packed = edges.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("a", "b", "w"))).alias("e"))
    packed = sizes.join(packed, id_col, "left").select(id_col, "n", F.coalesce("e", F.array().cast(packed.schema["e"].dataType)).alias("e"))

    def of(sizes: pd.Series, a: pd.Series, b: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([page_rank(int(n), np.asarray(x, int), np.asarray(y, int), np.asarray(z, float)) for n, x, y, z in zip(sizes, a, b, w)])

    run = F.pandas_udf(of, "array<double>")
    return packed.select(id_col, run("n", "e.a", "e.b", "e.w").alias("scores"))


def similarities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, a, b, w): cosine of the term counts of two sentences of a document
    that share a term."""
    terms = scoring.tokens(docs, id_col, text_col).groupBy(id_col, "sent_idx", "term").agg(F.count("*").alias("tf"))
    norm = F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(Window.partitionBy(id_col, "sent_idx")))
    terms = terms.withColumn("norm", norm)
    a, b = terms.alias("a"), terms.alias("b")
    same = (F.col(f"a.{id_col}") == F.col(f"b.{id_col}")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.sent_idx") < F.col("b.sent_idx"))
    pairs = a.join(b, same).groupBy(F.col(f"a.{id_col}").alias(id_col), F.col("a.sent_idx").alias("a"), F.col("b.sent_idx").alias("b"))
    return pairs.agg((F.sum(F.col("a.tf") * F.col("b.tf")) / F.first(F.col("a.norm") * F.col("b.norm"))).alias("w"))


def summarize_textrank(docs: DataFrame, num_sentences: int = 5, id_col: str = "doc_id", text_col: str = "text", distributed: bool = False) -> DataFrame:
    """(id, summary): the best-ranked sentences in document order; texts with no
    more sentences than asked for are returned whole. All out of a document's own
    row; ``distributed`` ranks by tables of its pairs of sentences instead."""
    sents = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("t"), X.split_sentences(text_col).alias("s"))
    if distributed:
        sizes = sents.select(id_col, F.size("s").alias("n")).where(F.col("n") > num_sentences)
        rows = sents.join(_ranked(similarities(docs, id_col, text_col), sizes, id_col, True), id_col, "left")
    else:
        asked = F.when(F.size("s") > num_sentences, F.transform("s", X.tokens)).otherwise(F.array().cast("array<array<string>>"))
        rows = sents.select(id_col, "t", "s", F.nullif(_sentence_scores(asked), F.array().cast("array<double>")).alias("scores"))
    order = F.array_sort(F.transform("scores", lambda v, i: F.struct((-F.round(v, scoring.DECIMALS)).alias("by"), i.alias("i"))))
    chosen = F.array_sort(F.transform(F.slice(order, 1, num_sentences), lambda x: x["i"]))
    best = F.array_join(F.transform(chosen, lambda i: F.get("s", i)), " ")
    return rows.select(id_col, F.when(F.col("scores").isNull(), F.col("t")).otherwise(best).alias("summary"))


def _company(window: int):
    """Of a document's terms in order, which stand within ``window`` of one another and how
    often: places (a, b) in the sorted distinct terms, a < b, and w, in order."""

    def of(terms: pd.Series) -> pd.DataFrame:
        out = []
        for t in terms:
            known, x = np.unique(np.asarray(t, object), return_inverse=True)
            pairs = [np.minimum(x[:-d], x[d:]) * len(known) + np.maximum(x[:-d], x[d:]) for d in range(1, min(window, len(x)))]
            met, w = np.unique(np.concatenate(pairs) if pairs else np.zeros(0, np.int64), return_counts=True)
            a, b = met // max(1, len(known)), met % max(1, len(known))
            out.append((a[a < b], b[a < b], w[a < b]))
        return pd.DataFrame(out, columns=["a", "b", "w"])

    return of


def _known_terms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t, terms): a document's terms in order, and each once, sorted."""
    rows = docs.select(id_col, X.tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    return rows.select(id_col, "t", F.sort_array(F.array_distinct("t")).alias("terms"))


def companions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, term_a, term_b, w): how often two different terms of a document stand within
    ``window`` terms of one another, term_a first by name. One row's work."""
    rows = _known_terms(docs, id_col, text_col).select(id_col, "terms", F.pandas_udf(_company(window), "a array<int>, b array<int>, w array<long>")("t").alias("c"))
    word = lambda c: F.transform(f"c.{c}", lambda i: F.get("terms", i))
    return W.fields(rows, [id_col], F.arrays_zip(word("a").alias("term_a"), word("b").alias("term_b"), F.col("c.w").alias("w")), "term_a")


def term_contexts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_pairs: int = 2) -> DataFrame:
    """(term, context, x): over all documents, the positive pointwise mutual
    information of terms that stand near one another ``least_pairs`` times."""
    # counted over all documents at once, not in each of them first
    rows = docs.select(X.tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    near = F.flatten(F.transform("t", lambda a, i: F.transform(F.slice(F.col("t"), i + 2, F.lit(WINDOW - 1)), lambda b: F.struct(F.least(a, b).alias("term_a"), F.greatest(a, b).alias("term_b")))))
    pairs = W.fields(rows, [], near, "term_a").where("term_a <> term_b").groupBy("term_a", "term_b").agg(F.count("*").alias("w"))
    both = pairs.select(F.col("term_a").alias("term"), F.col("term_b").alias("context"), "w").unionByName(pairs.select(F.col("term_b").alias("term"), F.col("term_a").alias("context"), "w"))
    sums = both.groupBy("term").agg(F.sum("w").alias("d"))
    total = sums.agg(F.sum("d").alias("total"))  # one row
    of = lambda c: sums.select(F.col("term").alias(c), F.col("d").alias(f"d_{c}"))
    rows = both.where(F.col("w") >= least_pairs).join(of("term"), "term").join(of("context"), "context").crossJoin(F.broadcast(total))
    x = F.ln(F.col("w") * F.col("total") / (F.col("d_term") * F.col("d_context")))
    return rows.select("term", "context", x.alias("x")).where("x > 0")


def similar_terms(docs: DataFrame, terms: DataFrame, top: int = 5, least: float = 0.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, similar, cosine): for each term of the table ``terms`` the ``top``
    terms of the corpus with the most alike contexts, ties by name. Exact: terms
    meet only where they share a context, and others have cosine zero."""
    rows = kept(term_contexts(docs, id_col, text_col))
    norms = rows.groupBy("term").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    asked = rows.join(terms.select(F.lower("term").alias("term")).distinct(), "term").select(F.col("term").alias("asked"), "context", F.col("x").alias("y"))
    dots = asked.join(rows, "context").where("asked <> term").groupBy("asked", "term").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    both = dots.join(norms, "term").join(norms.select(F.col("term").alias("asked"), F.col("norm").alias("other")), "asked")
    found = both.select("asked", "term", F.round(F.col("dot") / (F.col("norm") * F.col("other")), scoring.DECIMALS - 2).alias("cosine")).where(F.col("cosine") >= least)
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("cosine"), "term"))).where(F.col("r") <= top)
    return ranked.select(F.col("asked").alias("term"), F.col("term").alias("similar"), "cosine")


def textrank_terms(docs: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rank, term): terms by weighted rank in their company, ties by term."""
    near = _company(WINDOW)

    def of(terms: pd.Series) -> pd.Series:
        edges = near(terms)
        return pd.Series([page_rank(len(set(t)), a, b, w.astype(float)) if len(t) else [] for t, a, b, w in zip(terms, edges["a"], edges["b"], edges["w"])])

    rows = _known_terms(docs, id_col, text_col).select(id_col, "terms", F.pandas_udf(of, "array<double>")("t").alias("scores"))
    best = F.slice(F.sort_array(F.zip_with("scores", "terms", lambda s, t: F.struct((-F.round(s, scoring.DECIMALS)).alias("by"), t.alias("term")))), 1, n)
    return W.numbered(rows, [id_col], best, "i", "x").select(id_col, (F.col("i") + 1).alias("rank"), F.col("x.term").alias("term"))
