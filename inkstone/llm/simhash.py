"""Operator 1: SimHash near-duplicates over a Gray-ordered hierarchical index.

Fingerprints are computed once per document inside Arrow batches and folded to
distinct values before anything is compared. The distinct values are dealt to
the upper nodes of one global hierarchy: the first ``k`` bits of a fingerprint,
which are the first ``k`` bits of its Gray rank up to a one-to-one relabelling,
so a node holds a contiguous range of Gray ranks. A value also visits the
nodes that its accumulated differences leave in reach (at most ``max_bits``
flipped bits among those ``k``); all other nodes are pruned as whole groups.
Inside a node the values are sorted by Gray rank and a tree is built whose
upper nodes hold the bits that all values below share. The tree is walked down
against itself: differences between the shared patterns of two groups add up on
the way, and all pairs of two groups are left as soon as they exceed ``max_bits``. Nodes that are too full descend further
bits of the hierarchy, carrying the differences spent so far, until they fit.
No pair list leaves a task: each node returns a spanning forest of its links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import LOWER_AZ, connected_components, forget, written

#: Values in a node of the distributed hierarchy, as planned and at most.
NODE_PLANNED, NODE_MOST = 4_096, 32_768
#: Children of a node of the tree inside a task; pairs of nodes opened at once.
FAN_OUT, FRONTIER = 2, 1 << 16
#: Similar documents: words of a shingle, least Jaccard similarity of their sets.
WIDTH, SIMILARITY = 5, 0.8
#: Fingerprints of a set, each of 32 bits, bits in which two may differ to meet; buckets of the projections.
TABLES, TABLE_FLIPS, BUCKETS = 32, 2, 4_096
#: The tables are searched in turns (first, how many, whether every link is followed): what an early
#: turn has joined is one tree in the next, so that a large group of near copies is not linked in every table.
TURNS = ((0, 3, False), (0, TABLES, True))
#: Links up to which all of a value's links are followed at once; beyond, those that span. What
#: was left out is searched again once these are settled, with so many times the links.
SMALL, MORE = 8, 16
#: Values of a table in a node, as planned and at most.
TABLE_PLANNED, TABLE_MOST = 65_536, 262_144
#: Bits apart, of all TABLES * 32, from which on a similarity of 0.8 is ruled out,
#: and up to which it is taken for granted: at 0.8 it is 155 with a deviation of 16.
UNLIKELY, CERTAIN = 230, 99


def shingles(text: str | None, width: int) -> list[bytes]:
    """Word shingles of a whole text, repeats included. Fewer words than
    ``width`` make one shingle, no words none. A null text has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_AZ).split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)))))


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash: a bit is set if it is set in over half of the
    shingles' XXH64 values (seed 42). No words: zero."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    found = shingles(text, width)
    if not found:
        return 0
    votes = np.zeros(64, np.int64)
    for i in range(0, len(found), 65_536):
        part = np.fromiter((digest(s, 42) for s in found[i : i + 65_536]), np.uint64, len(found[i : i + 65_536]))
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for j in range(0, len(bits), 128):  # sums of up to 128 bits fit a byte
            votes += bits[j : j + 128].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * votes > len(found), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, th, fp): one row per row of ``docs``; ``th`` is a hash of the text,
    ``fp`` the fingerprint as a signed long."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values.view(np.int64))], ["id", "th", "fp"])

    return _keyed(docs, id_col, text_col).mapInArrow(of, "id long, th long, fp long")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("t"))


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each value in the reflected Gray sequence."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A tree over Gray-sorted values: each node knows which bits all values
    below it share, and the pattern of those bits."""

    def __init__(self, values: np.ndarray):
        self.order = np.argsort(gray_rank(values), kind="stable")
        leaves = values[self.order]
        all_and, all_or = [leaves], [leaves]
        while len(all_and[-1]) > FAN_OUT:
            cuts = np.arange(0, len(all_and[-1]), FAN_OUT)
            all_and.append(np.bitwise_and.reduceat(all_and[-1], cuts))
            all_or.append(np.bitwise_or.reduceat(all_or[-1], cuts))
        # from the top: (pattern, bits shared)
        self.levels = [(a, ~(a ^ o)) for a, o in zip(reversed(all_and), reversed(all_or))]

    def meetings(self, other: GrayIndex | None, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(own number, other's number) of all values within ``most`` bits, in
        batches; without ``other`` of all pairs of own values, each once.

        Both trees are walked down together: a pair of groups is left as soon
        as the bits that both share differ in more than ``most`` places, and
        with it all pairs of values below. At most ``FRONTIER`` pairs are opened at once."""
        one, two = self.levels, (other or self).levels
        # the lower tree waits until the higher one has as many levels to go
        shift_one, shift_two = max(0, len(two) - len(one)), max(0, len(one) - len(two))
        top = np.arange(len(one[0][0])), np.arange(len(two[0][0]))
        todo = [(0, np.repeat(top[0], len(top[1])), np.tile(top[1], len(top[0])))]
        depth_of = lambda depth, shift: max(0, depth - shift)
        last = max(len(one), len(two)) - 1
        while todo:
            depth, a, b = todo.pop()
            (pattern_a, shared_a), (pattern_b, shared_b) = one[depth_of(depth, shift_one)], two[depth_of(depth, shift_two)]
            near = np.bitwise_count((pattern_a[a] ^ pattern_b[b]) & shared_a[a] & shared_b[b]) <= most
            if other is None:
                near &= a <= b if depth < last else a < b
            a, b = a[near], b[near]
            if depth == last:
                if len(a):
                    yield self.order[a], (other or self).order[b]
                continue
            wide = FRONTIER // FAN_OUT**2
            for i in range(0, len(a), wide):
                c, d = a[i : i + wide], b[i : i + wide]
                if depth >= shift_one:
                    c, d = (c[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel(), np.repeat(d, FAN_OUT)
                    there = c < len(one[depth + 1 - shift_one][0])
                    c, d = c[there], d[there]
                if depth >= shift_two:
                    c, d = np.repeat(c, FAN_OUT), (d[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
                    there = d < len(two[depth + 1 - shift_two][0])
                    c, d = c[there], d[there]
                todo.append((depth + 1, c, d))


class Forest:
    """Union-find over positions, joined by whole arrays of links."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def link(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Join by the links (u, v); those of them that joined two trees come back."""
        made_u, made_v = [], []
        while len(u):
            a, b = self.roots(u), self.roots(v)
            apart = a != b
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            high, low = np.maximum(a, b), np.minimum(a, b)
            np.minimum.at(self.parent, high, low)
            won = np.nonzero(self.parent[high] == low)[0]
            won = won[np.unique(high[won], return_index=True)[1]]
            made_u.append(u[won])
            made_v.append(v[won])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *made_u]), np.concatenate([none, *made_v])

    def roots(self, at: np.ndarray) -> np.ndarray:
        up = self.parent[at]
        while True:
            higher = self.parent[up]
            if np.array_equal(higher, up):
                return up
            up = higher


def _home_first(rows: pd.DataFrame, column: str) -> np.ndarray:
    home, values = rows["home"].to_numpy(), rows[column].to_numpy()
    return np.concatenate([values[home], values[~home]])


def _met(values: np.ndarray, n: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all values within ``most`` bits, in batches, if one is among the first ``n``."""
    if n:
        index = GrayIndex(values[:n])
        yield from index.meetings(None, most)
        if n < len(values):
            yield from ((v, h + n) for v, h in index.meetings(GrayIndex(values[n:]), most))


def _node_links(most: int):
    """Links of a node's values to the roots of their components."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        values = _home_first(rows, "fp").view(np.uint64)
        forest = Forest(len(values))
        for batch in _met(values, int(rows["home"].sum()), most):
            forest.link(*batch)
        roots = forest.roots(np.arange(len(values)))
        u = np.nonzero(roots != np.arange(len(values)))[0]
        return pd.DataFrame({"u": values[u].view(np.int64), "v": values[roots[u]].view(np.int64)})

    return of


def _tree_links(most: int, small: int):
    """Links of a node's values of different trees, batch by batch, to be checked one
    by one: all links of values that have no more than ``small``, of others those that
    span. Both ends of a link that is left out are given again as ``more``."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches)
        values, trees = _home_first(rows, "fp"), _home_first(rows, "tree")
        forest, met, left = Forest(len(values)), np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        by = np.argsort(trees, kind="stable")
        same = trees[by[1:]] == trees[by[:-1]]
        forest.link(by[1:][same], by[:-1][same])
        links = lambda u, v, more: pd.DataFrame({"u": values[u], "tree_u": trees[u], "v": values[v], "tree_v": trees[v], "more": more})
        for u, v in _met(values.view(np.uint64), int(rows["home"].sum()), most):
            apart = trees[u] != trees[v]
            u, v = u[apart], v[apart]
            made = forest.link(u, v)
            for end in (u, v):
                np.add.at(met, end, 1)
            few = (met[u] <= small) | (met[v] <= small)
            left[u[~few]] = left[v[~few]] = True
            if few.any() or len(made[0]):
                yield links(np.concatenate([made[0], u[few]]), np.concatenate([made[1], v[few]]), False)
        at = np.nonzero(left)[0]
        yield links(at, at, True)

    return of


def _flips(bits: int, most: int) -> list[tuple[int, int]]:
    """(mask, number of bits) of all ways to flip at most ``most`` of ``bits`` bits."""
    return [(sum(1 << i for i in c), n) for n in range(most + 1) for c in combinations(range(bits), n)]


def fingerprint_links(distinct: DataFrame, max_bits: int = 2, planned: int = NODE_PLANNED, most: int = NODE_MOST, tables: int = 1, small: int = SMALL) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of the distinct
    values in ``distinct.fp`` that differ in at most ``max_bits`` bits. With
    ``tables`` the lowest byte of a value is the number of its table, each
    table has a hierarchy of its own, values of different tables never link,
    rows (fp, tree) are distinct, those of one ``tree`` are known to belong together,
    and the links are those of ``_tree_links``."""
    count = distinct.count()
    depth = max(0, math.ceil(math.log2(max(1, count) / tables / planned)))
    table = F.col("fp").bitwiseAND(F.lit(0xFF if tables > 1 else 0).cast("long"))
    tree = ["tree"] if tables > 1 else []
    rows = distinct.select("fp", table.alias("node"), F.lit(0).alias("spent"), F.lit(True).alias("home"), *tree)
    at, parts, deepest = 0, [], 64 if tables == 1 else 56
    while True:
        step = depth - at
        if step:
            flips = F.array(*(F.struct(F.lit(m).cast("long").alias("mask"), F.lit(n).alias("bits")) for m, n in _flips(step, max_bits)))
            own = F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("long")
            if tables > 1:
                own = own.bitwiseOR(F.shiftleft(table, depth))
            low = F.lit((1 << step) - 1).cast("long")
            rows = (
                rows.withColumn("flip", F.explode(flips))
                .where(F.col("spent") + F.col("flip.bits") <= max_bits)
                .withColumn("to", F.shiftleft(F.col("node"), step).bitwiseOR(own.bitwiseAND(low).bitwiseXOR(F.col("flip.mask"))))
                # among the children of its own node a value visits only later ones: the earlier visit it
                .where(~F.col("home") | (F.col("to") >= own))
                .select("fp", F.col("to").alias("node"), (F.col("spent") + F.col("flip.bits")).alias("spent"), (F.col("home") & (F.col("flip.bits") == 0)).alias("home"), *tree)
            )
        full = rows.groupBy("node").agg(F.count_if("home").alias("n"), F.count("*").alias("all")).where(f"n > {most} or all > {64 * most}").where(F.lit(depth < deepest))
        full = written(full.select(F.col("node").alias("full")))
        crowded = bool(full.take(1))
        fitting = rows.join(full, F.col("node") == F.col("full"), "left_anti") if crowded else rows
        nodes = fitting.groupBy("node")
        parts.append(nodes.applyInPandas(_tree_links(max_bits, small), "u long, tree_u long, v long, tree_v long, more boolean") if tables > 1 else nodes.applyInPandas(_node_links(max_bits), "u long, v long"))
        if not crowded:
            break
        rows = rows.join(full, F.col("node") == F.col("full"), "left_semi")
        at, depth = depth, min(deepest, depth + 6)
    edges = parts[0]
    for more in parts[1:]:
        edges = edges.union(more)
    return edges


def _components(docs: DataFrame, id_col: str, text_col: str, width: int, max_bits: int) -> DataFrame:
    """(id, th, fp, component_id), one row per row of ``docs``."""
    prints = written(fingerprints(docs, id_col, text_col, width))
    values = written(prints.groupBy("fp").agg(F.min("id").alias("least")))
    edges = fingerprint_links(values.select("fp"), max_bits)
    groups = connected_components(edges)
    named = values.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    chosen = written(named.join(smallest, "component").select(F.col("fp").alias("of"), "component_id"))
    forget(values)
    return prints.join(chosen, F.col("fp") == F.col("of")).select("id", "th", "fp", "component_id")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    Documents link when their fingerprints differ in at most ``max_bits`` bits;
    ``component_id`` is the smallest id reachable. Null and empty texts have
    fingerprint zero and link like any other. A null id keeps its row and never
    becomes a component's id unless all ids in it are null. Repeated rows stay;
    an empty table gives an empty one; other columns are not read.
    """
    found = _components(docs, id_col, text_col, width, max_bits)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _without_later(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` less the rows whose component has a smaller id, in ``found`` (id,
    th, component_id). Id and text's hash name a row, so rows that share an id
    are judged one by one; null ids stay, and so do exact repeats of a kept row."""
    gone = found.where("id <> component_id").select(F.col("id").alias("_gone_id"), F.col("th").alias("_gone_th")).distinct()
    here = (docs[id_col].cast("long") == F.col("_gone_id")) & (F.xxhash64(docs[text_col]) == F.col("_gone_th"))
    return docs.join(gone, here, "left_anti")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one document of each group of near fingerprints: the one
    whose id is the smallest, row by row as ``_without_later`` says."""
    return _without_later(docs, _components(docs, id_col, text_col, width, max_bits), id_col, text_col)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a text as sorted XXH64 values."""
    from xxhash import xxh64_intdigest as digest

    return np.array(sorted({digest(s, 42) for s in shingles(text, width)}), np.uint64)


def _signs(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), BUCKETS)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, TABLES) longs: the signs of TABLES * 32 random projections of each
    set, 32 bits a table, in the upper half of a long; the table's number is in
    the lowest byte. Shingles are dealt to signed buckets; the projections are
    two rounds of random signs and a Hadamard transform, as a product of two."""
    side = int(math.sqrt(BUCKETS))
    base = np.ones((1, 1), np.float32)
    while len(base) < side:
        base = np.block([[base, base], [base, -base]])
    per = np.fromiter(map(len, sets), np.int64, len(sets))
    every = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    slot = np.repeat(np.arange(len(sets)), per) * BUCKETS + (every % np.uint64(BUCKETS)).astype(np.int64)
    x = np.bincount(slot, np.where(every >> np.uint64(63), 1.0, -1.0), len(sets) * BUCKETS).astype(np.float32).reshape(-1, side, side)
    x = base @ (x * _signs(1).reshape(side, side)) @ base
    x = base[: TABLES * 32 // side] @ (x * _signs(2).reshape(side, side)) @ base
    bits = np.packbits(x.reshape(len(sets), TABLES, 32) > 0, axis=2).view(">u4")[:, :, 0].astype(np.uint64)
    return ((bits << np.uint64(32)) | np.arange(TABLES, dtype=np.uint64)).view(np.int64)


def _sketched(width: int):
    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_intdigest

        for frame in frames:
            for i in range(0, len(frame), 128):
                part = frame.iloc[i : i + 128]
                sets = [shingle_set(t, width) for t in part["t"]]
                names = [xxh3_128_intdigest(s.tobytes()) for s in sets]
                halves = np.array([[n >> 64, n & (1 << 64) - 1] for n in names], np.uint64).view(np.int64)
                yield pd.DataFrame({"id": part["id"].astype("Int64").to_numpy(), "th": part["th"].to_numpy(), "k1": halves[:, 0], "k2": halves[:, 1], "n": list(map(len, sets)), "bits": list(sketches(sets))})

    return of


def _similar(width: int, least: float):
    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            near = []
            for a, b in zip(frame["t1"], frame["t2"]):
                a, b = shingle_set(a, width), shingle_set(b, width)
                both = len(np.intersect1d(a, b, True))
                near.append(both >= least * (len(a) + len(b) - both))
            yield frame.loc[near, ["a", "b"]]

    return of


def _with_groups(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges (u, v) with the components of their ends, those inside one component left out."""
    for end in "uv":
        named = groups.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
        edges = edges.drop(f"c_{end}").join(named, end, "left").withColumn(f"c_{end}", F.coalesce(f"c_{end}", end))
    return edges.where("c_u <> c_v")


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups`` after links (a, b) between components; a component's number is
    one of its nodes, and a node that ``groups`` does not name is its own component."""
    joined = connected_components(links, "a", "b")
    every = groups.select("node", F.col("component").alias("old")).union(joined.select("node", F.col("node").alias("old"))).distinct()
    moved = every.join(joined.select(F.col("node").alias("old"), "component"), "old", "left").select("node", F.coalesce("component", "old").alias("component"))
    return written(moved.groupBy("node").agg(F.min("component").alias("component")))


def _candidates(classes: DataFrame, groups: DataFrame, least: float, turn: tuple[int, int, bool], small: int, crowded: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(u, v, far): class numbers, u > v, of different components, that meet in
    one of a turn's tables, and the bits in which their sketches differ; beside it (fp): the
    values some of whose links were left out, as they have more than ``small``. All links left out are
    among these, so ``crowded``, if given, are the only values searched. A turn that does not follow
    every link compares the first class of each value alone."""
    first, count, every = turn
    named = groups.select(F.col("node").alias("cid"), "component")
    pieces = classes.join(named, "cid", "left").select("cid", F.coalesce("component", "cid").alias("tree"), F.explode(F.slice("bits", first + 1, count)).alias("fp"))
    if crowded is not None:
        pieces = pieces.join(crowded, "fp", "left_semi")
    if every:
        there = pieces
        values = written(pieces.select("fp", "tree").distinct())
    else:
        there = values = written(pieces.groupBy("fp").agg(F.min(F.struct("cid", "tree")).alias("x")).select("fp", "x.cid", "x.tree"))
    links = written(fingerprint_links(values.select("fp", "tree"), TABLE_FLIPS, TABLE_PLANNED, TABLE_MOST, TABLES, small))
    edges = links.where("not more").distinct()
    for end, name in (("u", "a"), ("v", "b")):
        edges = edges.join(there.select(F.col("fp").alias(end), F.col("tree").alias(f"tree_{end}"), F.col("cid").alias(name)), [end, f"tree_{end}"])
    edges = edges.select("a", "b")
    if not every:
        firsts = values.select("fp", F.col("cid").alias("b"), F.col("tree").alias("other"))
        edges = edges.union(pieces.join(firsts, "fp").where("tree <> other").select(F.col("cid").alias("a"), "b"))
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    one, two = (classes.select(F.col("cid").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "uv")
    far = F.aggregate(F.zip_with("bits_u", "bits_v", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    met = edges.join(one, "u").join(two, "v").where(F.least("n_u", "n_v") >= least * F.greatest("n_u", "n_v"))
    out = written(met.select("u", "v", far.alias("far")).where(F.col("far") <= UNLIKELY))
    left = written(links.where("more").select(F.col("u").alias("fp")).distinct())
    forget(values)
    forget(links)
    return out, left


def _checked(edges: DataFrame, groups: DataFrame, classes: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """``groups`` after the edges (u, v, far) that hold. Nearest ones of each class are
    counted on the texts first, and only as long as they would join two components."""
    groups = _merged(groups, edges.where(F.col("far") <= CERTAIN).select(F.col("u").alias("a"), F.col("v").alias("b")))
    open_, tried = edges.where(F.col("far") > CERTAIN), 1
    while True:
        open_ = _with_groups(open_, groups).withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy("far", "v")))
        open_ = written(open_)
        if not open_.take(1):
            return groups
        now = open_.where(F.col("rank") <= tried)
        ends = now.select(F.col("u").alias("cid")).union(now.select("v")).distinct()
        needed = classes.select("cid", "th").join(ends, "cid", "left_semi")
        known = texts.join(needed, "th").dropDuplicates(["cid"]).select("cid", "t")
        both = now.join(known.select(F.col("cid").alias("u"), F.col("t").alias("t1")), "u").join(known.select(F.col("cid").alias("v"), F.col("t").alias("t2")), "v")
        linked = both.select(F.col("c_u").alias("a"), F.col("c_v").alias("b"), "t1", "t2").mapInPandas(_similar(width, least), "a long, b long")
        groups = _merged(groups, linked)
        open_, tried = open_.where(F.col("rank") > tried).drop("rank"), 4 * tried


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """(id, th, component_id), one row per row of ``docs``: documents link when
    the Jaccard similarity of their sets of ``width``-word shingles is ``least``
    or more (texts of fewer words are one shingle; those without words are equal).

    Equal sets are folded first. ``TABLES`` fingerprints of 32 bits a set are
    each searched in the Gray-ordered index; a pair at the limit of 0.8 is met
    with probability 0.98, nearer ones sooner. What meets with ``CERTAIN`` bits
    of all or fewer apart links at once; other links are counted on the texts,
    the nearest of each document first, as long as they would join two components.
    Tables come in turns, and a turn links only what earlier ones left apart. The last
    turn follows every link: what it leaves out of a crowd is searched again, with
    what was joined so far as one tree, until nothing is left out. Sets too small
    to be that similar to any other set are not searched.
    """
    rows = written(_keyed(docs, id_col, text_col).mapInPandas(_sketched(width), "id long, th long, k1 long, k2 long, n long, bits array<long>"))
    folded = rows.groupBy("k1", "k2").agg(F.min("id").alias("least_id"), F.min("th").alias("th"), F.any_value("n").alias("n"), F.any_value("bits").alias("bits"))
    classes = written(folded.withColumn("cid", F.monotonically_increasing_id()))
    texts = docs.select(F.xxhash64(text_col).alias("th"), F.col(text_col).alias("t"))
    groups = classes.sparkSession.createDataFrame([], "node long, component long")
    # two different sets of which the smaller has n shingles share at most n of n + 1
    searched = classes.where(F.col("n") * (1 - least) >= least - 1e-9)
    for turn in TURNS:
        small, crowded = SMALL, None
        while small == SMALL or crowded.take(1):
            edges, left = _candidates(searched, groups, least, turn, small, crowded)
            groups = _checked(edges, groups, classes, texts, width, least)
            forget(edges)
            forget(crowded)
            if not turn[2]:
                forget(left)
                break
            small, crowded = small * MORE, left
    named = classes.join(groups, F.col("cid") == F.col("node"), "left").select("k1", "k2", "least_id", F.coalesce("component", "cid").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    chosen = written(named.join(smallest, "component").select("k1", "k2", "component_id"))
    forget(classes)
    return rows.join(chosen, ["k1", "k2"]).select("id", "th", "component_id")


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group of ``similar_components``: the
    one whose id is the smallest, row by row as ``_without_later`` says."""
    return _without_later(docs, similar_components(docs, id_col, text_col, width, least), id_col, text_col)
