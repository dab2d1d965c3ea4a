"""Operator 6: embedding near-duplicates over navigable small-world graphs.

Equal vectors are folded to classes. Classes are dealt by hash to shards of a
bounded size; each shard builds one hierarchical navigable small-world graph,
and every class queries every shard: a graph is sent once for a long lane of
queries, which stream past it. A beam widens while all it holds is within the
threshold, and for a whole shard while an audit of probes with known answers
(members moved to just inside the threshold) does not find them; a shard whose
audit never succeeds compares with all its members. Cosines of what was found
are verified in double precision. A task returns counts and spanning forests of
the links it found, never the pairs; components are united from the forests.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import connected_components, written
from .simhash import Forest

#: Classes of a shard, queries that stream past one sending of a graph, and queries answered at once.
SHARD, LANE, BLOCK = 32_768, 262_144, 4_096
#: Bytes of a shard's vectors at most, and components gathered at once: vectors of many components make small shards and steps.
SHARD_BYTES, GATHERED = 128 << 20, 1 << 25
#: Links of a node (twice as many in the lowest layer), beam when building and at first when asking.
LINKS, BUILD_BEAM, ASK_BEAM = 12, 48, 32
#: Recall of the probes at which a beam is wide enough, probes, nodes opened in one step.
RECALL, PROBES, OPENED = 0.99, 64, 4


class Graph:
    """Layers of neighbour lists over unit vectors (float32); -1 fills a list."""

    def __init__(self, vectors: np.ndarray, height: np.ndarray, layers: list[np.ndarray]):
        self.vectors, self.height, self.layers = vectors, height, layers

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 7) -> Graph:
        """Insert in growing batches: a batch is searched in the graph so far and
        compared with itself, and takes diverse neighbours in both directions."""
        n = len(vectors)
        draws = np.random.default_rng(seed).random(n)
        height = np.minimum((-np.log(draws) / math.log(LINKS)).astype(int), 8)
        order = np.argsort(-height, kind="stable")  # upper layers first, so that an entry is always there
        vectors, height = vectors[order], height[order]
        layers = [np.full((int((height >= level).sum()), LINKS * (1 if level else 2)), -1, np.int32) for level in range(int(height.max(initial=0)) + 1)]
        graph, done = cls(vectors, height, layers), 0
        while done < n:
            batch = np.arange(done, min(n, done + max(256, min(2_048, done))))
            for level in range(int(height[batch[0]]), -1, -1):
                new = batch[height[batch] >= level]
                graph._insert(level, new, done)
            done = int(batch[-1]) + 1
        graph._reattach()
        graph.order = order
        return graph

    def _insert(self, level: int, new: np.ndarray, done: int) -> None:
        table, most = self.layers[level], LINKS
        there = min(done, len(table))
        near = np.full((len(new), 0), -1, np.int64)
        if there:
            near, _ = self.search(self.vectors[new], BUILD_BEAM, level, there)
        among = self.vectors[new] @ self.vectors[new].T
        np.fill_diagonal(among, -2)
        k = min(BUILD_BEAM // 2, len(new) - 1)
        if k > 0:
            near = np.concatenate([near, new[np.argpartition(-among, k - 1, axis=1)[:, :k]]], axis=1)
        chosen = self._diverse(new, near, most)
        table[new, :most] = chosen
        source, target = np.repeat(new, most), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        ends, first, counts = np.unique(target, return_index=True, return_counts=True)
        slot = np.arange(len(target)) - np.repeat(first, counts)
        room = 2 * LINKS
        back = np.full((len(ends), room), -1, np.int64)
        keep = slot < room
        back[np.repeat(np.arange(len(ends)), counts)[keep], slot[keep]] = source[keep]
        for i in range(0, len(ends), 4_096):
            e = ends[i : i + 4_096]
            table[e] = self._diverse(e, np.concatenate([table[e], back[i : i + 4_096]], axis=1), table.shape[1])

    def _reattach(self) -> None:
        """Nodes of the lowest layer that no list holds any more enter the list
        of their nearest neighbour, in the place of one that other lists hold."""
        table = self.layers[0]
        held = np.bincount(table[table >= 0], minlength=len(table))
        for node in np.nonzero(held == 0)[0]:
            for near in table[node][table[node] >= 0]:
                places = np.nonzero((table[near] < 0) | (held[table[near]] > 1))[0]
                if len(places):
                    if table[near, places[-1]] >= 0:
                        held[table[near, places[-1]]] -= 1
                    table[near, places[-1]], held[node] = node, 1
                    break

    def _diverse(self, nodes: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
        """Of each node's candidates those nearer to it than to any chosen
        before, then the nearest of the rest."""
        out = np.full((len(nodes), most), -1, np.int64)
        step = max(1, min(1_024, GATHERED // (max(1, candidates.shape[1]) * self.vectors.shape[1])))
        for i in range(0, len(nodes), step):
            own, c = nodes[i : i + step], candidates[i : i + step]
            sims = np.einsum("nd,nkd->nk", self.vectors[own], self.vectors[c])
            sims[(c < 0) | (c == own[:, None])] = -3
            by = np.argsort(-sims, axis=1, kind="stable")
            c, sims = np.take_along_axis(c, by, 1), np.take_along_axis(sims, by, 1)
            again = np.zeros_like(c, bool)
            again[:, 1:] = (c[:, 1:] == c[:, :-1]) & (sims[:, 1:] == sims[:, :-1])
            sims[again] = -3
            held = self.vectors[c]
            between = held @ held.transpose(0, 2, 1)
            picked, count = np.zeros(c.shape, bool), np.zeros(len(own), int)
            nearest = np.full(c.shape, -2.0, np.float32)  # to any picked
            for j in range(c.shape[1]):
                take = (sims[:, j] > -2.5) & (sims[:, j] > nearest[:, j]) & (count < most)
                picked[:, j], count = take, count + take
                nearest = np.where(take[:, None], np.maximum(nearest, between[:, j]), nearest)
            rank = np.where(picked, 0, 1) * 2 + (sims < -2.5) * 4
            first = np.argsort(rank, axis=1, kind="stable")[:, :most]
            got = np.take_along_axis(np.where(sims < -2.5, -1, c), first, 1)
            out[i : i + step, : got.shape[1]] = got
        return out

    def search(self, queries: np.ndarray, beam: int, level: int = 0, there: int | None = None, threshold: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of each query's beam in a layer, best first.
        With a threshold a query's beam doubles while its worst is not below it."""
        size = len(self.layers[level]) if there is None else there
        ids, sims = self._descend(queries, level, size)
        asking, out, again = np.arange(len(queries)), {}, False
        most = max(1, GATHERED // (4 * 2 * LINKS * self.vectors.shape[1]))
        while len(asking):
            wider = []
            chunk = min(most, max(16, 512 * BUILD_BEAM // max(beam, BUILD_BEAM)))
            for i in range(0, len(asking), chunk):
                rows = asking[i : i + chunk]
                start = tuple(np.stack([out[r][k] for r in rows.tolist()]) for k in (0, 1)) if again else (ids[rows], sims[rows])
                a, b = self._beam(queries[rows], *start, beam, level, size)
                out.update(zip(rows.tolist(), zip(a, b)))
                if threshold is not None and a.shape[1] >= beam:
                    wider += rows[b[:, beam - 1] >= threshold].tolist()
            asking, beam, again = np.array(wider, int), 2 * beam, True
        width = max((len(a) for a, _ in out.values()), default=0)
        all_ids, all_sims = np.full((len(queries), width), -1, np.int64), np.full((len(queries), width), -3, np.float32)
        for r, (a, b) in out.items():
            all_ids[r, : len(a)], all_sims[r, : len(b)] = a, b
        return all_ids, all_sims

    def _descend(self, queries: np.ndarray, level: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The best nodes of the layers above as entries, and a few first nodes."""
        ids = np.tile(np.arange(min(size, 4)), (len(queries), 1))
        sims = np.einsum("nd,nkd->nk", queries, self.vectors[ids])
        step = max(1, min(512, GATHERED // (4 * LINKS * self.vectors.shape[1])))
        for upper in range(len(self.layers) - 1, level, -1):
            for i in range(0, len(queries), step):
                n = min(size, len(self.layers[upper]))
                a, b = self._beam(queries[i : i + step], ids[i : i + step], sims[i : i + step], 4, upper, n)
                ids[i : i + step, : a.shape[1]], sims[i : i + step, : b.shape[1]] = a[:, : ids.shape[1]], b[:, : ids.shape[1]]
        return ids, sims

    def _beam(self, queries, ids, sims, beam, level, size):
        """Best-first from the given entries, all queries in step, until every
        node of a query's beam has been opened."""
        n, table = len(queries), self.layers[level]
        rows = np.arange(n)[:, None]
        seen = np.zeros((n, size), bool)
        ids = np.where(ids < size, ids, -1)
        sims = np.where(ids >= 0, sims, -3)
        seen[np.broadcast_to(rows, ids.shape)[ids >= 0], ids[ids >= 0]] = True
        opened = ids < 0
        live = np.arange(n)
        done_ids, done_sims = [None] * n, [None] * n
        while len(live):
            rank = np.where(opened, -4, sims)
            k = min(max(OPENED, beam // 16), rank.shape[1])
            pick = np.argpartition(-rank, k - 1, axis=1)[:, :k]
            ok = np.take_along_axis(rank, pick, 1) > -3.5
            active = ok.any(axis=1)
            if not active.all():
                for i in np.nonzero(~active)[0]:
                    done_ids[live[i]], done_sims[live[i]] = ids[i], sims[i]
                live, ids, sims, opened, pick, ok = live[active], ids[active], sims[active], opened[active], pick[active], ok[active]
                if not len(live):
                    break
            at = np.arange(len(live))[:, None]
            nodes = np.where(ok, np.take_along_axis(ids, pick, 1), -1)
            opened[at, pick] = True
            more = np.where(nodes[:, :, None] >= 0, table[nodes], -1).reshape(len(live), -1)
            more = np.where(more < size, more, -1)
            more = np.sort(more, axis=1)
            more[:, 1:][more[:, 1:] == more[:, :-1]] = -1
            fresh = (more >= 0) & ~seen[live[:, None], more]
            width = int(fresh.sum(axis=1).max(initial=0))
            if width:
                first = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
                more, fresh = np.take_along_axis(more, first, 1), np.take_along_axis(fresh, first, 1)
                more = np.where(fresh, more, -1)
                seen[np.broadcast_to(live[:, None], more.shape)[fresh], more[fresh]] = True
                new = np.where(fresh, np.einsum("nd,nkd->nk", queries[live], self.vectors[more]), -3)
                ids, sims, opened = np.concatenate([ids, more], 1), np.concatenate([sims, new.astype(np.float32)], 1), np.concatenate([opened, ~fresh], 1)
            if ids.shape[1] > beam:
                top = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
                ids, sims, opened = (np.take_along_axis(x, top, 1) for x in (ids, sims, opened))
        width = max((len(x) for x in done_ids), default=0)
        out_ids, out_sims = np.full((n, width), -1, np.int64), np.full((n, width), -3, np.float32)
        for i, (a, b) in enumerate(zip(done_ids, done_sims)):
            out_ids[i, : len(a)], out_sims[i, : len(b)] = a, b
        by = np.argsort(-out_sims, axis=1, kind="stable")
        return np.take_along_axis(out_ids, by, 1), np.take_along_axis(out_sims, by, 1)

    def dump(self) -> bytes:
        """The lists; vectors are kept beside them in full precision."""
        to = io.BytesIO()
        np.savez(to, height=self.height, **{f"layer{i}": x for i, x in enumerate(self.layers)})
        return to.getvalue()

    @classmethod
    def load(cls, data: bytes, vectors: np.ndarray) -> Graph:
        with np.load(io.BytesIO(data)) as z:
            return cls(vectors, z["height"], [z[f"layer{i}"] for i in range(sum(k.startswith("layer") for k in z.files))])


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)  # squares of extreme components stay finite
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def _audited(graph: Graph, threshold: float) -> tuple[int, int, int]:
    """The beam at which probes find what comparing with all members finds, how
    many links the probes have, and how many were found at that beam. A beam as
    wide as the graph stands for comparing with all members."""
    n = len(graph.vectors)
    rng = np.random.default_rng(11)
    chosen = graph.vectors[rng.choice(n, min(PROBES, n), replace=False)].astype(np.float64)
    noise = rng.standard_normal(chosen.shape)
    noise -= (noise * chosen).sum(1, keepdims=True) * chosen
    noise /= np.maximum(np.sqrt((noise * noise).sum(1, keepdims=True)), 1e-12)
    inside = min(1.0, threshold + 0.2 * (1 - threshold))
    probes = (inside * chosen + math.sqrt(1 - inside * inside) * noise).astype(np.float32)
    true = int((probes @ graph.vectors.T >= threshold).sum())
    beam = ASK_BEAM
    while beam < n:
        _, sims = graph.search(probes, beam, threshold=threshold)
        if (found := int((sims >= threshold).sum())) >= RECALL * true:
            return beam, true, found
        beam *= 2
    return n, true, true


def _near(graph: Graph, queries: np.ndarray, beam: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query number, member) of similarities (single precision) of ``least`` and more, in batches."""
    if beam < len(graph.vectors):
        ids, sims = graph.search(queries, beam, threshold=least)
        q, slot = np.nonzero((sims >= least) & (ids >= 0))
        yield q, ids[q, slot]
        return
    for i in range(0, len(graph.vectors), 8_192):
        q, node = np.nonzero(queries @ graph.vectors[i : i + 8_192].T >= least)
        yield q, node + i


def _build(threshold: float, wide: type):
    def of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cid")
        exact = np.vstack(rows["v"].to_numpy())
        graph = Graph.build(_unit(exact).astype(np.float32))
        by = graph.order
        beam, true, found = _audited(graph, threshold)
        return pd.DataFrame(
            {
                "shard": [rows["shard"].iloc[0]],
                "beam": [beam],
                "probed": [true],
                "found": [found],
                "graph": [graph.dump()],
                "exact": [exact[by].astype(wide).tobytes()],
                "cids": [rows["cid"].to_numpy()[by].tobytes()],
                "copies": [rows["copies"].to_numpy()[by].tobytes()],
            }
        )

    return of


class _Asking:
    """One loaded graph and the forest of what queries found in it."""

    def __init__(self, row: dict, wide: type, threshold: float):
        self.threshold, self.beam = threshold, int(row["beam"])
        self.cids, self.copies = np.frombuffer(row["cids"], np.int64), np.frombuffer(row["copies"], np.int64)
        self.members = _unit(np.frombuffer(row["exact"], wide).reshape(len(self.cids), -1))
        self.graph = Graph.load(row["graph"], self.members.astype(np.float32))

    def answers(self, own: np.ndarray, vectors: np.ndarray) -> Iterator[pd.DataFrame]:
        """Each query's number of links in the graph, and a forest of the links of these queries."""
        asked = _unit(vectors)
        names, back = np.unique(np.concatenate([own, self.cids]), return_inverse=True)
        forest, total = Forest(len(names)), np.zeros(len(own), np.int64)
        for i in range(0, len(own), 512):
            part = asked[i : i + 512]
            for q, node in _near(self.graph, part.astype(np.float32), self.beam, self.threshold - 1e-4):
                step = max(1, min(100_000, GATHERED // asked.shape[1]))
                for j in range(0, len(q), step):
                    a, b = q[j : j + step], node[j : j + step]
                    linked = ((part[a] * self.members[b]).sum(1) >= self.threshold) & (own[i + a] != self.cids[b])
                    a, b = a[linked], b[linked]
                    np.add.at(total, i + a, self.copies[b])
                    forest.link(back[i + a], back[len(own) + b])
        roots = forest.roots(np.arange(len(names)))
        tied = np.nonzero(roots != np.arange(len(names)))[0]
        some = total > 0
        yield pd.DataFrame({"a": own[some], "b": pd.NA, "n": total[some]}).astype("Int64")
        yield pd.DataFrame({"a": names[tied], "b": names[roots[tied]], "n": pd.NA}).astype("Int64")


def _ask(threshold: float, wide: type):
    """Rows arrive sorted by shard and lane, each graph before its queries, which stream past it."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asking = None
        for frame in frames:
            starts = [*np.nonzero(frame["graph"].notna().to_numpy())[0].tolist(), len(frame)]
            for at, end in zip([0, *(s + 1 for s in starts[:-1])], starts):
                for i in range(at, end, BLOCK):
                    part = frame.iloc[i : min(i + BLOCK, end)]
                    yield from asking.answers(part["cid"].to_numpy(np.int64), np.vstack(part["v"].to_numpy()))
                if end < len(frame):
                    asking = None  # the old graph goes before the next one comes
                    asking = _Asking(frame.iloc[end].to_dict(), wide, threshold)

    return of


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, shard: int = SHARD, lane: int = LANE, audits: Callable[[list], None] | None = None, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors``.

    A shard has ``shard`` classes on average, fewer where their vectors take
    more than ``shard_bytes``.

    ``n_links`` counts other rows linked directly (cosine at least
    ``threshold``, in double precision over the components as they are stored);
    ``component_id`` is the smallest id reachable. Vectors that are null, empty,
    zero, or hold null or non-finite components, and rows with a null id, link
    with nothing and are their own component. Vectors of different lengths do
    not link. Rows that repeat an id and a vector link like copies; different
    vectors under one id are told apart. ``audits`` is called with one row for
    each shard: shard, beam, probed (links of the probes), found.
    """
    kind = vectors.schema[vector_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    wide, component = (np.float32, "float") if single else (np.float64, "double")
    v = F.col(vector_col).cast(f"array<{component}>")
    usable = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0) & F.col(id_col).isNotNull()
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable, F.transform(v, lambda x: x + F.lit(0.0).cast(component))).alias("v"))
    rows = rows.withColumn("h1", F.when(F.col("v").isNotNull(), F.xxhash64("v"))).withColumn("h2", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), F.col("v"))))
    # a class is one vector, whatever ids its rows have; its number stays with the written row
    classes = rows.where("v is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.any_value("v").alias("v"))
    classes = written(classes.withColumn("dim", F.size("v")).withColumn("cid", F.monotonically_increasing_id()))
    count = F.col("count")
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    sizes = classes.groupBy("dim").count().select(F.col("dim").alias("d"), F.greatest(F.lit(2), F.ceil(count / shard), F.ceil(count * F.col("dim") * np.dtype(wide).itemsize / shard_bytes)).cast("int").alias("shards"), count)
    # a graph is sent once for each lane of queries: lanes are long, but for small tables as many as cores
    sizes = sizes.withColumn("lanes", F.greatest(F.ceil(count / lane), F.least(F.ceil(count / BLOCK), F.ceil(cores / F.col("shards")))).cast("int")).drop("count")
    dealt = classes.join(sizes, F.col("dim") == F.col("d")).withColumn("home", F.pmod("h1", "shards"))
    name = lambda c: F.concat_ws("/", "dim", c)
    built = "shard string, beam long, probed long, found long, graph binary, exact binary, cids binary, copies binary"
    graphs = written(dealt.select(name("home").alias("shard"), "cid", "copies", "v").groupBy("shard").applyInPandas(_build(threshold, wide), built))
    if audits:
        audits(graphs.select("shard", "beam", "probed", "found").collect())  # one small row for each shard
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = dealt.select("cid", "v", "h2", "dim", "lanes", each("shards").alias("s")).select(name("s").alias("shard"), F.pmod("h2", "lanes").cast("long").alias("lane"), "cid", "v")
    lanes = sizes.select(F.col("d").alias("dim"), "shards", each("lanes").alias("lane")).select("dim", "lane", each("shards").alias("s")).select(name("s").alias("shard"), F.col("lane").cast("long").alias("lane"))
    sent = graphs.join(lanes, "shard").select("shard", "lane", "beam", "graph", "exact", "cids", "copies")
    # queries have no graph, graphs no query; null sorts last, so that a graph comes first
    stream = asking.unionByName(sent, allowMissingColumns=True).repartition("shard", "lane").sortWithinPartitions("shard", "lane", F.isnull("graph"))
    found = written(stream.select("cid", "v", "beam", "graph", "exact", "cids", "copies").mapInPandas(_ask(threshold, wide), "a long, b long, n long"))
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    groups = connected_components(found.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = (
        classes.select("h1", "h2", "cid", "least", "copies")
        .join(counts, F.col("cid") == F.col("a"), "left")
        .join(groups, F.col("cid") == F.col("node"), "left")
        .select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cid").alias("group"))
    )
    named = written(named)
    known = named.join(named.groupBy("group").agg(F.min("least").alias("component_id")), "group").select("k1", "k2", "n_links", "component_id")
    out = rows.join(known, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    first = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), first.alias("component_id"), F.coalesce(F.col("vec_id") == first, F.lit(True)).alias("kept"))
