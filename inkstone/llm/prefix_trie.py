"""Operator 12: the trie of conversation prefixes.

Turns are hashed in place, so texts are never moved; a prefix is known by its
length and by 120 bits that its turns' hashes, each mixed with its place, make.
Equal prefixes become one node by an aggregation. A node that one conversation
has needs no trie: what is asked of it is known at once. The shared nodes are cut
into prefix shards of a bounded number of turns. Numpy lays each shard out as a
succinct level-order trie (LOUDS bits, and labels in the same order) and rolls up
from the last level to the first. The heavy levels above the shards follow in
rounds of their own, with what their shards have sent up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import forget, written

#: Turns below the top of a shard, at most, in the first round, and how many times as many in each further round.
SHARD_TURNS, GROWTH = 20_000, 1_000
#: Conversations of a block, and how many first turns they may share with the block's first.
BLOCK, SHARED_TURNS = 20, 4
#: Ids hashed from one row.
CHUNK = 4_096
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["depth", "a", "b"]


def content(role: Column, text: Column) -> Column:
    """SHA-256 of a turn; the role's length keeps role and text apart."""
    return F.sha2(F.concat_ws(":", F.char_length(role).cast("string"), role, text), 256)


def shared_turns(conv_id: Column) -> Column:
    """How many first turns of its block's first conversation one starts with."""
    return (F.crc32(conv_id.cast("string")) % SHARED_TURNS).cast("int")


def dealt(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` dealt by conversation and place, so that a conversation of any
    length lies in several parts, with the part's number."""
    return written(rows.repartitionByRange("conv_id", *order).withColumn("_part", F.spark_partition_id()))


def carried(parts: DataFrame, *sums: Column) -> DataFrame:
    """``parts`` with what the earlier parts of its conversation hold of each
    aggregate. Only conversations in several parts need it: two for each part at
    most, so they are broadcast."""
    names = [f"_{i}" for i in range(len(sums))]
    held = parts.groupBy("conv_id", "_part").agg(*(s.alias(n) for s, n in zip(sums, names)))
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    merge = [F.sum, F.bit_xor, F.bit_xor]
    held = held.select("conv_id", "_part", F.count("*").over(Window.partitionBy("conv_id")).alias("_parts"), *(F.coalesce(m(n).over(before), F.lit(0)).alias(n) for m, n in zip(merge, names)))
    return parts.join(F.broadcast(held.where("_parts > 1").drop("_parts")), ["conv_id", "_part"], "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in names})


def rebuilt(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Every turn of every rebuilt conversation with its place and its prefix's
    key, and all conversations: (conv_id, depth, a, b, pa, pb, words, rest, last)
    and (conv_id, n). ``pa`` and ``pb`` are those of the prefix one shorter,
    ``rest`` counts the turns from this one on."""
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    half = lambda i: F.conv(F.substring("digest", i, 15), 16, 10).cast("long")
    turns = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), content(role, text).alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words")).where("conv_id is not null")
    turns = turns.select("conv_id", "turn", half(1).alias("k1"), half(16).alias("k2"), "words")
    order = [F.asc_nulls_first("turn"), F.asc("k1"), F.asc("k2")]
    parts = dealt(turns, *order)
    inside = Window.partitionBy("conv_id", "_part").orderBy(*order)
    placed = carried(parts, F.count("*")).select("conv_id", (F.row_number().over(inside) + F.col("_0")).alias("pos"), "k1", "k2", "words", shared_turns(F.col("conv_id")).alias("h"))
    placed = written(placed)
    forget(parts)
    convs = written(placed.groupBy("conv_id").agg(F.count("*").alias("n")))
    heads = placed.where(f"conv_id % {BLOCK} = 0 and pos < {SHARED_TURNS}").select(F.col("conv_id").alias("first"), "pos", "k1", "k2", "words")
    # a block has few conversations, and few turns of its first are shared
    taken = convs.withColumns({"h": shared_turns(F.col("conv_id")), "first": F.expr(f"conv_id - conv_id % {BLOCK}")}).join(heads, "first").where("pos <= h")
    both = taken.select("conv_id", F.lit(0).alias("side"), "pos", "k1", "k2", "words").unionByName(placed.where("pos > h").select("conv_id", F.lit(1).alias("side"), "pos", "k1", "k2", "words"))
    parts = dealt(both, "side", "pos")
    inside = Window.partitionBy("conv_id", "_part").orderBy("side", "pos")
    deep = carried(parts, F.count("*")).withColumn("depth", (F.row_number().over(inside) + F.col("_0")).cast("long"))
    deep = written(deep.select("conv_id", "_part", "depth", "words", F.xxhash64("depth", "k1", "k2").alias("x"), F.xxhash64("k2", "k1", "depth").alias("y")))
    forget(placed)
    forget(parts)
    inside = Window.partitionBy("conv_id", "_part").orderBy("depth")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    keyed = carried(deep, F.count("*"), F.bit_xor("x"), F.bit_xor("y"))
    keyed = keyed.withColumns({"a": F.bit_xor("x").over(so_far).bitwiseXOR(F.col("_1")), "b": F.bit_xor("y").over(so_far).bitwiseXOR(F.col("_2"))})
    sizes = deep.groupBy("conv_id").agg(F.max("depth").alias("n"))
    rows = keyed.join(sizes, "conv_id").select("conv_id", *KEY, F.col("a").bitwiseXOR(F.col("x")).alias("pa"), F.col("b").bitwiseXOR(F.col("y")).alias("pb"), "words", (F.col("n") - F.col("depth") + 1).alias("rest"), (F.col("n") == F.col("depth")).cast("long").alias("last"))
    out = written(rows)
    forget(deep)
    return out, convs


def bits_of(degrees: np.ndarray) -> np.ndarray:
    """The LOUDS bits of a trie in level order: a one for each child, then a zero."""
    bits = np.ones(int(degrees.sum()) + len(degrees), bool)
    bits[np.cumsum(degrees + 1) - 1] = False
    return bits


def parents_of(bits: np.ndarray) -> np.ndarray:
    """The parent of every node but the first: the zeros before the node's one."""
    return np.cumsum(~bits)[bits]


def rolled_up(frame: pd.DataFrame) -> pd.DataFrame:
    """Whole shards with n_children, n_leaves, saved and ``top``, whether a node
    begins its shard. One trie holds them all, below a node of its own."""
    frame = frame.reset_index(drop=True)
    keys = frame[KEY].assign(at=np.arange(len(frame)))
    above = frame[["depth", "pa", "pb"]].rename(columns={"pa": "a", "pb": "b"})
    above["depth"] -= 1
    parent = above.merge(keys, "left", KEY)["at"].fillna(-1).to_numpy(np.int64)
    depth, a, b = (frame[c].to_numpy() for c in KEY)
    depth = depth - frame.groupby(["sa", "sb"])["depth"].transform("min").to_numpy()
    # the node above all has place 0, and so has the parent of every top
    place, flat, up, begin = np.zeros(len(frame) + 1, np.int64), [], [], 1
    by_depth = np.argsort(depth, kind="stable")
    for level in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1):
        # brothers side by side: a parent's place, then the label
        level = level[np.lexsort((b[level], a[level], place[parent[level]]))]
        place[level] = begin + np.arange(len(level))
        begin += len(level)
        flat.append(level)
        up.append(place[parent[level]])
    flat, up = np.concatenate(flat), np.concatenate(up)
    degrees = np.bincount(up, minlength=len(flat) + 1)
    parents = parents_of(bits_of(degrees))  # of the nodes from 1 on
    take = lambda c: np.concatenate([[0], frame[c].to_numpy()[flat]])
    convs, level_of = take("n_convs"), depth[flat]
    met, kids = take("kid_convs"), take("kids") + degrees
    np.add.at(met, parents, convs[1:])
    alone = convs - take("n_ends") - met  # children that one conversation has
    kids, leaves = kids + alone, take("leaves") + alone
    saved = take("saved") + (convs - 1) * take("words")
    leaves[kids == 0] = 1
    for here in np.split(np.arange(len(flat)), np.flatnonzero(np.diff(level_of)) + 1)[::-1]:  # from the last level to the first
        np.add.at(leaves, parents[here], leaves[here + 1])
        np.add.at(saved, parents[here], saved[here + 1])
    out = frame.iloc[flat].copy()
    return out.assign(n_children=kids[1:], n_leaves=leaves[1:], saved_tokens=saved[1:], top=parents == 0)


NODE = "depth long, a long, b long, pa long, pb long, conv_id long, n_convs long, n_ends long"


def _shards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shards, which come one after another, as tries of some ``SHARD_TURNS`` nodes."""
    names = [*(c.split()[0] for c in NODE.split(", ")), "n_children", "n_leaves", "saved_tokens", "top"]
    held: list[pd.DataFrame] = []
    for frame in frames:
        held.append(frame)
        if sum(map(len, held)) >= SHARD_TURNS:
            whole = pd.concat(held, ignore_index=True)
            last = (whole["sa"] == whole["sa"].iloc[-1]) & (whole["sb"] == whole["sb"].iloc[-1])
            if not last.all():
                yield rolled_up(whole[~last])[names]
                held = [whole[last]]
            else:
                held = [whole]
    if held and sum(map(len, held)):
        yield rolled_up(pd.concat(held, ignore_index=True))[names]


def _by_shards(rows: DataFrame, shared: DataFrame, turns: int) -> DataFrame:
    """All shared nodes with their rollups, shard by shard, then the levels above."""
    spark = rows.sparkSession
    now, limit, done = shared.withColumns({c: F.lit(0).cast("long") for c in ("kids", "kid_convs", "leaves", "saved")}), turns, []
    while True:
        heavy, light = now.where(F.col("weight") > limit), now.where(F.col("weight") <= limit)
        keys = heavy.where("depth > 0").select(*KEY)
        n_heavy = heavy.count()
        if n_heavy:
            # of each conversation the last prefix above its shard; only prefixes of many turns are heavy
            on = F.broadcast(keys) if n_heavy <= 10_000 else keys
            cut = rows.select("conv_id", *KEY).join(on, KEY, "left_semi").groupBy("conv_id").agg(F.max("depth").alias("cut"))
            tops = rows.select("conv_id", *KEY).join(cut, "conv_id", "left").where(F.col("depth") == F.coalesce("cut", F.lit(0)) + 1)
            light = light.join(tops.select("conv_id", F.col("a").alias("sa"), F.col("b").alias("sb")), "conv_id")
        else:
            light = light.withColumns({"sa": F.lit(0).cast("long"), "sb": F.lit(0).cast("long")})
        dealt = light.repartition("sa", "sb").sortWithinPartitions("sa", "sb", "depth")
        done.append(written(dealt.mapInPandas(_shards, f"{NODE}, n_children long, n_leaves long, saved_tokens long, top boolean")))
        if not n_heavy:
            break
        up = done[-1].where("top").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"))
        up = up.agg(F.count("*").alias("kids"), F.sum("n_convs").alias("kid_convs"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        sums = ("kids", "kid_convs", "leaves", "saved")
        both = heavy.join(up.select(*KEY, *(F.col(c).alias(f"_{c}") for c in sums)), KEY, "left")
        now = written(both.withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in sums}).drop(*(f"_{c}" for c in sums)))
        limit *= GROWTH
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of ids of one node, joined, with the first id; rows come in order."""
    for frame in frames:
        new = (frame[KEY] != frame[KEY].shift()).any(axis=1).to_numpy()
        run = np.maximum.accumulate(np.where(new, np.arange(len(frame)), 0))
        part = (np.arange(len(frame)) - run) // CHUNK
        for _, some in frame.groupby([np.cumsum(new), part], sort=False):
            yield pd.DataFrame({**{c: [some[c].iloc[0]] for c in KEY}, "first": [some["conv_id"].iloc[0]], "ids": [",".join(map(str, some["conv_id"]))]})


def _hashes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One hash for each node from its chunks in order; no node is ever held whole."""
    key, found = None, None
    for frame in frames:
        out = []
        for *this, ids in frame[[*KEY, "ids"]].itertuples(index=False):
            if this != key:
                if key is not None:
                    out.append((*key, found.hexdigest()))
                key, found = this, hashlib.sha256(ids.encode())
            else:
                found.update(b"," + ids.encode())
        if out:
            yield pd.DataFrame(out, columns=[*KEY, "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(*key, found.hexdigest())], columns=[*KEY, "ends_sha256"])


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS, **columns: str) -> DataFrame:
    """One row for each node of the trie of all rebuilt conversations: conv_id,
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns lie in the order of ``turn``, nulls first; equal ones in the order of
    their contents' hashes, so repeated rows are turns beside each other. Null
    roles and texts are empty; rows with a null conversation belong to none. An
    empty table gives an empty result. Other columns are not read.

    A conversation may have any number of turns: its rows are dealt over parts. A
    shard's tasks hold its nodes, ``SHARD_TURNS`` at most; what the heavy levels
    of a further round hold is bounded by ``GROWTH`` times their depth. The ids
    that end at one node are hashed as a stream.
    """
    spark = conversations.sparkSession
    rows, convs = rebuilt(conversations, **columns)
    turnless = convs.select("conv_id").join(rows.where("depth = 1").select("conv_id"), "conv_id", "left_anti")
    total = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).first()
    nodes = written(
        rows.groupBy(*KEY).agg(
            F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").cast("long").alias("words"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.sum("last").alias("n_ends"), F.sum("rest").alias("weight")
        )
    )
    empty = hashlib.sha256(b"").hexdigest()
    result = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not total["n"]:
        return spark.createDataFrame([], result)
    weight = nodes.where("depth = 1").agg(F.sum("weight")).first()[0] or 0
    root = spark.createDataFrame([(0, 0, 0, total["n"], total["least"], 0, 0, 0, turnless.count(), weight)], ", ".join(f"{c} long" for c in nodes.columns))
    shared = written(nodes.where("n_convs > 1").unionByName(root))
    tried = _by_shards(rows, shared, shard_turns)
    alone = nodes.where("n_convs = 1").select(*(c.split()[0] for c in NODE.split(", ")), (1 - F.col("n_ends")).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    ended = shared.where("n_ends > 0").select(*KEY)
    ends = rows.where("last = 1").select(*KEY, "conv_id").join(ended.where("depth > 0"), KEY)
    ends = ends.unionByName(turnless.select(*(F.lit(0).cast("long").alias(c) for c in KEY), "conv_id"))
    chunks = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInPandas(_chunks, "depth long, a long, b long, first long, ids string")
    hashed = chunks.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInPandas(_hashes, "depth long, a long, b long, ends_sha256 string")
    one = F.when(F.col("n_ends") == 1, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(empty)
    tried = tried.drop("top").join(hashed, KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty)))
    every = tried.unionByName(alone.withColumn("ends_sha256", one))
    # the parent of a node below one that a single conversation has is that conversation's, too
    above = shared.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("_parent"))
    deep = every.where("depth > 1").join(above, ["depth", "pa", "pb"], "left").withColumn("parent_conv_id", F.coalesce("_parent", "conv_id"))
    first = every.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(total["least"]).cast("long")))
    names = [c.split()[0] for c in result.split(", ")]
    return first.select(*names).unionByName(deep.select(*names))
