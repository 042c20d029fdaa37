"""Prefix trie of conversations from padded turn-id matrices, sharded by range."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from siftline.llm.common import parts_for, small_batches
from siftline.session import materialize

COLUMNS = 64
ENDS = 1024
_EMPTY = hashlib.sha256(b"").hexdigest()

_NODE = (
    "key binary, parent_key binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, at int, ends array<bigint>"
)


def turn_lists(turns: DataFrame) -> DataFrame:
    """(conv_id, path): the turns of every conversation in order, as structs of a 128-bit id of role and text, and the words.

    Turns are ordered by turn, null first, then role, then id. Texts stay where they are.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    known = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn"), role.alias("role"), known.alias("id"), words.alias("words")).alias("t")
    )
    # The conversations of one base meet in one task and so do their turns: one shuffle does for both.
    rows = rows.withColumn("base", _base(F.col("conv_id"))).repartition("base")
    listed = rows.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return listed.select("base", "conv_id", F.transform("t", lambda t: F.struct(t["id"], t["words"])).alias("path"))


def _base(conv: Column) -> Column:
    return conv - conv % 20


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, path) with the first h turns of the base conversation before the own ones after the first h."""
    listed = turn_lists(turns)
    heads = listed.where("conv_id = base").select("base", F.slice("path", 1, 3).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    none = F.array().cast("array<struct<id: binary, words: bigint>>")
    head = F.slice(F.coalesce("head", none), F.lit(1), h)
    rest = F.slice("path", h + 1, F.greatest(F.size("path") - h, F.lit(0)))
    return listed.join(heads, "base", "left").select("conv_id", F.concat(head, rest).alias("path"))


class Matrix:
    """Paths as rows of turn ids, padded with 0, in sorted order; read by blocks of columns, of the rows that reach them."""

    def __init__(self, convs: np.ndarray, paths: pa.Array, before: np.ndarray) -> None:
        ends = np.asarray(paths.offsets, np.int64)
        turns = paths.flatten()
        self.length = np.diff(ends)
        self.first = ends[:-1] - ends[0]
        raw = b"".join(turns.field("id").to_pylist())
        self.raw = np.frombuffer(raw, ">u8").reshape(-1, 2).astype(np.uint64)
        self.words = turns.field("words").to_numpy()
        # Dense ids in the order of the digests.
        order = np.lexsort((self.raw[:, 1], self.raw[:, 0]))
        sorted_ = self.raw[order]
        new = np.r_[True, (sorted_[1:] != sorted_[:-1]).any(axis=1)][: len(order)]
        self.ids = np.empty(len(order), np.int64)
        self.ids[order] = np.cumsum(new)
        self.convs, self.before = convs, before
        self._sort()

    def block(self, rows: np.ndarray, column: int) -> np.ndarray:
        """Columns ``column`` to ``column`` + COLUMNS of ``rows``."""
        width = min(COLUMNS, int(self.length[rows].max()) - column)
        places = column + np.arange(width)
        there = places < self.length[rows, None]
        flat = np.where(there, self.first[rows, None] + places, 0)
        return np.where(there, self.ids[flat], 0)

    def _sort(self) -> None:
        # Ids only matter among equal paths; the row from the shard before is the least of all.
        order = np.lexsort((self.convs, ~self.before))
        deepest = int(self.length.max(initial=0))
        for column in reversed(range(0, deepest, COLUMNS)):
            reach = self.length[order] > column
            alive = order[reach]
            block = self.block(alive, column)
            order = np.r_[order[~reach], alive[np.lexsort(block.T[::-1])]]
        self.order = order

    def starts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(depth, places in the order of the rows that reach it, whether a node starts there), by rising depth."""
        n = len(self.order)
        changed = np.zeros(n, bool)
        changed[:1] = True
        yield 0, np.arange(n), changed.copy()
        alive, column = np.flatnonzero(self.length[self.order] > 0), 0
        while len(alive):
            block = self.block(self.order[alive], column)
            for c in range(block.shape[1]):
                ids = block[:, c]
                # A row that reaches the column differs from the one before it in it, or did in a column before.
                new = np.r_[True, ids[1:] != ids[:-1]]
                new[1:] |= alive[1:] != alive[:-1] + 1
                changed[alive] |= new
                yield column + c + 1, alive, changed[alive]
                if c + 1 < block.shape[1]:
                    stays = self.length[self.order[alive]] > column + c + 1
                    alive, block = alive[stays], block[stays]
            column += COLUMNS
            alive = alive[self.length[self.order[alive]] > column]


def _prefix_keys(raw: np.ndarray) -> list[bytes]:
    """A digest of every prefix of a path, from the empty one on."""
    state, keys = hashlib.blake2b(digest_size=16), []
    for turn in raw.astype(">u8"):
        keys.append(state.digest())
        state.update(turn.tobytes())
    return keys + [state.digest()]


def shard_nodes(table: pa.Table) -> pa.Table:
    """The nodes of one shard: rows (conv_id, path, before) of which one at most, the last of the shard before, has before set.

    Nodes of the shard's first and last path may go on in other shards. They come with a key, sums that
    can be added over shards, and their ends; all others are complete.
    """
    paths = table.column("path").combine_chunks()
    m = Matrix(table.column("conv_id").to_numpy(), paths, table.column("before").to_numpy(zero_copy_only=False))
    order, n = m.order, len(m.order)
    real = ~m.before[order]
    skip = 0 if real.all() else 1  # the row from the shard before comes first
    if n == skip:
        return pa.Table.from_pylist([], _schema())
    length, convs = m.length[order], m.convs[order]
    # lcp: how many columns a row shares with the one before it.
    lcp, levels = np.zeros(n, np.int64), []
    for depth, alive, new in m.starts():
        lcp[alive[~new]] = depth
        levels.append((depth, alive, new.copy()))
    said = np.r_[0, np.cumsum(m.words)]
    spoken = lambda rows, depth: said[m.first[order[rows]] + depth] - said[m.first[order[rows]]]
    shared = spoken(np.arange(n), lcp)
    ended = np.r_[False, lcp[1:] < length[:-1]]  # the row before was the last below its own leaf
    # Sides whose nodes other shards may have too.
    first_keys = _prefix_keys(m.raw[m.first[order[skip]] :][: length[skip]])
    last_keys = _prefix_keys(m.raw[m.first[order[-1]] :][: length[-1]])
    tables, up = [], None
    for depth, alive, new in levels:
        here = np.flatnonzero(new)
        node = np.cumsum(new) - 1
        own = real[alive]
        opened, follows = own & new, own & ~new  # rows whose node this shard starts, and the rest
        total = lambda values: np.add.reduceat(values.astype(np.int64), here)
        n_convs = total(own)
        low = np.minimum.reduceat(np.where(own, convs[alive], np.iinfo(np.int64).max), here)
        branches = (length[alive] > depth) & (opened | follows & (lcp[alive] == depth))
        saved = np.where(follows, shared[alive] - (spoken(alive, depth - 1) if depth else 0), 0)
        # Only the first and the last node of a level can lie on a side.
        sides = {}
        if depth <= length[skip]:
            sides[int(node[np.searchsorted(alive, skip)])] = first_keys[depth]
        if depth <= length[-1]:
            sides[int(node[-1])] = last_keys[depth]
        keys, parent_keys, parent_ids = ([None] * len(here) for _ in range(3))
        if depth:
            parents = up[alive[here]]
            parent_ids = low_before[parents].tolist()
            for side, key in sides_before.items():
                for j in np.flatnonzero(parents == side):
                    parent_keys[j], parent_ids[j] = key, None
        ends = np.flatnonzero(own & (length[alive] == depth))
        ids, cut = convs[alive[ends]], np.searchsorted(node[ends], np.arange(len(here) + 1))
        digests, pieces = [_EMPTY] * len(here), [None] * len(here)
        for j in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            if j not in sides:
                digests[j] = hashlib.sha256(",".join(map(str, ids[cut[j] : cut[j + 1]].tolist())).encode()).hexdigest()
        more = []
        for j, key in sides.items():
            mine = ids[cut[j] : cut[j + 1]]
            keys[j], digests[j], pieces[j] = key, None, mine[:ENDS]
            more += [{"key": key, "at": i, "ends": mine[i : i + ENDS]} for i in range(ENDS, len(mine), ENDS)]
        columns = {
            "key": keys, "parent_key": parent_keys, "conv_id": low, "depth": np.full(len(here), depth),
            "parent_conv_id": parent_ids, "n_convs": n_convs, "n_children": total(branches),
            "n_leaves": total(opened | follows & ended[alive]), "saved_tokens": total(saved),
            "ends_sha256": digests, "at": np.zeros(len(here), np.int32), "ends": pieces,
        }
        level = pa.table({f.name: pa.array(columns[f.name], f.type) for f in _schema()}, _schema())
        tables += [level.filter(pa.array(n_convs > 0)), pa.Table.from_pylist(more, _schema())]
        up = np.full(n, -1)
        up[alive] = node
        sides_before, low_before = sides, low
    return pa.concat_tables(tables)


def _schema() -> pa.Schema:
    types = {"binary": pa.binary(), "bigint": pa.int64(), "string": pa.string(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(name, types[kind]) for name, kind in (f.split() for f in _NODE.split(", "))])


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends_sha256) from the ends of each key in order, a piece at a time."""
    now, state, any_ = None, None, False
    for batch in batches:
        done = []
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
            if key != now:
                if now is not None:
                    done.append((now, state.hexdigest()))
                now, state, any_ = key, hashlib.sha256(), False
            if len(ids.values):
                state.update((b"," if any_ else b"") + ",".join(map(str, ids.as_py())).encode())
                any_ = True
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.binary(), pa.string()))], ["key", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])


def trie_nodes(paths: DataFrame, shard_turns: int = 1 << 18) -> DataFrame:
    """The nodes of the prefix trie of ``paths`` (conv_id, path): see ``conversation_trie``."""
    paths = materialize(paths, "paths")
    size = paths.agg(F.sum(F.size("path") + 1)).first()[0] or 0
    shards = parts_for(size, shard_turns)
    # Equal paths fall to several shards if need be, as their ids differ.
    ids = F.col("path.id")
    dealt = paths.repartitionByRange(shards, ids, "conv_id").withColumn("shard", F.spark_partition_id())
    dealt = materialize(dealt, "shards")
    last = dealt.groupBy("shard").agg(F.max(F.struct(ids.alias("ids"), "conv_id", "path")).alias("last"))
    last = materialize(last.select("shard", "last.conv_id", "last.path"), "last")
    numbers = last.select("shard", F.lead("shard").over(Window.orderBy("shard")).alias("next")).where("next is not null")
    edges = last.join(numbers, "shard").select("conv_id", "path", F.col("next").alias("shard"), F.lit(True).alias("before"))
    marked = dealt.withColumn("before", F.lit(False)).unionByName(edges)
    nodes = marked.groupBy("shard").applyInArrow(_with_shard, f"{_NODE}, shard int")
    nodes = materialize(nodes, "nodes")

    # The nodes on a side of a shard meet by key; their ends come in order of shard and place.
    pieces = nodes.where("key is not null").select("key", "ends", "shard", "at").repartition("key").sortWithinPartitions("key", "shard", "at")
    small_batches(pieces)
    hashed = pieces.select("key", "ends").mapInArrow(_hash_ends, "key binary, ends_sha256 string")
    split = nodes.where("key is not null and n_convs is not null").groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        F.max("parent_conv_id").alias("parent_conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    ).join(hashed, "key")
    split = materialize(split, "split")
    told = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    whole = nodes.where("key is null")
    open_ = whole.where("parent_key is not null").select("parent_key", *told).unionByName(split.select("parent_key", *told))
    parents = split.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    closed = whole.where("parent_key is null").select("parent_conv_id", *told)
    rows = closed.unionByName(open_.join(parents, "parent_key", "left").drop("parent_key"))
    return rows.select("conv_id", "depth", "parent_conv_id", *told[2:])


def _with_shard(table: pa.Table) -> pa.Table:
    nodes = shard_nodes(table.select(["conv_id", "path", "before"]))
    return nodes.append_column("shard", pa.array(np.full(nodes.num_rows, table.column("shard")[0].as_py()), pa.int32()))


def conversation_trie(turns: DataFrame, shard_turns: int = 1 << 18) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations of ``turns`` (conv_id, turn, role, text, …).

    Conversation c becomes the first h turns of conversation c - c % 20, then its own turns after
    its first h, with h = crc32(c) % 4. A node at depth d is a different sequence of the first d (role, text); its members are the
    conversations that start with it. Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (over the subtree: members beyond the first times the words of the node's text), ends_sha256
    (of the ids of members that end there, ascending, comma-joined).

    Null roles and texts are empty; turns come in order of turn, null first, ties by role, then by a digest; repeated rows
    are turns of their own. Rows without a conv_id belong to no conversation and are left out. An empty table has no nodes, not even a root;
    other columns are not read. Turns travel as a digest and a word count, whatever the length of their texts; one
    conversation, 24 bytes a turn, is one row.

    How: paths are cut into shards of about ``shard_turns`` turns by range of (path, conv_id), so copies of a conversation spread
    over shards. A shard is a matrix of turn ids, padded with 0 and sorted by ``lexsort``; the changes from row to row,
    OR-accumulated over the columns, mark where nodes start, and ``reduceat`` sums each depth. All measures of a node are sums over its rows
    beyond the first, so the nodes on the sides of a shard, which other shards may share, are added up by key. The
    digest of a node's ends is a stream by nature: its ids, sorted by the shards, are hashed piece by piece in one task.
    """
    return trie_nodes(rebuilt(turns), shard_turns)
