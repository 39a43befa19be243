"""Prefix trie of conversations: intervals of members from range minima over sorted longest common prefixes.

Every turn becomes a code of fixed width, so that a conversation is a string of codes and no text is shuffled.  The
strings are sorted over all tasks.  Each task goes through its part in blocks of bounded size: neighbours' longest
common prefixes get a sparse table of minima, and every candidate, a row and a depth, finds how far its prefix reaches
by two binary searches in it, one to the left and one to the right, each by itself.  Nodes in order of (first row, depth)
are in preorder, so what a subtree sums up is a difference of running sums.

A prefix of a block's first or last string may go on in other blocks.  Such nodes leave partial sums, two rows a block,
and the same procedure over those rows alone puts them together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, small, tidy

#: Characters of a turn's code: 128 bits of SHA-256 in hex.
WIDTH = 32
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_codes(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, code, size``: a code of role and text and the text's UTF-8 bytes; null role or text is empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    code = F.substr(F.sha2(framed, 256), F.lit(1), F.lit(WIDTH))
    rows = conversations.where(F.col("conv_id").isNotNull())
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), code.alias("code"), F.octet_length(text).cast("long").alias("size"))


def sequences(codes: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's codes and sizes in order of turn, null first, equal turns by code."""
    listed = F.array_sort(F.collect_list(F.struct("turn", "code", "size")))
    return codes.groupBy("conv_id").agg(F.transform(listed, lambda t: F.struct(t["code"].alias("code"), t["size"].alias("size"))).alias("turns"))


def spliced(codes: DataFrame, *, family: int = 5, shared: int = 9) -> DataFrame:
    """``sequences`` rebuilt: the first h turns of the family's head, then the own turns after the first h.

    The head of conversation c is c - c % ``family``, h is the CRC-32 of c in decimal modulo ``shared``.  A head with
    fewer turns gives all it has, one that is absent none; what is left may have no turns.  Families are dealt out once;
    listing a conversation and looking up its head need no other shuffle.
    """
    placed = codes.withColumn("head", F.col("conv_id") - F.col("conv_id") % family).repartition("head")
    listed = F.array_sort(F.collect_list(F.struct("turn", "code", "size")))
    own = placed.groupBy("head", "conv_id").agg(F.transform(listed, lambda t: F.struct(t["code"].alias("code"), t["size"].alias("size"))).alias("own"))
    given = F.max(F.when(F.col("conv_id") == F.col("head"), F.slice("own", 1, shared - 1))).over(Window.partitionBy("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % shared).cast("int")
    nothing = F.slice("own", 1, 0)
    both = own.withColumn("given", F.coalesce(given, nothing)).withColumn("h", h)
    return both.select("conv_id", F.concat(F.slice("given", F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.size("own"))).alias("turns"))


class Minima:
    """Smallest values of ranges of an array, from a table of those of lengths 1, 2, 4, …"""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            below, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(below[:-step], below[step:]))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The smallest of each ``first`` to ``last``, both included."""
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        made = np.empty(len(first), self.levels[0].dtype)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            made[at] = np.minimum(self.levels[k][first[at]], self.levels[k][last[at] - (1 << int(k)) + 1])
        return made

    def reach(self, row: np.ndarray, least: np.ndarray, step: int) -> np.ndarray:
        """How far each row can go, to the right (1) or the left (-1), over neighbours that share at least ``least``.

        Value i stands between rows i - 1 and i.  One binary search for each row, by halves of the array's length.
        """
        at = row.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level, far = self.levels[k], 1 << k
            low = at + 1 if step > 0 else at - far + 1
            inside = np.flatnonzero((low >= 1) & (low < len(level)))
            onward = inside[level[low[inside]] >= least[inside]]
            at[onward] += step * far
        return at


class Block:
    """Sorted strings of codes and the nodes that their prefixes are, in preorder."""

    def __init__(self, keys: list[bytes], sizes: np.ndarray):
        self.keys, n = keys, len(keys)
        self.length = length = np.array([len(k) // WIDTH for k in keys], np.int64)
        codes = np.frombuffer(b"".join(keys), f"S{WIDTH}")
        start = np.cumsum(length) - length
        both = np.minimum(length[:-1], length[1:])
        pair = np.repeat(np.arange(n - 1), both)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(both) - both, both)
        differs = np.flatnonzero(codes[start[pair] + place] != codes[start[pair + 1] + place])
        shared = np.append(-1, both)  # nothing before the first
        np.minimum.at(shared, pair[differs] + 1, place[differs])
        self.shared, minima = shared, Minima(shared)
        # candidates: every row with every depth
        row = np.repeat(np.arange(n), length + 1)
        self.first_candidate = np.cumsum(length + 1) - (length + 1)
        depth = np.arange(len(row)) - np.repeat(self.first_candidate, length + 1)
        left, right = minima.reach(row, depth, -1), minima.reach(row, depth, 1)
        wide = int(length.max()) + 1
        node, at, self.node_of = np.unique(left * wide + depth, return_index=True, return_inverse=True)
        self.left, self.right, self.depth = left[at], right[at], depth[at]
        above = np.maximum(self.first_candidate[self.left] + self.depth - 1, 0)
        self.parent = np.where(self.depth > 0, self.node_of[above], -1)
        self.after = np.searchsorted(self.left, self.right, side="right")  # behind a node's subtree
        self.size = np.where(self.depth > 0, sizes[np.maximum(start[self.left] + self.depth - 1, 0)] if len(sizes) else 0, 0)
        self.ends = np.bincount(self.node_of[self.first_candidate + length], minlength=len(node))

    def below(self, own: np.ndarray) -> np.ndarray:
        """Sums over each node's subtree."""
        running = np.append(0, np.cumsum(own))
        return running[self.after] - running[:-1]

    def names(self, row: int) -> list[str]:
        """Names of all prefixes of a row, the empty one first; equal prefixes have equal names in any block."""
        h, key = hashlib.sha256(), self.keys[row]
        made = [h.hexdigest()[:WIDTH]]
        for d in range(int(self.length[row])):
            h.update(key[d * WIDTH : (d + 1) * WIDTH])
            made.append(h.hexdigest()[:WIDTH])
        return made


_LISTS = {c: pa.list_(pa.int64()) for c in ("sizes", "members", "least", "saved", "leaves", "children")}
_FOUND = pa.schema(
    [("kind", pa.string())]
    + [(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [(c, pa.string()) for c in ("ends_sha256", "node", "key", "ids")]
    + list(_LISTS.items())
)
_FOUND_DDL = "kind string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, node string, key string, ids string, " + ", ".join(f"{c} array<long>" for c in _LISTS)
_NODE = "node string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _batch(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def block_nodes(ids: np.ndarray, keys: list[bytes], sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of one block: rows of nodes that lie inside it, of its edges (``edge``) and of ids that end on an edge (``piece``)."""
    b, n = Block(keys, sizes), len(keys)
    members, least = b.right - b.left + 1, Minima(ids).of(b.left, b.right)
    edge = (b.left == 0) | (b.right == n - 1)
    inner = np.flatnonzero(~edge)
    children = np.bincount(b.parent[b.parent >= 0], minlength=len(edge))
    saved = b.below(np.where(edge, 0, (members - 1) * b.size))
    leaves = b.below(np.where(edge, 0, children == 0))
    top, bottom = b.names(0), b.names(n - 1)
    name = lambda j: top[b.depth[j]] if b.left[j] == 0 else bottom[b.depth[j]]
    ended = lambda j: _joined(ids[b.left[j] : b.left[j] + b.ends[j]])
    on_edge = edge[b.parent[inner]]
    yield _batch(
        _FOUND, len(inner), kind=["node"] * len(inner), conv_id=least[inner], depth=b.depth[inner], parent_conv_id=pa.array(least[b.parent[inner]], mask=on_edge), n_convs=members[inner],
        n_children=children[inner], n_leaves=leaves[inner], saved_tokens=saved[inner], ends_sha256=[hashlib.sha256(ended(j).encode()).hexdigest() if b.ends[j] else NOTHING for j in inner],
        node=[name(p) if e else None for p, e in zip(b.parent[inner], on_edge)],
    )
    inside = np.bincount(b.parent[inner], minlength=len(edge))  # children that are no edges
    start, rows = np.cumsum(b.length) - b.length, [0] if n == 1 else [0, n - 1]
    sides: dict[str, list] = {c: [] for c in ("conv_id", "key", *_LISTS)}
    for row in rows:
        at = b.node_of[b.first_candidate[row] : b.first_candidate[row] + b.length[row] + 1]
        own = np.arange(len(at)) >= 0 if row == 0 else b.left[at] > 0  # what both edges have, the first has given
        for c, values in (("members", members), ("saved", saved), ("leaves", leaves), ("children", inside)):
            sides[c].append(np.where(own, values[at], 0))
        sides["least"].append(least[at])
        sides["conv_id"].append(int(ids[row]))
        sides["key"].append(keys[row].decode())
        sides["sizes"].append(sizes[start[row] : start[row] + b.length[row]])
    yield _batch(_FOUND, len(rows), kind=["edge"] * len(rows), **sides)
    cut = [j for j in np.flatnonzero(edge) if b.ends[j]]
    yield _batch(_FOUND, len(cut), kind=["piece"] * len(cut), node=[name(j) for j in cut], conv_id=[int(ids[b.left[j]]) for j in cut], ids=[ended(j) for j in cut])


def _in_blocks(turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            for i, length in enumerate(batch.column("sizes").value_lengths().to_pylist()):
                n += length + 1
                if n >= turns:
                    held.append(batch.slice(at, i + 1 - at))
                    yield from made(held)
                    held, n, at = [], 0, i + 1
            if at < batch.num_rows:
                held.append(batch.slice(at))
        if held:
            yield from made(held)

    def made(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        sizes = pa.chunked_array([x.flatten() for x in table.column("sizes").chunks], pa.int64()).to_numpy()
        yield from block_nodes(table.column("conv_id").to_numpy(), [k.encode() for k in table.column("key").to_pylist()], sizes)

    return tidy(run)


def edge_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes on edges, put together from the edges of all blocks in order."""
    table = pa.Table.from_batches(list(batches), pa.schema([("key", pa.string()), *_LISTS.items()]))
    if not table.num_rows:
        return
    flat = {c: pa.chunked_array([x.flatten() for x in table.column(c).chunks], pa.int64()).to_numpy() for c in _LISTS}
    b = Block([k.encode() for k in table.column("key").to_pylist()], flat["sizes"])
    order = np.argsort(b.node_of, kind="stable")
    starts = np.searchsorted(b.node_of[order], np.arange(len(b.left)))
    total = lambda c: np.add.reduceat(flat[c][order], starts)
    members, least = total("members"), np.minimum.reduceat(flat["least"][order], starts)
    children = total("children") + np.bincount(b.parent[b.parent >= 0], minlength=len(members))
    saved = total("saved") + b.below((members - 1) * b.size)  # what blocks give are sums over subtrees already
    leaves = total("leaves") + b.below(np.where(children == 0, 1, 0))
    named, row = [], -1
    for left, depth in zip(b.left.tolist(), b.depth.tolist()):
        if left != row:
            row, names = left, b.names(left)
        named.append(names[depth])
    columns = [named, least, b.depth, pa.array(least[b.parent], mask=b.parent < 0), members, children, leaves, saved]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"])


def ends_of_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's ids, from its pieces in order, one piece after another."""
    node, h = None, None
    done: list[tuple[str, str]] = []
    for batch in batches:
        for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name == node:
                h.update(b"," + ids.encode())
            else:
                done += [(node, h.hexdigest())] if h else []
                node, h = name, hashlib.sha256(ids.encode())
    done += [(node, h.hexdigest())] if h else []
    yield pa.RecordBatch.from_arrays([pa.array([d[j] for d in done], pa.string()) for j in (0, 1)], names=["node", "ends_sha256"])


def prefix_trie(seqs: DataFrame, *, turns: int = 1 << 18) -> DataFrame:
    """A row for each distinct prefix of the ``turns`` of ``conv_id, turns``, the empty one (the root) included.

    ``conv_id`` is the smallest member, ``parent_conv_id`` the parent's (null for the root), ``depth`` the prefix's turns,
    ``n_convs`` its members, ``n_children`` and ``n_leaves`` its children and the childless nodes below or at it,
    ``saved_tokens`` the sum, over the nodes below and itself, of (members - 1) times the bytes of the node's last turn,
    ``ends_sha256`` the SHA-256 of the ids of members that have no further turn, ascending, joined by commas.

    ``conv_id`` must be distinct and not null; a conversation without turns is a member of the root; no conversations
    give no rows.  Copies of one conversation, however many, are dealt out by their ids like others.

    A task holds ``turns`` turns at a time, or one conversation if it has more.  The edges of all blocks, two rows for
    each, are put together in one task.
    """
    scratch = Scratch(seqs.sparkSession, "trie")
    keyed = seqs.select("conv_id", F.array_join("turns.code", "").alias("key"), F.col("turns.size").alias("sizes"))
    in_order = keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    found = scratch.write(in_order.mapInArrow(_in_blocks(turns), _FOUND_DDL), "found")
    edges = found.where("kind = 'edge'").select("key", *_LISTS, "conv_id").repartition(1).sortWithinPartitions("key", "conv_id")
    tops = scratch.write(edges.drop("conv_id").mapInArrow(tidy(edge_nodes), _NODE), "tops")
    pieces = found.where("kind = 'piece'").select("node", "ids", "conv_id").repartition("node").sortWithinPartitions("node", "conv_id")
    ends = pieces.drop("conv_id").mapInArrow(tidy(ends_of_pieces), "node string, ends_sha256 string")
    told = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes, n = found.where("kind = 'node'"), scratch.count("tops")
    below = nodes.where("node IS NOT NULL").drop("parent_conv_id").join(small(tops.select("node", F.col("conv_id").alias("parent_conv_id")), n), "node")
    top = tops.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    return nodes.where("node IS NULL").select(*told).unionByName(below.select(*told)).unionByName(top.select(*told))
