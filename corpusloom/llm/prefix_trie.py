"""Conversation prefix trie: which conversations share which first turns, as one row per trie node.

A turn is known by a 128-bit digest of its role and text, so texts never move. A conversation's digests in order are its
path; equal paths are counted once. Paths are sorted by range over all tasks and cut into chunks of bounded size. Each
chunk becomes an adaptive radix tree: its distinct turns are numbered in order, a key is the path as four-byte big-endian
numbers, inner nodes hold 4, 16, 48 or 256 children and grow when full, and runs of bytes without a branch are
compressed. Only byte depths that end a turn emit a node.

A node whose paths all lie inside one chunk is finished there. Those on the path to a chunk's first or last key may go on
next door; they are emitted as parts and added up by one aggregation. To make that exact, each chunk knows how many
turns its first key shares with the key before it (such nodes are not new here) and whether the key behind its last one
extends that; between partitions this takes one small row for each partition. So subtree sums need no rounds.

Turns are ordered by number, null first, then by digest. Null roles and texts count as empty. Equal rows all count. Rows
of a null conversation are one conversation, printed `null`, with the greatest id. Without rows there is no node. Other
columns are ignored, whatever their names.

Scale: a conversation's digests (24 bytes a turn), not its texts, pass through one task, as one key of the trie does. The
digest of the ids that end at a node is sequential: they are streamed in order, 24 bytes each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import col, stored

ROOT = bytes(16)
NOTHING = hashlib.sha256(b"").hexdigest()
WIDTH = 4
# Bounds of one radix tree.
CHUNK_KEYS, CHUNK_BYTES = 8192, 4_000_000

LAYOUTS = (4, 16, 48, 256)


class RadixNode:
    """An inner node or leaf: `prefix` is its compressed path, `value` the key that ends here, if one does."""

    __slots__ = ("prefix", "value", "room", "bytes", "kids", "slots")

    def __init__(self, prefix: bytes, value: int | None = None) -> None:
        self.prefix, self.value, self.room = prefix, value, LAYOUTS[0]
        self.bytes: bytearray | None = bytearray()  # up to 16 children: their bytes in order
        self.slots: bytearray | None = None  # 48 children: place + 1 by byte
        self.kids: list[RadixNode | None] = []

    def child(self, byte: int) -> RadixNode | None:
        if self.room <= 16:
            at = self.bytes.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.room == 48:
            return self.kids[self.slots[byte] - 1] if self.slots[byte] else None
        return self.kids[byte]

    def _grow(self) -> None:
        pairs = list(self.children())
        self.room = LAYOUTS[LAYOUTS.index(self.room) + 1]
        if self.room == 48:
            self.bytes, self.slots, self.kids = None, bytearray(256), []
        elif self.room == 256:
            self.slots, self.kids = None, [None] * 256
        else:
            return
        for byte, kid in pairs:
            self.add(byte, kid)

    def add(self, byte: int, kid: RadixNode) -> None:
        if self.room < 256 and len(self.kids) == self.room:
            self._grow()
        if self.room <= 16:
            at = sum(b < byte for b in self.bytes)
            self.bytes.insert(at, byte)
            self.kids.insert(at, kid)
        elif self.room == 48:
            self.kids.append(kid)
            self.slots[byte] = len(self.kids)
        else:
            self.kids[byte] = kid

    def put(self, byte: int, kid: RadixNode) -> None:
        """Replace the child at a byte that has one."""
        if self.room <= 16:
            self.kids[self.bytes.find(byte)] = kid
        elif self.room == 48:
            self.kids[self.slots[byte] - 1] = kid
        else:
            self.kids[byte] = kid

    def children(self) -> Iterator[tuple[int, RadixNode]]:
        """In byte order."""
        if self.room <= 16:
            yield from zip(self.bytes, self.kids, strict=True)
        elif self.room == 48:
            yield from ((b, self.kids[s - 1]) for b, s in enumerate(self.slots) if s)
        else:
            yield from ((b, k) for b, k in enumerate(self.kids) if k is not None)


def _shared(a: bytes, b: bytes) -> int:
    """Leading bytes in common."""
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


class RadixTree:
    def __init__(self) -> None:
        self.top = RadixNode(b"")

    def insert(self, key: bytes, value: int) -> None:
        node, above, at = self.top, None, 0
        while True:
            same = _shared(node.prefix, key[at : at + len(node.prefix)])
            if same < len(node.prefix):
                upper = RadixNode(node.prefix[:same])
                upper.add(node.prefix[same], node)
                node.prefix = node.prefix[same + 1 :]
                if above is None:
                    self.top = upper
                else:
                    above.put(key[at - 1], upper)
                node = upper
            at += same
            if at == len(key):
                node.value = value
                return
            below = node.child(key[at])
            if below is None:
                node.add(key[at], RadixNode(key[at + 1 :], value))
                return
            node, above, at = below, node, at + 1

    def walk(self) -> Iterator[tuple[int, bytes, int | None]]:
        """(bytes of the path above, bytes of the edge with its branching byte, value), keys in order."""
        stack = [(0, b"", self.top)]
        while stack:
            above, branch, node = stack.pop()
            edge = branch + node.prefix
            yield above, edge, node.value
            stack.extend((above + len(edge), bytes([b]), kid) for b, kid in reversed(list(node.children())))


class _Frame:
    """A trie node whose subtree is being walked."""

    __slots__ = ("depth", "node", "size", "known", "first", "n", "low", "children", "leaves", "saved", "ends", "below", "has")

    def __init__(self, depth: int, node: bytes, size: int, known: bool, first: bool) -> None:
        self.depth, self.node, self.size, self.known, self.first = depth, node, size, known, first
        self.n = self.children = self.leaves = self.saved = self.has = 0
        self.low = self.ends = None
        self.below: list[int] = []


NODE = (
    "node binary, parent binary, depth bigint, open boolean, conv_id {kind}, parent_conv_id {kind}, parent_open boolean, "
    "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
)


def least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def chunk_nodes(
    paths: list[bytes], sizes: list[bytes], n: list[int], low: list[int | None], ends: list[str], known: int, extended: bool
) -> list[tuple]:
    """Rows of one chunk's trie nodes, in the columns of `NODE`.

    `known` is the number of turns that the first path shares with the one before it (-1: none is before), `extended`
    says whether the path behind the last one goes on from it.
    """
    turns = np.frombuffer(b"".join(paths), dtype="V16")
    # byte order of digests is kept by their order as big-endian halves
    halves = turns.view(">u8").reshape(-1, 2).astype(np.uint64)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    ranked = halves[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    numbers = np.empty(len(order), dtype=">u4")
    numbers[order] = np.cumsum(fresh) - 1
    digests = [turns[i].tobytes() for i in order[fresh]]
    width = np.zeros(len(digests), np.int64)
    width[numbers.astype(np.int64)] = np.frombuffer(b"".join(sizes), dtype="<i8")

    tree, packed, at = RadixTree(), numbers.tobytes(), 0
    for i, path in enumerate(paths):
        step = len(path) // 16 * WIDTH
        tree.insert(packed[at : at + step], i)
        at += step

    rows: list[list] = []
    stack = [_Frame(0, ROOT, 0, known >= 0, True)]
    path, on_first = bytearray(), True

    def close(frame: _Frame, last: bool) -> None:
        is_open = frame.first or last
        frame.saved += (frame.n - (not frame.known)) * frame.size
        parent = stack[-1] if stack else None
        if not is_open:
            for i in frame.below:
                rows[i][5], rows[i][6] = frame.low, False
        if parent:
            parent.n += frame.n
            parent.low = least(parent.low, frame.low)
            parent.children += not frame.known
            parent.leaves += frame.leaves
            parent.saved += frame.saved
            parent.below.append(len(rows))
        rows.append(
            [frame.node, parent.node if parent else None, frame.depth, is_open, frame.low, None, True]
            + [frame.n, frame.children, frame.leaves, frame.saved, frame.ends]
        )

    for above, edge, value in tree.walk():
        del path[above:]
        path += edge
        # frames of other branches end here
        while stack[-1].depth * WIDTH > above:
            close(stack.pop(), False)
        for depth in range(above // WIDTH + 1, len(path) // WIDTH + 1):
            turn = int.from_bytes(path[(depth - 1) * WIDTH : depth * WIDTH], "big")
            stack[-1].has += 1
            node = hashlib.md5(stack[-1].node + digests[turn]).digest()
            stack.append(_Frame(depth, node, int(width[turn]), on_first and depth <= known, on_first))
        if value is not None:
            top, on_first = stack[-1], False
            top.n += n[value]
            top.low = least(top.low, low[value])
            top.ends = ends[value]
            top.leaves += value == len(paths) - 1 and not extended
            # a key in the middle is a leaf if the next key does not extend it
            top.leaves += value < len(paths) - 1 and not paths[value + 1].startswith(paths[value])
    while stack:
        close(stack.pop(), True)
    return [tuple(r) for r in rows]


def turn_digests(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, turn, id, size): the digest of role and text, and the text's bytes."""
    said = [F.coalesce(col(c).cast("string"), F.lit("")) for c in (role, text)]
    size = F.octet_length(said[1]).cast("long")
    # the role's length keeps role and text apart
    whole = F.concat(F.length(said[0]).cast("string"), F.lit(":"), *said)
    return rows.select(
        col(conv_id).cast("long").alias("conv_id"),
        col(turn).alias("turn"),
        F.unhex(F.md5(whole.cast("binary"))).alias("id"),
        size.alias("size"),
    )


def paths(turns: DataFrame, block: Column | None = None, head: Callable[[int], int] | None = None) -> DataFrame:
    """(conv_id, node, path, sizes): every conversation as the digests of its turns, with the digest of the whole.

    With `head`, conversations of one `block` are read together: conversation c takes its first head(c) turns from the
    conversation whose id is the block's number, if there is one, and goes on with its own turns behind those.
    """
    block = F.col("conv_id") if block is None else block
    ordered = turns.withColumn("block", block).repartition("block")
    ordered = ordered.sortWithinPartitions("block", "conv_id", F.col("turn").asc_nulls_first(), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        held = 0
        conv = source = None
        ids: list[bytes] = []
        sizes: list[int] = []
        shared: tuple[list, list] = ([], [])
        begun = False

        def finish() -> None:
            nonlocal shared, held
            a, b = ids, sizes
            if head is not None and conv is not None:
                if conv == source:
                    shared = (ids[:], sizes[:])
                take = head(conv)
                a, b = shared[0][:take] + ids[take:], shared[1][:take] + sizes[take:]
            node = ROOT
            for i in a:
                node = hashlib.md5(node + i).digest()
            done.append((conv, node, b"".join(a), np.array(b, "<i8").tobytes()))
            held += len(a) * 24 + 64

        def emit() -> pa.RecordBatch:
            columns = zip(*done, strict=True)
            types = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "node", "path", "sizes"])

        for batch in batches:
            for c, i, s, b in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if not begun or c != conv or b != source:
                    if begun:
                        finish()
                        if held > CHUNK_BYTES:
                            yield emit()
                            done.clear()
                            held = 0
                    if not begun or b != source:
                        shared = ([], [])
                    conv, source, begun = c, b, True
                    ids, sizes = [], []
                ids.append(i)
                sizes.append(s)
        if begun:
            finish()
            yield emit()

    return ordered.select("conv_id", "id", "size", "block").mapInArrow(
        run, "conv_id bigint, node binary, path binary, sizes binary"
    )


def _ends(members: DataFrame) -> DataFrame:
    """(node, n, low, ends): per path its conversations' number, least id, and the digest of the ids in order."""
    ordered = members.select("node", "conv_id").repartition("node")
    ordered = ordered.sortWithinPartitions("node", F.col("conv_id").asc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, done = None, []
        n, low, sha = 0, None, None

        def emit() -> pa.RecordBatch:
            types = [pa.binary(), pa.int64(), pa.int64(), pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=["node", "n", "low", "ends"])

        for batch in batches:
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                said = b"null" if conv is None else b"%d" % conv
                if key != node:
                    if node is not None:
                        done.append((node, n, low, sha.hexdigest()))
                    node, n, low, sha = key, 0, conv, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(said)
                n += 1
            if len(done) >= 4096:
                yield emit()
                done.clear()
        if node is not None:
            done.append((node, n, low, sha.hexdigest()))
            yield emit()

    return ordered.mapInArrow(run, "node binary, n bigint, low bigint, ends string")


CHUNK = (
    "part int, nth int, paths array<binary>, sizes array<binary>, n array<bigint>, low array<bigint>, ends array<string>, "
    "first binary, last binary, known int, extended boolean"
)
CHUNK_TYPES = [
    ("part", pa.int32()),
    ("nth", pa.int32()),
    ("paths", pa.list_(pa.binary())),
    ("sizes", pa.list_(pa.binary())),
    ("n", pa.list_(pa.int64())),
    ("low", pa.list_(pa.int64())),
    ("ends", pa.list_(pa.string())),
    ("first", pa.binary()),
    ("last", pa.binary()),
    ("known", pa.int32()),
    ("extended", pa.bool_()),
]


def _chunks(keys: DataFrame, chunk_keys: int) -> DataFrame:
    """Sorted paths as rows of up to `chunk_keys` each, knowing their neighbours inside the partition."""
    ordered = keys.repartitionByRange("path").sortWithinPartitions("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, before = TaskContext.get().partitionId(), 0, None
        held: list[tuple] = []
        used = 0

        def emit(behind: bytes | None) -> pa.RecordBatch:
            nonlocal nth, before
            own = [list(c) for c in zip(*held, strict=True)]
            first, last = own[0][0], own[0][-1]
            known = None if before is None else _shared(before, first) // 16
            extended = None if behind is None else behind.startswith(last)
            row = [part, nth, *own, first if before is None else None, last if behind is None else None, known, extended]
            nth, before = nth + 1, last
            arrays = [pa.array([v], t) for v, (_, t) in zip(row, CHUNK_TYPES, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=[c for c, _ in CHUNK_TYPES])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if held and (len(held) >= chunk_keys or used > CHUNK_BYTES):
                    yield emit(row[0])
                    held, used = [], 0
                held.append(row)
                used += len(row[0]) * 2 + 128
        if held:
            yield emit(None)

    return ordered.select("path", "sizes", "n", "low", "ends").mapInArrow(run, CHUNK)


def _with_neighbours(chunks: DataFrame) -> DataFrame:
    """Chunks that also know the keys next to them in other partitions: one row of two numbers for each partition."""
    edges = chunks.where("first IS NOT NULL OR last IS NOT NULL").groupBy("part")
    edges = edges.agg(F.max("first").alias("first"), F.max("last").alias("last"))
    line = Window.orderBy("part")
    edges = edges.select(
        "part", "first", "last", F.lag("last").over(line).alias("before"), F.lead("first").over(line).alias("behind")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, first, last, before, behind = (c.to_pylist() for c in batch.columns)
            known = [-1 if b is None else _shared(b, f) // 16 for b, f in zip(before, first, strict=True)]
            goes_on = [b is not None and b.startswith(k) for b, k in zip(behind, last, strict=True)]
            arrays = [pa.array(part, pa.int32()), pa.array(known, pa.int32()), pa.array(goes_on)]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "edge_known", "edge_extended"])

    found = edges.mapInArrow(run, "part int, edge_known int, edge_extended boolean")
    return chunks.join(found, "part").select(
        "paths",
        "sizes",
        "n",
        "low",
        "ends",
        F.coalesce("known", "edge_known").alias("known"),
        F.coalesce("extended", "edge_extended").alias("extended"),
    )


def trie(members: DataFrame, chunk_keys: int = CHUNK_KEYS) -> DataFrame:
    """One row per node from the paths of `paths`: see `prefix_trie`."""
    members = stored(members, "paths")
    whole = members.groupBy("node").agg(F.first("path").alias("path"), F.first("sizes").alias("sizes"))
    keys = whole.join(_ends(members), "node")
    chunks = stored(_chunks(keys, chunk_keys), "trie-chunks")

    names = [part.split()[0] for part in NODE.split(", ")]
    types = [pa.binary(), pa.binary(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_()]
    types += [pa.int64()] * 4 + [pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                made = chunk_nodes(*(batch.column(k)[i].as_py() for k in range(7)))
                columns = zip(*made, strict=True)
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    nodes = stored(_with_neighbours(chunks).mapInArrow(run, NODE.format(kind="bigint")), "trie-nodes")
    counts = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    shown = ["conv_id", "depth", "parent_conv_id", *counts, F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")]
    parts = nodes.where("open").groupBy("node")
    whole = parts.agg(
        F.max("parent").alias("parent"),
        F.max("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in counts],
        F.max("ends_sha256").alias("ends_sha256"),
    )
    whole = stored(whole, "trie-open")
    inside = nodes.where("NOT open AND NOT parent_open").select(*shown)
    keep = ["parent", "depth", "conv_id", *counts, "ends_sha256"]
    edge = nodes.where("NOT open AND parent_open").select(*keep).unionByName(whole.select(*keep))
    above = whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return inside.unionByName(edge.join(above, "parent", "left").select(*shown))


def prefix_trie(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The trie of a table of turns.

    Per node: conv_id (least member), depth (turns), parent_conv_id (the parent's conv_id; null at the root), n_convs,
    n_children, n_leaves (childless nodes of the subtree, itself included), saved_tokens (bytes that a cache of shared
    prefixes saves: over the subtree, each node's other members times its last text), ends_sha256 (of the ids of the
    conversations that end here).
    """
    return trie(paths(turn_digests(rows, conv_id, turn, role, text)))
