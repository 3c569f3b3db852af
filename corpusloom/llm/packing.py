"""Hierarchical packing of tokenized documents into windows of several context sizes.

A document's tokens are its text's ids and the end id. Parts of 2048 ids fill a window alone; what is left is routed to the
smallest tier (256, 512, 1024, 2048) that holds it. From the longest on, each opens a window of its tier; the gap is
filled with whole shorter parts, longest first, and when none fits, with a cut from the shortest part, whose remainder goes
back to its own tier. So windows are exactly as long as their tier. Step groups hold windows of one tier with the same
number of tokens in all (`STEP_TOKENS`), however long the windows are. A piece's own `step_group` counts within its task;
`step_groups` numbers the windows of a packed table over all tasks, by the tokens they really hold.

Each task packs its own rows, chunk by chunk, and hands parts left over to its next chunk; nothing is shuffled, and a
rerun task makes the same windows. The last open window of a task is cut at powers of two, so nothing is padded.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import col, slices
from corpusloom.llm.tokens import encode

TIERS = (256, 512, 1024, 2048)
END_ID = 1
STEP_TOKENS = 16 * 2048
CHUNK_TOKENS = 2_000_000

PIECE = (
    "start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step_group bigint"
)

Part = tuple[int, int, int]  # length, document, start


class Packer:
    """Packs the parts of one task; gives pieces as (document, start, length, sequence, offset, tier, step group)."""

    def __init__(self, task: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS):
        self.tiers, self.step_tokens = tiers, step_tokens
        self.base, self.made = task << 32, 0
        self.per_tier = dict.fromkeys(tiers, 0)
        self.pool: list[Part] = []

    def add(self, document: int, size: int) -> list[tuple]:
        """Take a document; gives the windows that it fills alone."""
        top, out = self.tiers[-1], []
        for start in range(0, size - top + 1, top):
            out += self._window([(top, document, start)], top)
        rest = size % top
        if rest:
            insort(self.pool, (rest, document, size - rest))
        return out

    def _window(self, parts: list[Part], tier: int) -> list[tuple]:
        sequence, offset, out = self.base + self.made, 0, []
        group = (self.base << 8) + (tier.bit_length() << 32) + self.per_tier[tier] * tier // self.step_tokens
        self.made += 1
        self.per_tier[tier] += 1
        for size, document, start in parts:
            out.append((document, start, size, sequence, offset, tier, group))
            offset += size
        return out

    def _fill(self) -> tuple[list[Part], int, int]:
        """Open a window with the longest part; its parts, its tier and the gap that stays when the pool is empty."""
        first = self.pool.pop()
        tier = next(t for t in self.tiers if t >= first[0])
        parts, gap = [first], tier - first[0]
        while gap and self.pool:
            at = bisect_right(self.pool, (gap, 1 << 62, 0))
            if at:
                part = self.pool.pop(at - 1)
            else:
                size, document, start = self.pool.pop(0)
                part = (gap, document, start)
                insort(self.pool, (size - gap, document, start + gap))
            parts.append(part)
            gap -= part[0]
        return parts, tier, gap

    def drain(self, final: bool) -> list[tuple]:
        """Windows of all parts held; without `final`, an open last window stays for the next chunk."""
        out: list[tuple] = []
        while self.pool:
            parts, tier, gap = self._fill()
            if not gap:
                out += self._window(parts, tier)
            elif not final:
                for part in parts:
                    insort(self.pool, part)
                break
            else:
                out += self._tail(parts)
        return out

    def _tail(self, parts: list[Part]) -> list[tuple]:
        """An open window, cut at powers of two."""
        out, left = [], sum(p[0] for p in parts)
        while parts:
            take = 1 << (left.bit_length() - 1)
            tier, now, room = next(t for t in self.tiers if t >= take), [], take
            while room:
                size, document, start = parts.pop(0)
                now.append((min(size, room), document, start))
                if size > room:
                    parts.insert(0, (size - room, document, start + room))
                room -= now[-1][0]
            out += self._window(now, tier)
            left -= take
        return out


def pack(docs: DataFrame, text: str = "text", tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, **keep: Column) -> DataFrame:
    """One row per piece: `keep` columns of its document, and start, length, ids (little-endian unsigned 32-bit numbers),
    doc_tokens (with the end id), sequence_id, offset, tier, step_group.

    Null and empty texts are the end id alone. Equal rows are packed each for itself. An empty table gives no pieces.
    """
    source = docs.select(*[v.alias(k) for k, v in keep.items()], col(text).cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId(), tiers, step_tokens)
        rows: list[pa.RecordBatch] = []  # documents with parts not yet packed
        tokens: list[np.ndarray] = []
        pieces: list[tuple] = []
        held = 0

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal rows, tokens, pieces, held
            pieces += packer.drain(final)
            kept = pa.Table.from_batches(rows)
            for i in range(0, len(pieces), 2000):
                yield _batch(pieces[i : i + 2000], kept, tokens)
            alive = sorted({p[1] for p in packer.pool})
            number = {d: i for i, d in enumerate(alive)}
            packer.pool = [(size, number[d], start) for size, d, start in packer.pool]
            rows, tokens = kept.take(pa.array(alive, pa.int64())).to_batches(), [tokens[d] for d in alive]
            pieces, held = [], sum(map(len, tokens))

        for batch in batches:
            for part in slices(batch):
                rows.append(part.select(part.schema.names[:-1]))
                for value in part.column(part.num_columns - 1).to_pylist():
                    ids = np.append(encode(value), np.uint32(END_ID)).astype("<u4")
                    pieces += packer.add(len(tokens), len(ids))
                    tokens.append(ids)
                    held += len(ids)
                if held >= CHUNK_TOKENS:
                    yield from flush(False)
        if rows and (pieces or packer.pool):
            yield from flush(True)

    return source.mapInArrow(run, f"{schema}, {PIECE}")


def _batch(pieces: list[tuple], kept: pa.Table, tokens: list[np.ndarray]) -> pa.RecordBatch:
    documents, starts, sizes, sequences, offsets, tiers, groups = zip(*pieces, strict=True)
    ids = [tokens[d][s : s + n].tobytes() for d, s, n in zip(documents, starts, sizes, strict=True)]
    own = kept.take(pa.array(documents, pa.int64())).combine_chunks().to_batches()[0]
    columns = [
        *own.columns,
        pa.array(starts, pa.int64()),
        pa.array(sizes, pa.int64()),
        pa.array(ids, pa.binary()),
        pa.array([len(tokens[d]) for d in documents], pa.int64()),
        pa.array(sequences, pa.int64()),
        pa.array(offsets, pa.int64()),
        pa.array(tiers, pa.int32()),
        pa.array(groups, pa.int64()),
    ]
    names = [c.split()[0] for c in PIECE.split(", ")]
    return pa.RecordBatch.from_arrays(columns, names=[*own.schema.names, *names])


def step_groups(pieces: DataFrame, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """(sequence_id, tier, n_tokens, step_group) of a stored table of pieces: the windows of a tier, dealt to groups in order.

    A group takes the windows that begin in its stretch of `step_tokens`, so its tokens differ from that by less than one
    window; only the last group of a tier may be short. Tokens are summed within a task first, and one row for each
    (tier, task) takes part in the pass over a tier.
    """
    windows = pieces.groupBy("sequence_id", "tier").agg(F.sum("length").alias("n_tokens"))
    windows = windows.withColumn("_task", F.shiftright("sequence_id", 32))
    totals = windows.groupBy("tier", "_task").agg(F.sum("n_tokens").alias("_total"))
    over = Window.partitionBy("tier").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("tier", "_task", F.coalesce(F.sum("_total").over(over), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("tier", "_task").orderBy("sequence_id").rowsBetween(Window.unboundedPreceding, -1)
    windows = windows.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    group = F.floor((F.col("_before") + F.col("_inside")) / step_tokens).cast("long").alias("step_group")
    return windows.join(before, ["tier", "_task"]).select("sequence_id", "tier", "n_tokens", group)


def digest_columns(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum of their ids in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
