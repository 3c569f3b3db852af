"""Exact substring dedup: bytes covered by a string of `least` bytes that starts twice, found by blockwise suffix sorting.

1. **Anchors.** Of every `least`-byte string the start of its least `gram`-byte hash (leftmost, if equal) is its anchor.
   Equal strings have equal anchors, so strings with different anchor hashes never need to be compared. Consecutive
   starts with one anchor form a context: the bytes that their strings cover.
2. **Contexts.** An anchor hash that occurs once repeats nothing. A context that occurs twice as a whole is settled: all
   its strings repeat. Of the rest, one copy of each distinct context goes to its anchor's bucket, if the bucket holds
   several distinct ones.
3. **Blocks.** A task takes its buckets in blocks of bounded size and sorts their suffixes: by their first bytes, and
   suffixes that tie over a whole period by the ranks of a difference cover sample. For any two positions the cover (a
   perfect difference set) holds one small shift that brings both to sampled ones, whose ranks were computed before, by
   doubling, to a depth of `least` at least. Neighbours in this order that agree in `least` bytes repeat.
4. A bucket of more than `HOT` distinct contexts is cut into pieces by the context's hash. Each piece is sorted alone and hands on
   the digest of one string of each class; classes of one string that another piece holds too repeat as well.

The result is exact: hashes only decide what is compared, except that contexts and strings count as equal by 128 bits of
hash where they are counted across tasks.

Positions are those of the input's UTF-8 bytes; matches never cross documents; null counts as empty; equal rows are copies
of each other; a text shorter than `least` loses nothing; an empty table gives an empty result. Columns of any name pass
through in `row`. Very long texts are read in pieces; a document's text and spans must fit in a task.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import col, discard, map_slices, nested, stored

LEAST = 400
# Starts of a long text that are looked at together; bytes of a block; contexts of a bucket in one piece.
PIECE, BLOCK, HOT = 1 << 19, 1 << 19, 4096
# A cover is a perfect difference set modulo p**2 + p + 1.
PRIMES = (5, 3, 2)

_MIX = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_LOW = np.uint64((1 << 32) - 1)


def gram_bytes(least: int) -> int:
    """Bytes that an anchor hashes: a power of two, about a third of `least`."""
    if least < 24:
        raise ValueError("strings of 24 bytes at least")
    return 1 << ((least // 3).bit_length() - 1)


def anchors(data: np.ndarray, first: np.ndarray, count: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Contexts of texts that lie one behind the other in `data`.

    `first` and `count` give the starts of each text. Returns, per context: its text, first start, last start, hash.
    """
    gram = gram_bytes(least)
    window = least - gram + 1
    padded = np.concatenate([data, np.zeros(8 + gram, np.uint8)])
    h = np.ndarray((len(data) + gram,), "<u8", buffer=padded, strides=(1,)) * _MIX[0]
    span = 8
    while span < gram:
        h = h[:-span] * _MIX[1] + h[span:]
        span *= 2
    h ^= h >> np.uint64(32)
    h *= _MIX[2]
    h ^= h >> np.uint64(29)
    value = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    short = -len(value) % window
    blocks = np.concatenate([value, np.full(short + window, ~np.uint64(0))]).reshape(-1, window)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    onward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    owner = np.repeat(np.arange(len(first)), count)
    begin = np.cumsum(count) - count
    start = np.arange(len(owner)) - np.repeat(begin - first, count)
    at = np.minimum(onward[start], upto[start + window - 1]) & _LOW
    opens = np.ones(len(start), bool)
    opens[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    low = np.flatnonzero(opens)
    high = np.append(low[1:], len(start)) - 1
    return owner[low], start[low], start[high], h[at[low].astype(np.int64)].view(np.int64)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts or bytes, and the n + 1 offsets of its values in them; null counts as empty."""
    column = pa.concat_arrays([column.cast(pa.large_binary()).fill_null(b"")])
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[: offsets[-1]], offsets


OCCURRENCE = ["k1", "k2", "low", "high", "anchor", "context"]


def _contexts_of(part: pa.RecordBatch, least: int) -> pa.RecordBatch | None:
    k1, k2 = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    data, offsets = _texts(part.column(2))
    found: list[list[np.ndarray]] = []
    # starts of all texts, dealt in pieces
    size = np.diff(offsets)
    count = np.maximum(size - least + 1, 0)
    pieces: list[tuple[int, int, int]] = []
    for i in np.flatnonzero(count):
        pieces += [(i, a, min(PIECE, count[i] - a)) for a in range(0, count[i], PIECE)]
    while pieces:
        take, used = 0, 0
        while take < len(pieces) and (not take or used + pieces[take][2] <= PIECE):
            used += pieces[take][2]
            take += 1
        now, pieces = pieces[:take], pieces[take:]
        begin = offsets[now[0][0]] + now[0][1]
        end = offsets[now[-1][0]] + now[-1][1] + now[-1][2] + least - 1
        first = np.array([offsets[i] + a - begin for i, a, _ in now])
        own, low, high, anchor = anchors(data[begin:end], first, np.array([n for _, _, n in now]), least)
        text = np.array([i for i, _, _ in now])[own]
        view = memoryview(data[begin:end])
        bounds = zip(low.tolist(), (high + least).tolist(), strict=True)
        context = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in bounds], np.uint64).view(np.int64)
        shift = begin - offsets[text]
        found.append([k1[text], k2[text], low + shift, high + shift, anchor, context])
    if not found:
        return None
    arrays = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=OCCURRENCE)


@functools.cache
def difference_cover(prime: int) -> tuple[int, np.ndarray]:
    """(v, D): every number modulo v = prime² + prime + 1 is the difference of exactly one pair of the prime + 1 members.

    D is where a linear recurrence of order three over the field of `prime` elements is zero; the first recurrence whose
    zeros have that property is taken.
    """
    v = prime * prime + prime + 1
    for code in range(prime**3):
        a, b, c = code % prime, code // prime % prime, code // prime**2
        s = [0, 0, 1]
        while len(s) < v:
            s.append((a * s[-1] + b * s[-2] + c * s[-3]) % prime)
        zeros = np.flatnonzero(np.array(s) == 0)
        if len(zeros) == prime + 1 and len({(x - y) % v for x in zeros for y in zeros}) == v:
            return v, zeros
    raise ValueError(f"no difference set for {prime}")


@functools.cache
def _shifts(prime: int) -> np.ndarray:
    """For residues a and b the least shift that brings both into the cover."""
    v, cover = difference_cover(prime)
    inside = np.zeros(v, bool)
    inside[cover] = True
    table = np.zeros((v, v), np.int64)
    for a in range(v):
        for b in range(v):
            table[a, b] = next(d for d in range(v) if inside[(a + d) % v] and inside[(b + d) % v])
    return table


def _dense(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Ranks from 0 of items that `order` sorts by `keys`."""
    fresh = np.zeros(len(order), bool)
    for key in keys:
        ranked = key[order]
        fresh[1:] |= ranked[1:] != ranked[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(fresh)
    return rank


def _cover_ranks(words: np.ndarray, n: int, depth: int, prime: int) -> np.ndarray:
    """At the sampled positions below n: the rank of the suffix, by `depth` bytes at least; positions behind n count 0."""
    v, cover = difference_cover(prime)
    at = (np.arange(0, n + v, v)[:, None] + cover[None, :]).ravel()
    at = at[at < n]
    prefix = [words[at + 8 * k].astype(np.uint64) for k in range(-(-v // 8))]
    rank = np.zeros(n + depth * 2 + v, np.int64)
    now = _dense(np.lexsort(prefix[::-1]), *prefix) + 1
    reach = v
    while reach < depth:
        rank[at] = now
        pair = now << 32 | rank[at + reach]
        now = _dense(np.argsort(pair, kind="stable"), pair) + 1
        reach *= 2
    rank[at] = now
    return rank


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Do the strings of `least` bytes at a and at b agree? Pairs, word by word; those that differ drop out."""
    words = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    live = np.arange(len(a))
    for step in [*range(0, least - 7, 8), least - 8]:
        live = live[words[a[live] + step] == words[b[live] + step]]
    same = np.zeros(len(a), bool)
    same[live] = True
    return same


def repeat_classes(data: np.ndarray, start: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix-sort the starts of one block: (order, class), both in sorted order; a class is one string of `least` bytes.

    Each string must lie inside `data`.
    """
    # the largest period whose whole words a string still holds
    prime = next(p for p in PRIMES if -(-(p * p + p + 1) // 8) * 8 <= least)
    v, _ = difference_cover(prime)
    shifts = _shifts(prime)
    n = len(data)
    padded = np.concatenate([data, np.zeros(2 * v + 16, np.uint8)])
    words = np.ndarray((n + 2 * v,), ">u8", buffer=padded, strides=(1,))
    rank = _cover_ranks(words, n, least, prime)
    # buckets: suffixes that agree in their first v bytes or more
    prefix = [words[start + 8 * k].astype(np.uint64) for k in range(-(-v // 8))]
    order = np.lexsort(prefix[::-1])
    bucket = _dense(order, *prefix)[order]
    at = start[order]
    # ties: all buckets are parted at once, each by a pivot, until every part is of one rank
    part, place = bucket.copy(), np.arange(len(at))
    while len(place):
        opens = np.ones(len(place), bool)
        opens[1:] = part[place[1:]] != part[place[:-1]]
        width = np.diff(np.append(np.flatnonzero(opens), len(place)))
        place, width = place[np.repeat(width > 1, width)], width[width > 1]
        group = np.repeat(np.arange(len(width)), width)
        here = at[place]
        pivot = here[np.cumsum(width) - width + width // 2][group]
        shift = shifts[here % v, pivot % v]
        sign = np.sign(rank[here + shift] - rank[pivot + shift])
        by = np.argsort(group * 3 + sign, kind="stable")
        at[place], order[place], sign = here[by], order[place][by], sign[by]
        opens = np.ones(len(place), bool)
        opens[1:] = (group[1:] != group[:-1]) | (sign[1:] != sign[:-1])
        part[place] = np.cumsum(opens)
        place = place[sign != 0]
    same = np.zeros(len(at), bool)
    pair = np.flatnonzero(bucket[1:] == bucket[:-1])
    a, b = at[pair], at[pair + 1]
    shift = shifts[a % v, b % v]
    alike = rank[a + shift] == rank[b + shift]
    alike[~alike] = _same(padded, a[~alike], b[~alike], least)
    same[pair + 1] = alike
    return order, np.cumsum(~same)


BUCKET = "anchor bigint, piece bigint, pieces bigint, settled boolean, k1 bigint, k2 bigint, low bigint, text binary"
FOUND = "k1 bigint, k2 bigint, low bigint, high bigint, string binary"


def _ranges(owner: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(owner, first, last) of runs of consecutive starts."""
    if len(owner):
        by = np.lexsort((start, owner))
        owner, start = owner[by], start[by]
        opens = np.ones(len(owner), bool)
        opens[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)
        low = np.flatnonzero(opens)
        high = np.append(low[1:], len(owner)) - 1
        yield from zip(owner[low].tolist(), start[low].tolist(), start[high].tolist(), strict=True)


def sort_block(rows: list[tuple], least: int) -> list[tuple]:
    """Rows of `FOUND` for one block of whole buckets or pieces: (anchor, piece, pieces, settled, k1, k2, low, text).

    A row with an owner and no string is a range of starts that repeat. A string (digest) stands for a class of a cut
    bucket; it has an owner if that is the only start of the class and not known to repeat.
    """
    size = np.array([len(r[7]) for r in rows])
    base = np.cumsum(size) - size
    count = size - least + 1
    owner = np.repeat(np.arange(len(rows)), count)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    data = np.frombuffer(b"".join(r[7] for r in rows), np.uint8)
    order, kind = repeat_classes(data, base[owner] + inner, least)
    owner, inner = owner[order], inner[order]
    many = np.bincount(kind)[kind] > 1
    known = np.array([r[3] for r in rows])[owner]
    new = many & ~known
    made = [(*rows[i][4:6], rows[i][6] + a, rows[i][6] + b, None) for i, a, b in _ranges(owner[new], inner[new])]
    cut = np.array([r[2] > 1 for r in rows])[owner]
    head = np.ones(len(kind), bool)
    head[1:] = kind[1:] != kind[:-1]
    ask = np.flatnonzero(cut & head)
    for i, a, free in zip(owner[ask].tolist(), inner[ask].tolist(), (~many & ~known)[ask].tolist(), strict=True):
        string = xxhash.xxh3_128_digest(rows[i][7][a : a + least])
        place = (*rows[i][4:6], rows[i][6] + a, rows[i][6] + a) if free else (None, None, None, None)
        made.append((*place, string))
    return made


def _sorted_blocks(buckets: DataFrame, least: int, block: int) -> DataFrame:
    """`FOUND` rows of all buckets: a task sorts whole buckets, about `block` bytes at a time."""
    ordered = buckets.repartition("anchor", "piece").sortWithinPartitions("anchor", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        seen: set[bytes] = set()
        used, current = 0, None

        def settle() -> Iterator[pa.RecordBatch]:
            made = sort_block(held, least)
            if made:
                types = [pa.int64()] * 4 + [pa.binary()]
                arrays = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["k1", "k2", "low", "high", "string"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != current:
                    if used >= block:
                        yield from settle()
                        held, used = [], 0
                    current, seen = row[:2], set()
                if row[7] not in seen:
                    seen.add(row[7])
                    held.append(row)
                    used += len(row[7])
        if held:
            yield from settle()

    return ordered.mapInArrow(run, FOUND)


def _cut_contexts(joined: DataFrame, text: str, least: int) -> DataFrame:
    """The wanted contexts of documents joined with their lists; copies of a document that follow it are passed over."""
    at = joined.columns.index("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            k1, k2, wanted = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("k1", "k2", "wanted"))
            texts = batch.column(at).field(text)
            for i, key in enumerate(zip(k1, k2, strict=True)):
                if key == before:
                    continue
                before = key
                data = (texts[i].as_py() or "").encode()
                made = [
                    (w["anchor"], w["piece"], w["pieces"], w["settled"], *key, w["low"], data[w["low"] : w["high"] + least])
                    for w in wanted[i]
                ]
                types = [pa.int64()] * 3 + [pa.bool_()] + [pa.int64()] * 3 + [pa.binary()]
                arrays = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in BUCKET.split(", ")])

    return joined.mapInArrow(run, BUCKET)


def _cut_spans(joined: DataFrame, text: str, least: int) -> DataFrame:
    """Documents joined with their ranges of repeating starts, without the bytes that these cover."""
    kind = joined.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index("row"))
            texts = rows.field(text)
            starts = batch.column(batch.schema.get_field_index("starts"))
            size, all_spans, kept = [], [], []
            for i in range(batch.num_rows):
                data = (texts[i].as_py() or "").encode()
                spans: list[list[int]] = []
                for r in sorted((r["low"], r["high"] + least) for r in starts[i].as_py() or []):
                    if spans and r[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r[1])
                    else:
                        spans.append(list(r))
                ends = [0, *(e for _, e in spans)]
                size.append(len(data))
                all_spans.append([{"begin": a, "end": b} for a, b in spans])
                kept.append(b"".join(data[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(data)], strict=True)))
            span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            arrays = [rows, pa.array(size, pa.int64()), pa.array(all_spans, span), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "n_bytes", "spans", "kept"])

    schema = f"row {kind}, n_bytes bigint, spans array<struct<begin:bigint,end:bigint>>, kept binary"
    return joined.select("row", "starts").mapInArrow(run, schema)


def _resolved(occurrences: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    """Occurrences whose anchor repeats, with `settled` and, for one copy of each distinct context to be sorted, `wanted`.

    Also (anchor, pieces) of the buckets with more than `hot` distinct contexts.
    """
    # copies count alike, so what makes a bucket large is the number of distinct contexts, not of occurrences
    anchor = occurrences.groupBy("anchor").agg(
        F.count("*").alias("held"), (F.min("context") == F.max("context")).alias("alone")
    )
    anchor = stored(anchor.where("held > 1").select("anchor", "alone"), "suffix-anchors")
    shared = stored(occurrences.join(anchor, "anchor"), "suffix-shared")
    place = F.struct("k1", "k2", "low")
    context = shared.where("NOT alone").groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(place).alias("one"))
    context = stored(context, "suffix-contexts")
    known = shared.join(context, ["anchor", "context"], "left")
    settled = F.col("alone") | (F.col("n") > 1)
    wanted = ~F.col("alone") & (F.col("one") == place)
    known = stored(known.select(*OCCURRENCE, settled.alias("settled"), wanted.alias("wanted")), "suffix-known")
    discard(anchor, shared)
    pieces = F.ceil(F.count("*") / hot).alias("pieces")
    return known, stored(context.groupBy("anchor").agg(pieces).where("pieces > 1"), "suffix-pieces")


def remove_repeats(docs: DataFrame, text: str = "text", least: int = LEAST, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """Input rows as `row`, with n_bytes, `spans` (begin, end: the maximal removed runs of bytes) and `kept` (bytes)."""
    value = F.coalesce(col(text).cast("string"), F.lit(""))
    key = {"k1": F.xxhash64(value), "k2": F.xxhash64(F.lit(1), value)}
    bare = docs.select(*[v.alias(k) for k, v in key.items()], value.cast("binary").alias("text"))
    schema = ", ".join(f"{c} bigint" for c in OCCURRENCE)
    occurrences = map_slices(bare.where(F.octet_length("text") >= least), lambda part: _contexts_of(part, least), schema)
    known, cut = _resolved(occurrences, hot)

    source = nested(docs, **key)
    pieces = F.coalesce("pieces", F.lit(1).cast("long"))
    wish = F.struct("anchor", F.pmod("context", pieces).alias("piece"), pieces.alias("pieces"), "settled", "low", "high")
    wishes = known.where("wanted").join(cut, "anchor", "left").groupBy("k1", "k2").agg(F.collect_set(wish).alias("wanted"))
    contexts = _cut_contexts(source.join(wishes, ["k1", "k2"]), text, least)
    made = stored(_sorted_blocks(contexts, least, block), "suffix-found")

    strings = made.where("string IS NOT NULL")
    twice = strings.groupBy("string").agg(F.count("*").alias("n")).where("n > 1").select("string")
    across = strings.where("k1 IS NOT NULL").join(twice, "string")
    places = ["k1", "k2", "low", "high"]
    starts = known.where("settled").select(*places).unionByName(made.where("string IS NULL").select(*places))
    starts = starts.unionByName(across.select(*places)).groupBy("k1", "k2")
    starts = starts.agg(F.collect_set(F.struct("low", "high")).alias("starts"))
    return _cut_spans(source.join(starts, ["k1", "k2"], "left"), text, least)


def digest_columns(done: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Per document: bytes, removed bytes, removed runs, and the digest of what stays."""
    return done.select(
        F.col("row").getField(doc_id).alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
