"""Near-duplicate detection by order min-hash, checked by banded alignment.

Words are runs without white space, A-Z lower-cased. A five-word run with its occurrence number (first, second, ... time
in the text) is one labelled k-mer. Each of `SKETCHES` hash functions picks the `PICKS` labelled k-mers of least hash and
keeps them in text order; texts that agree on any such tuple share a bucket. Texts with the same k-mers in another order
seldom agree, which makes the sketch follow edit similarity. A text of one to four words is one k-mer.

Two texts are linked if at least 0.8 of the longer one's words survive, that is, if the word edit distance is at most 0.2
of the longer length. Alignment fills the band of diagonals this bound leaves, one word and a whole column of the band at a
time, the column's differences being the bits of two numbers. A class is a component of links.

Equal texts collapse to one before anything is compared. A round is linear in the members of buckets. In each bucket the shortest text of each band of lengths is its leader, and every text is compared
with the leaders of its own band and the two next to it. Texts that fail the same leader may still be similar to each
other, by what they share beyond it. So they are sketched again without the k-mers that the leader holds, and meet in new
buckets of that group; only groups whose members are not in one component yet go on. Leaders that hold the same passage of a
text leave the same rest of it, which is sketched once, however many they are: rests of all groups look for equal tuples
together, and only those that meet another component are dealt to their groups. Every round takes k-mers away, so the
rounds end by themselves, when no bucket has members of two components left.

What a leader holds may be all that two texts share, and a text linked to a leader may be similar to one that is not. So the
rounds are followed by a closing: texts that met the same leader and are not in one component yet are compared with each other,
all pairs of them. As long as their lengths fit, two texts of one bucket met the same leader; so every pair that shares a bucket
is aligned, or proved unlike, or in one class. Pairs are counted off in tiles of bounded size, by how many words of the longer
text the other one cannot have (each costs an edit); only pairs that this leaves become rows. This step is quadratic in the
texts of one length around one passage; its rows grow with their number over the side of a tile.

Candidates are sampled, so a link can be missed: scattered edits are found with a probability of about 0.85 at a
similarity of 0.8, 0.98 at 0.85 and over 0.999 from 0.9 on (see the tests); what a class needs is one path of links.

Null and wordless texts match nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import col, digest, discard, map_slices, nested, stored, unnested
from corpusloom.llm.components import components

K = 5
PICKS = 2
SKETCHES = 48
SIMILARITY = 0.8
# The side of a tile of pairs: so many texts, with so many words in all.
TILE_TEXTS = 4096
TILE_WORDS = 4_000_000

LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
MULTIPLIERS = np.random.default_rng(20240601).integers(1, 2**63, size=SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def hash_words(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts, and where each text starts (with the end as last entry)."""
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    codes, uniques = pd.factorize(np.array([w for t in texts for w in t] + [b""], dtype=object))
    values = pd.util.hash_array(np.array([u.decode("utf-8", "surrogatepass") for u in uniques], dtype=object), categorize=False)
    return values[codes[:-1]], bounds


def kmers(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; of a shorter text, the one run it is."""
    k = min(k, len(words))
    size = len(words) - k + 1
    out = np.zeros(size, dtype=np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x100000001B3) + words[i : i + size])
    return out


def labelled(values: np.ndarray) -> np.ndarray:
    """Mix the occurrence number into repeated values."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    at = np.arange(len(values))
    count = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty_like(values)
    out[order] = mix(ordered + count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out


def sketch(values: np.ndarray, picks: int = PICKS) -> np.ndarray:
    """One 64-bit tuple hash per hash function."""
    if len(values) > picks:
        # the values are mixed already, so a product's high bits rank them well enough
        ranks = MULTIPLIERS[:, None] * values[None, :]
        rows = np.arange(SKETCHES)
        spots = np.empty((picks, SKETCHES), dtype=np.int64)
        for i in range(picks):
            spots[i] = ranks.argmin(axis=1)
            ranks[rows, spots[i]] = np.uint64(2**64 - 1)
        spots = np.sort(spots, axis=0)
    else:
        spots = np.repeat(np.arange(len(values))[:, None], SKETCHES, axis=1)
    # tuples of different hash functions are different buckets
    out = np.arange(SKETCHES, dtype=np.uint64)
    for row in values[spots]:
        out = mix(out * np.uint64(0x100000001B3) + row)
    return out


def _sketch_lists(runs: list[np.ndarray]) -> pa.Array:
    flat = pa.array(np.concatenate([sketch(r).view(np.int64) for r in runs]) if runs else np.zeros(0, np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(runs) + 1) * SKETCHES, pa.int32()), flat)


def sketches(docs: DataFrame) -> DataFrame:
    """docs (key, text) to (key, n_words, sketch); wordless texts give no row."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [words_of(t) for t in part.column(1).to_pylist()]
        hashed, bounds = hash_words(texts)
        rows = [i for i, t in enumerate(texts) if t]
        runs = [labelled(kmers(hashed[bounds[i] : bounds[i + 1]], K)) for i in rows]
        sizes = pa.array([len(texts[i]) for i in rows], pa.int32())
        keys = part.column(0).take(pa.array(rows, pa.int32()))
        return pa.RecordBatch.from_arrays([keys, sizes, _sketch_lists(runs)], names=["key", "n_words", "sketch"])

    schema = "key binary, n_words int, sketch array<bigint>"
    return map_slices(docs.select("key", "text"), work, schema)


def _sketched_again(rests: DataFrame) -> DataFrame:
    """(part, key, n_words, root, rest) to the same with the sketch of the k-mers that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [np.array(r, np.int64).view(np.uint64) for r in batch.column(4).to_pylist()]
            names = ["part", "key", "n_words", "root", "sketch"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], _sketch_lists(runs)], names=names)

    rows = rests.select("part", "key", "n_words", "root", "rest")
    return rows.mapInArrow(run, "part bigint, key bigint, n_words int, root bigint, sketch array<bigint>")


def edits_within(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Word edit distance, or None if it is over `most`.

    Only cells up to `most` diagonals to each side are filled, a column at a time. A column's steps down (+1 or -1) are
    the bits of two numbers, `up` and `down`; bit t stands for row column - most + t. Rows before the first match nothing.
    """
    same = min(len(a), len(b))
    head = np.flatnonzero(a[:same] != b[:same])
    cut = int(head[0]) if len(head) else same
    a, b = a[cut:], b[cut:]
    same = min(len(a), len(b))
    tail = np.flatnonzero(a[len(a) - same :][::-1] != b[len(b) - same :][::-1])
    cut = int(tail[0]) if len(tail) else same
    a, b = sorted((a[: len(a) - cut].tolist(), b[: len(b) - cut].tolist()), key=len, reverse=True)
    n, m = len(a), len(b)
    if m == 0 or n - m > most:
        return n if n <= most else None
    most = min(most, n)
    width = 2 * most + 1
    full, lowest = (1 << width) - 1, 1 << (width - 1)
    seen: dict[int, tuple[int, int]] = {}  # per word: a row, and its occurrences from that row on as bits

    def enter(row: int) -> None:
        base, bits = seen.get(a[row], (row, 0))
        seen[a[row]] = base, bits | 1 << (row - base)

    for row in range(most):
        enter(row)
    up, down = full ^ ((1 << most) - 1), 0
    distance = most
    for column, word in enumerate(b):
        row = column + most
        if row < n:
            enter(row)
        matches = 0
        if word in seen:
            base, matches = seen[word]
            shift = base - column + most
            if shift < 0:
                matches >>= -shift
                seen[word] = column - most, matches
            else:
                matches <<= shift
        level = ((((matches & up) + up) ^ up) | matches | down) & full  # the diagonal step costs nothing
        right, left = down | (full ^ (level | up)), level & up
        if row < n:
            distance += not level & lowest
            if distance > 2 * most - (n - m):
                return None
        else:
            last = n - 1 - column + most
            distance += (right >> last & 1) - (left >> last & 1)
        shifted = level >> 1
        up, down = left | (full ^ (shifted | right)), shifted & right
    return distance if distance <= most else None


def similar(a: list[bytes], b: list[bytes], threshold: float = SIMILARITY) -> bool:
    """At least `threshold` of the longer text's words survive the cheapest edit."""
    longest = max(len(a), len(b))
    most = int((1 - threshold) * longest + 1e-9)
    codes: dict[bytes, int] = {}
    left, right = (np.array([codes.setdefault(w, len(codes)) for w in x], dtype=np.int64) for x in (a, b))
    # an edit touches at most q runs of q words, so similar texts share all but q * most of the longer one's runs
    for q in (1, 2, 3):
        if q > 1:
            left, right = (x[:-1] * len(codes) + y[q - 1 :] for x, y in ((left, ids_left), (right, ids_right)))
            numbers, inverse = np.unique(np.concatenate([left, right]), return_inverse=True)
            left, right = inverse[: len(left)], inverse[len(left) :]
            size = len(numbers)
        else:
            ids_left, ids_right, size = left, right, len(codes)
        common = np.minimum(np.bincount(left, minlength=size), np.bincount(right, minlength=size)).sum()
        if common < longest - q + 1 - q * most:
            return False
    return edits_within(ids_left, ids_right, most) is not None


def verify(pairs: DataFrame, texts: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """pairs (a, b, busy) of texts' numbers to (a, b, linked, rest).

    Texts meet their pairs by two joins; no pair is formed here. For a busy pair that is not linked, `rest` are the
    labelled k-mers of a that b does not hold, in text order.
    """
    left = texts.select(F.col("key").alias("a"), F.col("text").alias("text"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("other"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text", "other", "busy")

    def rest(x: list[bytes], y: list[bytes]) -> list[int]:
        hashed, bounds = hash_words([x, y])
        own, held = (labelled(kmers(hashed[i:j], K)) for i, j in zip(bounds[:-1], bounds[1:], strict=True))
        return own[~np.isin(own, held)].view(np.int64).tolist()

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        linked, rests = [], []
        for x, y, busy in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
            x, y = words_of(x), words_of(y)
            linked.append(similar(x, y, threshold))
            rests.append(rest(x, y) if busy and not linked[-1] else None)
        arrays = [part.column(0), part.column(1), pa.array(linked, pa.bool_()), pa.array(rests, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, names=["a", "b", "linked", "rest"])

    return map_slices(both, work, "a bigint, b bigint, linked boolean, rest array<bigint>")


def _id_text(doc_id) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


# Texts are known by a number of their own while they are compared; 8 bytes instead of a digest's 16. A part is what
# leaders left of a text, known by a hash: 0 for the whole text.
BUCKET = ["scope", "value"]


def _shared(rows: DataFrame, bucket: list[str]) -> DataFrame:
    """Rows of buckets with members of two components; `held` is a bucket's number of members."""
    ends = rows.groupBy(*bucket).agg(F.count("*").alias("held"), F.min("root").alias("low"), F.max("root").alias("high"))
    return rows.join(ends.where("low != high").drop("low", "high"), bucket)


def _buckets(sketched: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(scope, value, part, key, n_words, root, held) of buckets with members of two components.

    `groups` are the scopes of each part; without them all parts are in one.
    """
    rows = sketched.select("part", "key", "n_words", "root", F.explode("sketch").alias("value"))
    if groups is None:
        return stored(_shared(rows, ["value"]).withColumn("scope", F.lit(0).cast("long")), "members")
    met = stored(_shared(rows, ["value"]).drop("held"), "met")
    members = stored(_shared(met.join(groups, ["part", "key"]), BUCKET), "members")
    discard(met)
    return members


def _led(members: DataFrame, threshold: float) -> DataFrame:
    """(scope, a, b, part, n_words, busy): members with the leaders they have to meet, once in each scope.

    A pair is busy if others of its bucket meet that leader too.
    """
    width = math.log(1 / threshold)
    banded = members.withColumn("band", F.floor(F.log(F.col("n_words")) / width + 1e-9))
    least = F.min(F.struct("n_words", "key", "root")).alias("head")
    heads = banded.groupBy(*BUCKET, "band").agg(least)
    heads = heads.select(*BUCKET, "band", F.col("head.n_words").alias("n_b"), F.col("head.key").alias("b"), F.col("head.root").alias("root_b"))
    asked = banded.withColumn("band", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])))
    fits = F.least("n_words", "n_b") >= threshold * F.greatest("n_words", "n_b")
    met = asked.join(heads, [*BUCKET, "band"]).where(fits & (F.col("root") != F.col("root_b")))
    return met.groupBy("scope", F.col("key").alias("a"), "b").agg(
        F.first("part").alias("part"), F.first("n_words").alias("n_words"), (F.max("held") > 2).alias("busy")
    )


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Roots after more links: only these are contracted, over the roots known so far."""
    if roots is None:
        return stored(components(links, "a", "b"), "roots")
    known = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    lifted = links.join(known("a"), "a", "left").join(known("b"), "b", "left")
    lifted = lifted.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).where("a != b").distinct()
    over = components(stored(lifted, "lifted"), "a", "b").select(F.col("node").alias("root"), F.col("root").alias("top"))
    over = stored(over, "over")
    moved = roots.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    # roots that stood alone before are nodes now
    alone = over.select(F.col("root").alias("node"), F.col("top").alias("root")).join(roots, "node", "left_anti")
    return stored(moved.unionByName(alone), "roots")


def _left_over(failed: DataFrame, roots: DataFrame) -> DataFrame:
    """(scope, a, b, n_words, rest) to (part, key, n_words, root, rest, scopes): each rest of a text once, with its groups.

    A group are the texts of a scope that failed the same leader; those in one component already are left out.
    """
    scope = F.xxhash64("scope", "b").alias("scope")
    failed = failed.where(F.size("rest") > 0).select(scope, F.col("a").alias("key"), "n_words", "rest")
    # a text's root is looked up here, once in each group, and not for each of its buckets
    rooted = failed.join(roots, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key"))
    open_ = rooted.groupBy("scope").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
    rows = rooted.join(open_.select("scope"), "scope", "left_semi")
    same = [F.first(c).alias(c) for c in ("n_words", "root", "rest")]
    return rows.groupBy(F.xxhash64("rest").alias("part"), "key").agg(*same, F.collect_list("scope").alias("scopes"))


def _bags(texts: DataFrame) -> DataFrame:
    """(key, text) to (key, bag): 16 bits of each word's hash."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        hashed, bounds = hash_words([words_of(t) for t in part.column(1).to_pylist()])
        small = hashed.astype(np.uint16)
        bags = [small[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(bags, pa.binary())], names=["key", "bag"])

    return map_slices(texts.select("key", "text"), work, "key bigint, bag binary")


def like_pairs(sizes: np.ndarray, roots: np.ndarray, sides: np.ndarray, bags: list[bytes], threshold: float) -> Iterator[tuple]:
    """Pairs of a tile that may be similar: (place, places, words that the longer text has too many), per text.

    Texts are ordered by size; `sides` are 0 and 1 in a tile of two blocks, where only texts of both are paired. Words fall into
    bins; what the longer text has more of in a bin, the shorter one lacks, so it costs an edit each.
    """
    bins = 1 << min(max(int(sizes[-1]).bit_length(), 6), 12)
    counts = np.empty((len(bags), bins), dtype=np.uint8)
    for i in range(0, len(bags), 256):
        part = [np.frombuffer(b, np.uint16) & np.uint16(bins - 1) for b in bags[i : i + 256]]
        at = np.repeat(np.arange(len(part)) * bins, [len(b) for b in part]) + np.concatenate(part)
        found = np.bincount(at, minlength=len(part) * bins).reshape(len(part), bins)
        counts[i : i + 256] = np.minimum(found, 255)  # cut counts differ by no more than whole ones
    most = ((1 - threshold) * sizes + 1e-9).astype(np.int64)
    ends = np.searchsorted(sizes, sizes / threshold + 1e-6, side="right")
    held = counts.sum(axis=1, dtype=np.int64)
    kind = np.uint16 if sizes[-1] < 2**15 else np.uint32
    two = bool(sides.any())
    for i in range(len(bags) - 1):
        other = roots[i + 1 : ends[i]] != roots[i]
        if two:
            other &= sides[i + 1 : ends[i]] != sides[i]
        spots = np.flatnonzero(other) + i + 1
        for k in range(0, len(spots), 1024):
            some = spots[k : k + 1024]
            extra = np.maximum(counts[some], counts[i]).sum(axis=1, dtype=kind).astype(np.int64) - held[i]
            near = extra <= most[some]
            if near.any():
                yield i, some[near], extra[near]


def _open_pairs(met: DataFrame, texts: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """met (a, b, n_words) of texts and the leaders they met to pairs (a, b, extra) that may be similar.

    These are texts that met one leader and are of different components. Of all leaders that both met, the least one's group
    gives the pair.
    """
    rooted = met.join(roots, F.col("a") == F.col("node"), "left").select("a", "b", "n_words", F.coalesce("root", "a").alias("root"))
    sides = [F.ceil(F.count("*") / TILE_TEXTS), F.ceil(F.sum(F.col("n_words").cast("long")) / TILE_WORDS)]
    ends = [F.min("root").alias("low"), F.max("root").alias("high"), F.greatest(*sides).cast("int").alias("blocks")]
    groups = rooted.groupBy("b").agg(*ends).where("low != high").select("b", "blocks")
    rows = stored(rooted.join(groups, "b"), "grouped")
    some = texts.join(rows.select(F.col("a").alias("key")).distinct(), "key", "left_semi")
    leaders = rows.groupBy("a").agg(F.collect_list("b").alias("leaders"))
    bags = stored(_bags(some).withColumnRenamed("key", "a").join(leaders, "a"), "bags")
    block = F.pmod(F.xxhash64("a"), "blocks").cast("int")
    cut = rows.select("*", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    tile = ["b", "first", "last"]
    dealt = cut.withColumns({"first": F.least("block", "with"), "last": F.greatest("block", "with")}).join(bags, "a")
    dealt = dealt.select(*tile, "n_words", "a", "root", (F.col("block") != F.col("first")).cast("int").alias("side"), "bag", "leaders")
    dealt = dealt.repartition(*tile).sortWithinPartitions(*tile, "n_words")
    names = ["a", "b", "extra"]

    def pairs(leader: int, columns: list[list]) -> pa.RecordBatch:
        sizes, keys, roots, sides = (np.array(c, dtype=np.int64) for c in columns[:4])
        met_by, found = [set(x) for x in columns[5]], []
        for i, at, extra in like_pairs(sizes, roots, sides, columns[4], threshold):
            here = [k for k, j in enumerate(at.tolist()) if min(met_by[i] & met_by[j]) == leader]
            found.append((np.full(len(here), keys[i]), keys[at[here]], extra[here]))
        parts = [np.concatenate(p) for p in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(p, pa.int64()) for p in parts], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, [[] for _ in range(6)]
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            columns = [batch.column(i).to_pylist() for i in range(3, 9)]
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for i, j in zip(starts, [*starts[1:], len(keys)], strict=True):
                if keys[i] != now:
                    if len(held[0]) > 1:
                        yield pairs(now[0], held)
                    now, held = keys[i], [[] for _ in range(6)]
                for column, values in zip(held, columns, strict=True):
                    column.extend(values[i:j])
        if len(held[0]) > 1:
            yield pairs(now[0], held)

    made = dealt.mapInArrow(run, "a bigint, b bigint, extra bigint")
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    # pairs with a leader are decided already
    judged = met.select(*pair)
    open_ = stored(made.select(*pair, "extra").join(judged, ["a", "b"], "left_anti"), "open")
    discard(rows, bags)
    return open_


def _closed(met: DataFrame, texts: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """Roots after every open pair is decided: the nearest one of two components first, then those that this leaves open."""
    open_ = _open_pairs(met, texts, roots, threshold)

    def apart(pairs: DataFrame) -> DataFrame:
        known = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        rows = pairs.join(known("a"), "a", "left").join(known("b"), "b", "left")
        rows = rows.withColumns({f"root_{c}": F.coalesce(f"root_{c}", c) for c in ("a", "b")}).where("root_a != root_b")
        ends = [F.least("root_a", "root_b").alias("low"), F.greatest("root_a", "root_b").alias("high")]
        return rows.select("a", "b", "extra", *ends)

    nearest = apart(open_).groupBy("low", "high").agg(F.min(F.struct("extra", "a", "b")).alias("pair"))
    nearest = stored(nearest.select("pair.a", "pair.b"), "nearest")
    for last in (False, True):
        pairs = apart(open_).join(nearest, ["a", "b"], "left_anti") if last else nearest
        judged = stored(verify(pairs.select("a", "b", F.lit(False).alias("busy")), texts, threshold), "judged")
        links = judged.where("linked").select("a", "b")
        if links.take(1):
            roots = _merged(roots, links)
        discard(judged)
    discard(open_, nearest)
    return roots


def near_duplicate_links(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """docs (key, id_text, text) to components (node, root) of all texts that have a similar other text.

    Nodes are digests; a root is the number of one of its texts.
    """
    made = sketches(docs).dropDuplicates(["key"]).withColumn("number", F.monotonically_increasing_id())
    made = stored(made, "sketches")
    number = F.col("number")
    first = made.select(F.lit(0).cast("long").alias("part"), number.alias("key"), "n_words", number.alias("root"), "sketch")
    members = _buckets(first)
    # one row of each text that takes part; equal rows of one id are told apart only here
    some = members.select(F.col("key").alias("number")).distinct()
    numbers = stored(made.select("key", "number").join(some, "number", "left_semi"), "numbers")
    discard(made)
    spot = docs.groupBy("key").agg(F.min("id_text").alias("id_text")).join(numbers, "key")
    texts = docs.join(stored(spot, "spots").hint("merge"), ["key", "id_text"]).dropDuplicates(["key"])
    texts = stored(texts.select(F.col("number").alias("key"), "text"), "texts")
    roots = rests = met = None
    while True:
        led = stored(_led(members, threshold), "led")
        discard(members)
        if met is None:  # later groups are parts of these
            met = stored(led.where("busy").select("a", "b", "n_words"), "met")
        pairs = led.groupBy("a", "b").agg(F.max("busy").alias("busy"))
        judged = stored(verify(pairs, texts, threshold), "judged")
        roots = _merged(roots, judged.where("linked").select("a", "b"))
        failed = led.where("busy").join(judged.where("rest IS NOT NULL").select("a", "b", "rest"), ["a", "b"])
        if rests is not None:
            before = rests.select("part", F.col("key").alias("a"), F.col("rest").alias("left"))
            failed = failed.join(before, ["part", "a"]).withColumn("rest", F.array_intersect("left", "rest"))
        fresh = stored(_left_over(failed, roots), "rests")
        discard(led, judged, rests)
        rests = fresh
        members = _buckets(_sketched_again(rests), rests.select("part", "key", F.explode("scopes").alias("scope")))
        if not members.take(1):
            roots = _closed(met, texts, roots, threshold)
            discard(met)
            # a root is its own, too
            every = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
            return every.join(numbers, every["node"] == numbers["number"]).select(F.col("key").alias("node"), "root")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = SIMILARITY) -> DataFrame:
    """One row per input row: id, key, class_id (the least id in the class, null last), keeper (is this the class's document).

    A class is a component of similar texts with all their copies. A row without words is a class of its own. Rows equal
    in id and text are one document.
    """
    source = docs.select(
        digest(col(text)).alias("key"), _id_text(col(doc_id)).alias("id_text"), col(text).cast("string").alias("text")
    )
    roots = near_duplicate_links(source, threshold)
    has_words = F.coalesce(col(text).cast("string"), F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")
    rows = docs.select(digest(col(text)).alias("key"), col(doc_id).alias("id"), has_words.alias("has_words"))
    first = F.min(F.struct(F.col("id").isNull().alias("late"), F.col("id"), F.col("key"))).alias("best")
    texts = rows.where("has_words").groupBy("key").agg(first)
    texts = stored(texts.join(roots, F.col("key") == F.col("node"), "left").select("key", F.coalesce(F.col("root").cast("string"), F.hex("key")).alias("root"), "best"), "classes")
    best = texts.groupBy("root").agg(F.min("best").alias("chosen"))
    named = texts.join(stored(best, "chosen"), "root").select("key", "chosen")
    joined = rows.join(stored(named, "named"), "key", "left")
    chosen = F.col("chosen")
    keeper = (chosen["key"] == F.col("key")) & chosen["id"].eqNullSafe(F.col("id"))
    return joined.select(
        "id",
        "key",
        F.when(chosen.isNull(), F.col("id")).otherwise(chosen["id"]).alias("class_id"),
        F.when(chosen.isNull(), True).otherwise(keeper).alias("keeper"),
    )


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The pipeline's form: one row of each class stays, with the columns as they are."""
    kept = near_duplicates(docs, text, doc_id).where("keeper").select("key", _id_text(F.col("id")).alias("id_text"))
    kept = stored(kept.distinct(), "keepers")
    rows = nested(docs, key=digest(col(text)), id_text=_id_text(col(doc_id)), rank=F.xxhash64(F.to_json(F.struct(*map(col, docs.columns)))))
    one = Window.partitionBy("key", "id_text").orderBy("rank")
    wordless = F.coalesce(F.col("row").getField(text).cast("string"), F.lit("")).rlike(r"[^ \t\n\x0B\f\r]") == F.lit(False)
    first = rows.join(kept, ["key", "id_text"], "left_semi").withColumn("n", F.row_number().over(one))
    return unnested(first.where((F.col("n") == 1) | wordless), docs.columns)
