"""Spelling variant grouping: words one edit apart, found by blocked Gram matrices of letter counts.

A word becomes a vector of letter counts. The product of a block of such vectors with itself gives all squared distances
in it: 1 for one inserted or deleted letter, 2 for one replaced. Pairs of the same or adjacent lengths with a distance of
at most 2 are then verified letter by letter.

A block holds words of two adjacent lengths m and m + 1 that share their first m // 2 letters, or their last m - m // 2:
one edit leaves one of these two halves as it is, so every pair one edit apart meets. A block of more than `TILE` words is
cut into tiles by a hash of the word, and each pair of tiles is a row group of its own, so no task holds a whole block.
Small blocks share one matrix.

A word's form is its most frequent neighbour (ties: least in code-point order), if that is at least `RATIO` times as
frequent. Forms are followed to their root; as the frequency grows by that factor at each step, there are few steps.

Null texts have no words; equal rows all count; a word without neighbours has no form and is its own root; without
words the result is empty. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import col, stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
# Rows of one side of a matrix, and rows below which small blocks share one.
TILE, SHARED = 1024, 256
# Distinct words a task counts before it hands them on.
HELD_WORDS = 200_000

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower_ascii(run: str) -> str:
    return run.lower() if run.isascii() else run.translate(_LOWER)


def word_counts(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", change: Callable[[str, str], str] | None = None
) -> DataFrame:
    """(word, n) over all texts: maximal runs of letters, A to Z lower-cased.

    `change(id, word)` may rewrite a word, given its document's id as text (null: empty).
    """
    source = docs.select(F.coalesce(col(doc_id).cast("string"), F.lit("")).alias("id"), col(text).cast("string").alias("text"))

    def rows(words: Counter) -> pa.RecordBatch:
        arrays = [pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for i, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lowered: Counter = Counter()
                for raw, n in Counter(RUN.findall(whole or "")).items():
                    lowered[lower_ascii(raw)] += n
                for word, n in lowered.items():
                    made = change(i, word) if change else word
                    held[made] += n
                if len(held) >= HELD_WORDS:
                    yield rows(held)
                    held.clear()
        if held:
            yield rows(held)

    counted = source.mapInArrow(run, "word string, n bigint")
    return counted.where("word != ''").groupBy("word").agg(F.sum("n").alias("n"))


def one_edit(a: str, b: str) -> bool:
    """Is b one inserted, deleted or replaced code point away from a?"""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def letter_counts(words: list[str]) -> np.ndarray:
    """One row per word; letters are numbered by the block itself, so any alphabet will do."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
    letters, column = np.unique(codes, return_inverse=True)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    cells = np.bincount(owner * len(letters) + column, minlength=len(words) * len(letters))
    return cells.reshape(len(words), len(letters)).astype(np.float32)


def close_pairs(words: list[str], block: np.ndarray, tile: np.ndarray, cross: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs one edit apart inside a block. In a block that `cross`es two tiles only pairs of both are taken."""
    x = letter_counts(words)
    length = np.array([len(w) for w in words])
    square = (x * x).sum(axis=1)
    near = square[:, None] + square[None, :] - 2 * (x @ x.T) <= 2.5
    near &= np.abs(length[:, None] - length[None, :]) <= 1
    near &= block[:, None] == block[None, :]
    near &= ~cross[:, None] | (tile[:, None] != tile[None, :])
    left, right = np.nonzero(np.triu(near, 1))
    return [(i, j) for i, j in zip(left.tolist(), right.tolist(), strict=True) if one_edit(words[i], words[j])]


def neighbours(words: DataFrame, least_length: int = LEAST_LENGTH, tile_words: int = TILE) -> DataFrame:
    """(a, b, n_a, n_b): every unordered pair of distinct words one edit apart, once, from a table (word, n).

    Words shorter than `least_length` are left out.
    """
    sized = words.where(F.length("word") >= least_length).withColumn("size", F.length("word"))
    family = F.explode(F.array(F.col("size"), F.col("size") - 1))
    member = sized.select("word", "n", "size", family.alias("m")).where(F.col("m") >= max(least_length, 1))
    half = F.floor(F.col("m") / 2).cast("int")
    first = F.concat(F.lit("<"), F.substring("word", F.lit(1), half))
    last = F.concat(F.lit(">"), F.expr("right(word, m - cast(floor(m / 2) AS int))"))
    member = member.select("word", "n", "m", F.explode(F.array(first, last)).alias("half"))
    # words of length m are in the family of m as its shorter ones, so a block of longer ones only has no pair to give
    sizes = member.groupBy("m", "half").agg(F.count("*").alias("held"), F.min(F.length("word")).alias("least"))
    sizes = sizes.where("held > 1 AND least = m").select("m", "half", F.ceil(F.col("held") / tile_words).alias("tiles"))
    placed = member.join(sizes, ["m", "half"]).withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    dealt = dealt.select(
        "m", "half", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "tile", "word", "n"
    )
    ordered = dealt.repartition("m", "half", "t1", "t2").sortWithinPartitions("m", "half", "t1", "t2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        blocks: list[int] = []
        current, nth = None, 0

        def settle() -> pa.RecordBatch:
            words_ = [r[5] for r in held]
            tile = np.array([r[4] for r in held])
            cross = np.array([r[2] != r[3] for r in held])
            found = []
            for i, j in close_pairs(words_, np.array(blocks), tile, cross):
                a, b = (i, j) if len(words_[i]) <= len(words_[j]) else (j, i)
                m, side = held[i][0], held[i][1][0]
                # pairs of two longer words belong to the next family; what shares both halves came by the first
                if len(words_[a]) != m or (side == ">" and words_[a][: m // 2] == words_[b][: m // 2]):
                    continue
                found.append((words_[a], words_[b], held[a][6], held[b][6]))
            arrays = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)] if found else empty
            return pa.RecordBatch.from_arrays(arrays, names=["a", "b", "n_a", "n_b"])

        types = [pa.string(), pa.string(), pa.int64(), pa.int64()]
        empty = [pa.array([], t) for t in types]
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:4] != current:
                    if len(held) >= SHARED:
                        yield settle()
                        held, blocks = [], []
                    current, nth = row[:4], nth + 1
                held.append(row)
                blocks.append(nth)
        if held:
            yield settle()

    return ordered.mapInArrow(run, "a string, b string, n_a bigint, n_b bigint")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to their end, twice as far in each round."""
    now = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while now.join(now.select(F.col("word").alias("root")), "root", "left_semi").take(1):
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        now = stored(now, "spelling-roots")
    return now


def variants(
    words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, tile_words: int = TILE
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words of a table (word, n) that are long and frequent enough."""
    kept = stored(words.where((F.length("word") >= least_length) & (F.col("n") >= least_count)), "spelling-words")
    pairs = stored(neighbours(kept, least_length, tile_words), "spelling-pairs")
    links = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))
    )
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near").alias("near")))
    near = links.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    strong = -F.col("best")["rank"] >= ratio * F.col("n")
    done = kept.join(near, "word", "left").select(
        "word",
        F.when(strong, F.col("best")["near"]).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, -F.col("best")["rank"]).alias("form_n"),
    )
    done = stored(done, "spelling-forms")
    followed = roots(done.where("form IS NOT NULL"))
    return done.join(followed, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def group_variants(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    change: Callable[[str, str], str] | None = None,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    ratio: int = RATIO,
) -> DataFrame:
    """Spelling variants of all words of the documents."""
    return variants(word_counts(docs, text, doc_id, change), least_length, least_count, ratio)
