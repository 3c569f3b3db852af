"""Language identification by unigram pieces, summed over all segmentations.

A word (a run of letters, lower-cased, with the vocabulary's word mark in front) is a product of pieces of a fixed public
vocabulary. Each language has its own piece probabilities; a forward pass sums the probability of every way to cut a word
into pieces. Pieces never span words, so a text's likelihood is the product over its words, and a task computes each
distinct word of a batch once. Characters no piece covers cost the same in every language.

Training takes about `sample_docs` documents per language, chosen by a hash of their id (the bound is a parameter), and
re-estimates the probabilities `rounds` times by expected counts (forward and backward) over the sample's words in Spark.
The driver sees one row per language and piece, a size the vocabulary fixes. Only languages with a trained row can be
predicted. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import col, held_out, map_slices, stored, unnested

VOCABULARY = "piece_bpe_32k.model"
SAMPLE_DOCS = 2000
ROUNDS = 3
MAX_PIECE = 12
MAX_WORD = 40
FLOOR = 1e-9  # probability of a piece never seen in a language
STRANGE = 1e-12  # probability of a character outside the vocabulary
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
MARK = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=2)
def vocabulary(name: str = VOCABULARY) -> list[str]:
    """Lower-case pieces of letters, with or without the word mark, as the file orders them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_byte(i) and not model.is_control(i))
    usable = lambda p: p.removeprefix(MARK).isalpha() and p == p.lower() or p == MARK
    return [p for p in pieces if len(p) <= MAX_PIECE and usable(p)]


def _powers() -> np.ndarray:
    out = np.ones(MAX_PIECE + 1, dtype=np.uint64)
    out[1:] = np.cumprod(np.full(MAX_PIECE, BASE))
    return out


POWERS = _powers()


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


@lru_cache(maxsize=2)
def _table(name: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted polynomial hashes of the pieces and their numbers."""
    hashes = np.zeros(len(vocabulary(name)), dtype=np.uint64)
    for i, piece in enumerate(vocabulary(name)):
        value = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in piece:
                value = value * BASE + np.uint64(ord(c) + 1)
        hashes[i] = value
    order = np.argsort(hashes)
    return hashes[order], order


def lattice(words: list[str], name: str = VOCABULARY):
    """Words of one length: for each place and piece length, the piece number that ends there (or -1)."""
    hashes, numbers = _table(name)
    size = len(words[0])
    codes = _codes(words).reshape(len(words), size) + np.uint64(1)
    prefix = np.zeros((len(words), size + 1), dtype=np.uint64)
    for j in range(size):
        prefix[:, j + 1] = prefix[:, j] * BASE + codes[:, j]
    found = {}
    for end in range(1, size + 1):
        for width in range(1, min(end, MAX_PIECE) + 1):
            value = prefix[:, end] - prefix[:, end - width] * POWERS[width]
            at = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
            hit = hashes[at] == value
            if width == 1 or hit.any():
                found[end, width] = np.where(hit, numbers[at], -1)
    return found


def forward(words: list[str], table: np.ndarray, name: str = VOCABULARY) -> np.ndarray:
    """log P(word) per language: table is (pieces + 1) x languages, its last row for characters outside the vocabulary."""
    out = np.zeros((len(words), table.shape[1]))
    for rows, group in by_length(words):
        found = lattice(group, name)
        alpha = [np.ones((len(group), table.shape[1]))]
        for end in range(1, len(group[0]) + 1):
            mass = np.zeros_like(alpha[0])
            for width in range(1, min(end, MAX_PIECE) + 1):
                piece = found.get((end, width))
                if piece is None:
                    continue
                here = table[piece] if width == 1 else np.where((piece >= 0)[:, None], table[piece], 0)
                mass += alpha[end - width] * here
            alpha.append(mass)
        out[rows] = np.log(np.maximum(alpha[-1], 1e-300))
    return out


def by_length(words: list[str]):
    """Groups of equal length, at most some thousands of words each."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(sizes, kind="stable")
    for size in np.unique(sizes):
        rows = order[np.searchsorted(sizes[order], size) : np.searchsorted(sizes[order], size, side="right")]
        for i in range(0, len(rows), 8192):
            part = rows[i : i + 8192]
            yield part, [words[r] for r in part]


def expected_counts(words: list[str], weights: np.ndarray, table: np.ndarray, name: str = VOCABULARY) -> np.ndarray:
    """Expected number of uses of each piece over all segmentations, words weighted; one language."""
    total = np.zeros(len(table))
    for rows, group in by_length(words):
        found, size = lattice(group, name), len(group[0])
        p = {k: np.where((v >= 0) | (k[1] == 1), table[v], 0) for k, v in found.items()}
        alpha = np.zeros((size + 1, len(group)))
        beta = np.zeros((size + 1, len(group)))
        alpha[0] = beta[size] = 1
        for (end, width), here in p.items():
            alpha[end] += alpha[end - width] * here
        for (end, width), here in sorted(p.items(), reverse=True):
            beta[end - width] += beta[end] * here
        scale = weights[rows] / np.maximum(alpha[size], 1e-300)
        for (end, width), here in p.items():
            uses = alpha[end - width] * here * beta[end] * scale
            total += np.bincount(found[end, width] % len(table), weights=uses, minlength=len(table))
    return total


def words_of(text: str | None) -> list[str]:
    """Marked lower-case words; a run of letters over the limit is cut, so that its product stays in range."""
    found = LETTERS.findall(text.lower()) if text else []
    if not all(map(str.isalpha, found)):  # digits such as a raised two count as word characters
        found = [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]
    return [MARK + w if len(w) <= MAX_WORD else MARK + w[i : i + MAX_WORD] for w in found for i in range(0, len(w), MAX_WORD)]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (pieces + 1) x languages
    vocabulary: str = VOCABULARY


def _start(size: int) -> np.ndarray:
    """Before any data: pieces of equal probability."""
    return np.append(np.full(size, 1 / size), STRANGE)


def fit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    doc_id: str = "doc_id",
    sample_docs: int = SAMPLE_DOCS,
    rounds: int = ROUNDS,
    name: str = VOCABULARY,
) -> Model:
    """Learn from text and non-null language of documents that are not held out; no such document gives an empty model."""
    rows = docs.select(
        col(text).cast("string").alias("text"), col(lang).cast("string").alias("lang"), held_out(col(doc_id)).alias("out"),
        F.pmod(F.xxhash64(F.lit("sample"), col(doc_id)), F.lit(1_000_000)).alias("draw"),
    ).where("lang IS NOT NULL AND NOT out")
    # one row for each language that occurs
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    share = {r["lang"]: min(1_000_000, int(1_000_000 * sample_docs / r["count"]) + 1) for r in sizes}
    size = len(vocabulary(name))
    if not share:
        return Model([], np.zeros((size + 1, 0)), name)
    limit = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    sample = rows.where(F.col("draw") < F.try_element_at(limit, F.col("lang"))).where("text IS NOT NULL")

    def count_words(part: pa.RecordBatch) -> pa.RecordBatch:
        langs = part.column(1).to_pylist()
        found = [(g, w) for g, t in zip(langs, part.column(0).to_pylist(), strict=True) for w in words_of(t)]
        frame = pd.DataFrame(found, columns=["lang", "word"]).value_counts(sort=False).reset_index(name="n")
        return pa.RecordBatch.from_pandas(frame, preserve_index=False)

    counted = map_slices(sample.select("text", "lang"), count_words, "lang string, word string, n bigint")
    words = stored(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    languages = sorted(share)
    table = np.repeat(_start(size)[:, None], len(languages), axis=1)
    for _ in range(rounds):
        table = _reestimate(words, Model(languages, table, name))
    return Model(languages, table, name)


def _reestimate(words: DataFrame, model: Model) -> np.ndarray:
    shared = words.sparkSession.sparkContext.broadcast(model)

    def expect(batches):
        now: Model = shared.value
        sums = np.zeros(now.table.shape)
        for batch in batches:
            frame = batch.to_pandas()
            for lang, part in frame.groupby("lang"):
                k = now.languages.index(lang)
                sums[:, k] += expected_counts(part["word"].tolist(), part["n"].to_numpy(float), now.table[:, k], now.vocabulary)
        piece, lang = np.nonzero(sums[:-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.int32()), pa.array(piece, pa.int32()), pa.array(sums[piece, lang])], names=["lang", "piece", "n"]
        )

    summed = words.mapInArrow(expect, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    frame = summed.toPandas()  # at most languages x pieces rows
    table = np.zeros(model.table.shape)
    table[frame["piece"], frame["lang"]] = frame["n"]
    table = table / np.maximum(table[:-1].sum(axis=0), 1e-300)
    table = np.maximum(table, FLOOR)
    table[-1] = STRANGE
    return table


def identify(docs: DataFrame, model: Model, text: str = "text", **keep: Column) -> DataFrame:
    """`keep` columns with lang_pred, score and n_words, for every row.

    Null texts and texts without a letter are `und` with score 0, as is every text under an empty model. Ties go to the
    language first in the alphabet. The score is the winner's share, with the log likelihoods scaled by the root of the
    number of words, because words of one text do not vote independently.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*[v.alias(k) for k, v in keep.items()], col(text).cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "text")

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        now: Model = shared.value
        texts = [words_of(t) for t in part.column(part.num_columns - 1).to_pylist()]
        counts = np.array([len(t) for t in texts])
        flat = np.array([w for t in texts for w in t], dtype=object)
        sums = np.zeros((len(texts), max(1, len(now.languages))))
        if len(flat) and now.languages:
            codes, uniques = pd.factorize(flat)
            values = forward(uniques.tolist(), now.table, now.vocabulary)[codes]
            owner = np.repeat(np.arange(len(texts)), counts)
            for k in range(values.shape[1]):
                sums[:, k] = np.bincount(owner, weights=values[:, k], minlength=len(texts))
        scaled = sums / np.sqrt(np.maximum(counts, 1))[:, None]
        share = np.exp(scaled - scaled.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        best = sums.argmax(axis=1)
        known = (counts > 0) & bool(now.languages)
        names = [now.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                *part.columns[:-1],
                pa.array(names, pa.string()),
                pa.array(np.where(known, share[np.arange(len(best)), best], 0.0)),
                pa.array(counts, pa.int64()),
            ],
            names=[*part.schema.names[:-1], "lang_pred", "score", "n_words"],
        )

    return map_slices(source, work, f"{schema}, lang_pred string, score double, n_words bigint")


def drop_unidentified(
    docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", least_score: float = 0.5
) -> DataFrame:
    """The pipeline's form: rows without a letter, or whose language stays in doubt, go; the columns stay as they are."""
    done = identify(docs, fit(docs, text, lang, doc_id), text, row=F.struct(*[col(c) for c in docs.columns]))
    return unnested(done.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)), docs.columns)
