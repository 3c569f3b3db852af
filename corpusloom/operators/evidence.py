"""Does quoted evidence occur in its document? Referenced chunk, any chunk, then a similar stretch of any chunk.

References are first reduced to distinct (document, chunk, normalised evidence) keys, so copies cost nothing. Evidence is
looked for in all chunks of its document by fingerprints: a text's fingerprints are the least hashes of every `WINDOW`
consecutive runs of `GRAM` characters, so a text that holds another one of `MEET` characters or more holds all its
fingerprints. An evidence whose fingerprints are not all known in the document is nowhere; any other one is compared with
one chunk that holds its rarest fingerprint, and only if that fails with the others.

Shorter evidence, all evidence of a document with at most `FEW`, and the similarity step meet every chunk of the document:
hashing a chunk costs more than looking for that many texts in it. There evidence travels in batches: a chunk row
meets one batch row, not one row per evidence, and large documents are cut into blocks of chunks and several batches, so
that no document is one task's work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import normalize_ws
from corpusloom.model import SIMILARITY_THRESHOLD

BATCH = 64
CHUNK_BLOCK = 256
COUNT_CELLS = 4_000_000
# Four batches: a chunk's text meets at most so many rows where fingerprints are spared.
FEW = 4 * BATCH
# WINDOW is a power of two. A chunk's text is cut into pieces of about PIECE characters before it is hashed.
GRAM, WINDOW, PIECE = 8, 32, 512
MEET = GRAM + WINDOW - 1

KEY = ["document_id", "chunk_id", "evidence"]


def evidence_keys(refs: DataFrame) -> DataFrame:
    """Distinct non-empty (document, chunk, normalised evidence); empty evidence is never verified."""
    return (
        refs.select("document_id", "chunk_id", normalize_ws("evidence").alias("evidence"))
        .where(F.col("evidence") != "")
        .distinct()
    )


def match_referenced_chunk(keys: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add `in_own`: the evidence is a substring of the chunk it names (chunk ids are unique in a document)."""
    texts = chunks.select("document_id", "chunk_id", normalize_ws("text").alias("_text"))
    return (
        keys.join(texts, ["document_id", "chunk_id"], "left")
        .withColumn("in_own", F.coalesce(F.contains("_text", "evidence"), F.lit(False)))
        .drop("_text")
    )


def evidence_batches(keys: DataFrame, chunks: DataFrame, batch: int, block: int) -> DataFrame:
    """Distinct evidence texts per document in batches of about `batch`, one copy per block of the document's chunks."""
    texts = keys.select("document_id", "evidence").distinct()
    spread = texts.withColumn("_salt", F.pmod(F.xxhash64("evidence"), F.lit(64)).cast("int"))
    sizes = texts.groupBy("document_id").agg(F.ceil(F.count("*") / batch).cast("int").alias("_batches"))
    # Only documents with more than one batch need their batch count; the copies per salt keep them off a single task.
    large = sizes.where(F.col("_batches") > 1).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
    grouped = (
        spread.join(large, ["document_id", "_salt"], "left")
        .withColumn("_batch", F.pmod(F.xxhash64("evidence", F.lit(1)), F.coalesce("_batches", F.lit(1))))
        .groupBy("document_id", "_batch")
        .agg(F.collect_list("evidence").alias("evidences"))
        .drop("_batch")
    )
    blocks = chunks.groupBy("document_id").agg(F.max(_block(block)).alias("_last"))
    return grouped.join(blocks, "document_id").select(
        "document_id", "evidences", F.explode(F.sequence(F.lit(0), "_last")).alias("_block")
    )


def _block(block: int) -> Column:
    return F.floor(F.col("order") / block).cast("int")


def _chunk_batches(keys: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per (chunk, batch of evidences of its document)."""
    texts = chunks.select("document_id", _block(CHUNK_BLOCK).alias("_block"), normalize_ws("text").alias("_text"))
    return texts.join(evidence_batches(keys, chunks, BATCH, CHUNK_BLOCK), ["document_id", "_block"])


def _flag(keys: DataFrame, found: DataFrame, name: str) -> DataFrame:
    hits = found.distinct().withColumn("_hit", F.lit(True))
    return (
        keys.join(hits, ["document_id", "evidence"], "left")
        .withColumn(name, F.coalesce("_hit", F.lit(False)))
        .drop("_hit")
    )


def with_fingerprints(texts: DataFrame, text: str) -> DataFrame:
    """Add `fingerprints`: the distinct least hashes of all windows of a text of at least `MEET` characters."""
    grams = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    out = texts.withColumn("_hashes", F.transform(grams, lambda i: F.xxhash64(F.substring(F.col(text), i, GRAM))))
    span = 1
    while span < WINDOW:
        reach = span
        least = F.transform("_hashes", lambda h, i: F.least(h, F.get("_hashes", i + reach)))  # noqa: B023
        out, span = out.withColumn("_hashes", least), span * 2
    whole = F.slice("_hashes", 1, F.length(text) - (MEET - 1))
    return out.withColumn("fingerprints", F.array_distinct(whole)).drop("_hashes")


def _each_fingerprint() -> Column:
    """One row each; there always is one. A plain `explode` would have its array tested for emptiness further down in the
    plan, where the steps above are written out within each other, each twice."""
    return F.explode_outer("fingerprints").alias("fingerprint")


def chunk_fingerprints(chunks: DataFrame) -> DataFrame:
    """(document_id, chunk_id, fingerprint) of all chunks, from overlapping pieces of their normalised texts."""
    texts = chunks.select("document_id", "chunk_id", normalize_ws("text").alias("_text")).where(F.length("_text") >= MEET)
    last = F.floor((F.length("_text") - MEET) / PIECE).cast("int")
    piece = F.transform(F.sequence(F.lit(0), last), lambda p: F.substring(F.col("_text"), p * PIECE + 1, PIECE + MEET - 1))
    pieces = texts.select("document_id", "chunk_id", F.explode(piece).alias("_piece"))
    return with_fingerprints(pieces, "_piece").select(
        "document_id", "chunk_id", _each_fingerprint()
    )


def _holding(places: DataFrame, chunks: DataFrame) -> DataFrame:
    """`places(document_id, chunk_id, evidence)` with `held`: is the evidence in that chunk?"""
    texts = chunks.select("document_id", "chunk_id", normalize_ws("text").alias("_text"))
    return places.join(texts, ["document_id", "chunk_id"]).withColumn("held", F.contains("_text", "evidence")).drop("_text")


def find_by_fingerprint(
    texts: DataFrame, chunks: DataFrame, settle: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Those of `texts(document_id, evidence)`, distinct and of at least `MEET` characters, that some chunk holds."""
    stored = (lambda df: df) if settle is None else settle
    mark = ["document_id", "fingerprint"]
    asked = with_fingerprints(texts, "evidence").select(
        "document_id", "evidence", _each_fingerprint()
    )
    marks = chunk_fingerprints(chunks).join(asked.select(*mark).distinct(), mark, "left_semi")
    marks = stored(marks.distinct())
    known = marks.groupBy(*mark).agg(F.count("*").alias("_chunks"), F.min("chunk_id").alias("chunk_id"))
    rarest = F.min(F.when(F.col("_chunks").isNotNull(), F.struct("_chunks", "fingerprint", "chunk_id"))).alias("_r")
    found = (
        asked.join(known, mark, "left")
        .groupBy("document_id", "evidence")
        .agg(F.count("*").alias("_asked"), F.count("_chunks").alias("_known"), rarest)
        .where("_asked = _known")
        .select("document_id", "evidence", "_r.*")
    )
    tried = stored(_holding(found, chunks))
    # the fingerprint is in another chunk too: its first chunk alone does not decide
    open_ = tried.where("NOT held AND _chunks > 1").select(*mark, "evidence", F.col("chunk_id").alias("_tried"))
    others = open_.join(marks, mark).where("chunk_id != _tried").select("document_id", "chunk_id", "evidence")
    hits = tried.where("held").select("document_id", "evidence")
    return hits.unionByName(_holding(others, chunks).where("held").select("document_id", "evidence"))


def match_any_chunk(
    keys: DataFrame,
    chunks: DataFrame,
    unless: Column | None = None,
    settle: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Add `in_any`: the evidence is a substring of some chunk of the document. Rows where `unless` holds are not looked up."""
    open_keys = keys if unless is None else keys.where(~unless)
    texts = open_keys.select("document_id", "evidence").distinct()
    stored = (lambda df: df) if settle is None else settle
    sizes = texts.groupBy("document_id").agg(F.count("*").alias("_texts"))
    # mostly small, so that chunks of other documents go without being hashed or shuffled
    many = stored(sizes.where(F.col("_texts") > FEW).select("document_id", F.lit(True).alias("_many")))
    marked = texts.join(many, "document_id", "left")
    hashed = F.coalesce("_many", F.lit(False)) & (F.length("evidence") >= MEET)
    met = _chunk_batches(marked.where(~hashed).drop("_many"), chunks).select(
        "document_id",
        F.explode(F.filter("evidences", lambda e: F.contains("_text", e))).alias("evidence"),
    )
    long = find_by_fingerprint(
        marked.where(hashed).drop("_many"), chunks.join(many, "document_id", "left_semi"), settle
    )
    return _flag(keys, met.unionByName(long), "in_any")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class _Quote:
    """One evidence text prepared for comparison with many windows."""

    def __init__(self, text: str, threshold: float) -> None:
        self.text, self.size, self.threshold = text, len(text), threshold
        self.step = max(1, self.size // 4)
        self.symbols, self.counts = np.unique(_codes(text), return_counts=True)
        self.matcher = SequenceMatcher(None, text, "")
        self.places: dict[str, int] = {}
        for i, c in enumerate(text):
            self.places[c] = self.places.get(c, 0) | (1 << i)

    def shapes(self, length: int) -> list[tuple[int, int]]:
        """(window width, end of the start positions) for a text longer than the evidence."""
        wider = self.size + self.step
        return [(self.size, length - self.size + 1), (min(wider, length), max(1, length - wider))]

    def reaches(self, common: int | np.ndarray, width: int) -> bool | np.ndarray:
        return 2.0 * common / (self.size + width) >= self.threshold

    def common_subsequence(self, window: str) -> int:
        """Length of the longest common subsequence, one bit per evidence character."""
        full = (1 << self.size) - 1
        free = full
        for c in window:
            hit = free & self.places.get(c, 0)
            if hit:
                free = ((free + hit) | (free - hit)) & full
        return self.size - free.bit_count()

    def close(self, window: str) -> bool:
        # Matching blocks are in order, so together they are a common subsequence: a cheap, safe upper bound of the ratio.
        if not self.reaches(self.common_subsequence(window), len(window)):
            return False
        self.matcher.set_seq2(window)
        return self.matcher.ratio() >= self.threshold


def find_similar(text: str, evidences: list[str], threshold: float = SIMILARITY_THRESHOLD) -> list[str]:
    """Which evidences have a similar stretch in `text`?

    A text no longer than the evidence is compared whole. Otherwise windows of the evidence's length, then windows a
    quarter longer, are tried every quarter length; similarity is the standard library's sequence ratio. Characters shared
    as a multiset bound the ratio for all windows at once, from running symbol counts of a slice of the text.
    """
    m = len(text)
    if m == 0:
        return []
    quotes = [_Quote(e, threshold) for e in evidences if e]
    found = {q.text for q in quotes if m <= q.size and q.reaches(m, m) and q.close(text)}
    quotes = [q for q in quotes if m > q.size]
    if not quotes:
        return list(found)
    codes = _codes(text)
    widest = max(q.size + q.step for q in quotes)
    reach = max(widest, COUNT_CELLS // len(np.unique(codes)))
    for lo in range(0, m, reach):
        symbols, at = np.unique(codes[lo : lo + reach + widest], return_inverse=True)
        running = np.zeros((len(at) + 1, len(symbols)), dtype=np.int32)
        running[np.arange(1, len(at) + 1), at] = 1
        np.cumsum(running, axis=0, out=running)
        for q in quotes:
            if q.text in found:
                continue
            slot = np.searchsorted(symbols, q.symbols)
            slot[slot == len(symbols)] = 0
            known = symbols[slot] == q.symbols
            columns, wanted = slot[known], q.counts[known]
            for width, stop in q.shapes(m):
                starts = np.arange(-(-lo // q.step) * q.step, min(stop, lo + reach), q.step)
                begin = starts - lo
                inside = running[np.ix_(begin + width, columns)] - running[np.ix_(begin, columns)]
                shared = np.minimum(inside, wanted).sum(axis=1)
                if any(q.close(text[i : i + width]) for i in starts[q.reaches(shared, width)].tolist()):
                    found.add(q.text)
                    break
    return list(found)


def similar(evidence: str, text: str, threshold: float = SIMILARITY_THRESHOLD) -> bool:
    return bool(find_similar(text, [evidence], threshold))


def _similar_batches(threshold: float):
    @F.pandas_udf("array<string>")
    def matched(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, evidences in batches:
            yield pd.Series([find_similar(t, list(es), threshold) for t, es in zip(texts, evidences)])

    return matched


def match_fuzzy(
    keys: DataFrame, chunks: DataFrame, threshold: float = SIMILARITY_THRESHOLD, unless: Column | None = None
) -> DataFrame:
    """Add `is_similar`: a stretch of some chunk of the document is similar to the evidence."""
    open_keys = keys if unless is None else keys.where(~unless)
    # A fixed partition count: the work per row is CPU, so adaptive merging of small partitions would only serialise it.
    partitions = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Text and batch are both hashed, so that neither a much quoted document nor a long one gathers in one partition.
    pairs = _chunk_batches(open_keys, chunks).repartition(partitions, F.xxhash64("_text", "evidences"))
    found = pairs.select(
        "document_id", F.explode(_similar_batches(threshold)("_text", "evidences")).alias("evidence")
    )
    return _flag(keys, found, "is_similar")


def match_evidence(
    refs: DataFrame,
    chunks: DataFrame,
    threshold: float = SIMILARITY_THRESHOLD,
    fuzzy: bool = True,
    settle: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Key table with `match`: `referenced`, `elsewhere`, `similar` or `none`; each step looks at what is still open.

    `settle` (for instance `session.materialize`) may write the key table between the steps: each step reads it
    several times, and the costly similarity step then starts from a stored table.
    """
    stored = (lambda df: df) if settle is None else settle
    keys = stored(match_referenced_chunk(evidence_keys(refs), chunks))
    keys = stored(match_any_chunk(keys, chunks, unless=F.col("in_own"), settle=settle))
    match = F.when(F.col("in_own"), "referenced").when(F.col("in_any"), "elsewhere")
    if fuzzy:
        keys = match_fuzzy(keys, chunks, threshold, unless=F.col("in_own") | F.col("in_any"))
        match = match.when(F.col("is_similar"), "similar")
    return keys.select(*KEY, match.otherwise("none").alias("match"))


def verify_evidence(
    refs: DataFrame,
    chunks: DataFrame,
    threshold: float = SIMILARITY_THRESHOLD,
    fuzzy: bool = True,
    settle: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Add `evidence_verified` and `match` to any table of references.

    Needs columns document_id, chunk_id, evidence; serves elements, findings, suggestions and answers alike.
    """
    found = match_evidence(refs, chunks, threshold, fuzzy, settle).withColumnsRenamed(
        {"evidence": "_normal", "match": "_match"}
    )
    kept = [c for c in refs.columns if c not in ("evidence_verified", "match")]
    staged = refs.select(*kept, normalize_ws("evidence").alias("_normal"))
    match = F.coalesce("_match", F.lit("none"))
    return staged.join(found, ["document_id", "chunk_id", "_normal"], "left").select(
        *kept, (match != "none").alias("evidence_verified"), match.alias("match")
    )


def verify_elements(
    elements: DataFrame,
    chunks: DataFrame,
    threshold: float = SIMILARITY_THRESHOLD,
    fuzzy: bool = True,
    settle: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Elements with `verified` set from their source reference."""
    flat = elements.drop("verified").select("*", "source_ref.chunk_id", "source_ref.evidence")
    checked = verify_evidence(flat, chunks, threshold, fuzzy, settle)
    return checked.withColumn("verified", F.col("evidence_verified")).select(*elements.columns)


def verification_summary(documents: DataFrame, elements: DataFrame) -> DataFrame:
    """Verified and total elements and their rate per document; 0.0 without elements."""
    counts = elements.groupBy("document_id").agg(
        F.count_if("verified").alias("verified_count"), F.count("*").alias("total_count")
    )
    rows = documents.select("document_id").join(counts, "document_id", "left").na.fill(0)
    rate = F.when(F.col("total_count") > 0, F.col("verified_count") / F.col("total_count")).otherwise(0.0)
    return rows.withColumn("verification_rate", rate)


def unverified_elements(elements: DataFrame) -> DataFrame:
    return elements.where(~F.col("verified")).select("document_id", "pos", "id")


def all_evidence_unverified(owners: DataFrame, refs: DataFrame, keys: list[str]) -> DataFrame:
    """Add the flag: at least one reference, and none of them verified."""
    seen = refs.groupBy(*keys).agg(F.bool_or("evidence_verified").alias("_any"))
    return (
        owners.drop("all_evidence_unverified")
        .join(seen, keys, "left")
        .withColumn("all_evidence_unverified", F.coalesce(~F.col("_any"), F.lit(False)))
        .drop("_any")
    )
