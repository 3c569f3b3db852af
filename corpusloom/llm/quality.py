"""Quality rules: base counts, then compression bands.

Repetitive text compresses too well and noise too badly. A document's zstandard ratio (compressed bytes by bytes) must lie
within the limits for its length, since short texts carry the frame and lack history. Text is then cut into fixed chunks,
each compressed alone: if more than a quarter of the full chunks lie outside the chunk limits, the document is rejected,
so that a long text cannot hide a bad part. What is left behind the last full chunk counts in the whole ratio only.

One pass inside the scan's tasks, no shuffle. Null and empty texts have no words and fail the base rule.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame

from corpusloom.llm.common import col, map_slices

LEVEL = 3
CHUNK = 4096
CHUNK_LIMITS = (0.33, 0.60)
BAD_SHARE = 0.25
# (bytes up to, least ratio, greatest ratio)
BANDS = [
    (128, 0.50, 2.00),
    (256, 0.42, 1.05),
    (512, 0.42, 0.88),
    (1024, 0.41, 0.78),
    (2048, 0.40, 0.70),
    (4096, 0.38, 0.64),
    (8192, 0.36, 0.60),
    (16384, 0.33, 0.57),
    (65536, 0.30, 0.55),
    (1 << 62, 0.25, 0.55),
]
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of the words
REPEAT_WINDOW = 8
SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
    "ratio double, n_chunks bigint, n_bad_chunks bigint, kept boolean"
)
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]

SPACES = b"\t\n\v\f\r "
NOT_SYMBOLS = bytes(set(range(256)) - set(SYMBOLS))
INNER_BYTES = bytes(range(0x80, 0xC0))  # second and later bytes of a character


def repeated_words(texts: list[list[bytes]], window: int = REPEAT_WINDOW) -> np.ndarray:
    """Per text: words inside any run of `window` words that occurs twice or more in that text.

    Runs are numbered exactly, by pairing the numbers of two halves; `window` is a power of two.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    total = int(sizes.sum())
    if total < window:
        return np.zeros(len(texts), dtype=np.int64)
    codes = pd.factorize(np.array([w for t in texts for w in t], dtype=object))[0].astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    step = 1
    while step < window:
        pairs = codes[:-step] * (codes.max() + 1) + codes[step:]
        codes = pd.factorize(pairs)[0]
        step *= 2
    inside = owner[: len(codes)] == owner[window - 1 :]
    starts = np.flatnonzero(inside)
    keys = pd.factorize(owner[starts] * (codes.max() + 1) + codes[starts])[0]
    again = starts[np.bincount(keys)[keys] > 1] if len(keys) else starts
    edges = np.zeros(total + 1, dtype=np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + window, -1)
    return np.bincount(owner[np.cumsum(edges[:-1]) > 0], minlength=len(texts))


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(" \t\v\f\r")]
    return len(lines) - len(set(lines))


def band_verdict(data: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """Ratio, full chunks, chunks outside the limits, and whether the text passes."""
    if not data:
        return 0.0, 0, 0, False
    ratio = len(compressor.compress(data)) / len(data)
    low, high = next((low, high) for top, low, high in BANDS if len(data) <= top)
    chunks = [data[i : i + CHUNK] for i in range(0, len(data) - CHUNK + 1, CHUNK)]
    parts = [len(compressor.compress(c)) / CHUNK for c in chunks]
    bad = sum(not CHUNK_LIMITS[0] <= r <= CHUNK_LIMITS[1] for r in parts)
    return ratio, len(chunks), bad, low <= ratio <= high and bad <= BAD_SHARE * len(chunks)


def quality(docs: DataFrame, text: str = "text", **keep: Column) -> DataFrame:
    """`keep` columns with the counts, the base rule, the bands' figures and `kept`, for every row."""
    source = docs.select(*[v.alias(k) for k, v in keep.items()], col(text).cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "text")

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        texts = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        words = [d.split() for d in data]
        n_words = np.array([len(w) for w in words], dtype=np.int64)
        chars = [len(d.translate(None, SPACES + INNER_BYTES)) for d in data]
        symbols = [len(d.translate(None, NOT_SYMBOLS)) for d in data]
        repeats = repeated_words(words)
        failed = (n_words < LEAST_WORDS) | (100 * repeats > MOST_REPEATED * n_words)
        verdicts = [band_verdict(d, compressor) for d in data]
        ratio, chunks, bad, passed = zip(*verdicts, strict=True)
        columns = [n_words, chars, symbols, [repeated_lines(t) for t in texts], repeats, failed, ratio, chunks, bad]
        columns.append(~failed & np.array(passed))
        return pa.RecordBatch.from_arrays(
            [*part.columns[:-1], *[pa.array(c) for c in columns]], names=[*part.schema.names[:-1], *NAMES]
        )

    return map_slices(source, work, f"{schema}, {SCHEMA}")
