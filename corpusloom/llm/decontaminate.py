"""Benchmark decontamination over a positional inverted index of the training text.

The index is partitioned by document: a task cuts its documents into segments of about a million words and writes, for
each segment, its documents and, per term, the ascending positions of the term in the segment. One unused position
parts two documents, so no phrase spans both. Terms that no benchmark item holds can take part in no match and are
left out. The index is a plain table; building and searching it move no text between tasks.

A search takes benchmark windows, looks up the lists of a window's terms, and intersects them shifted by the term's
offset, beginning with the rarest term of the segment. The benchmark comes to the tasks in blocks of bounded size
(`BLOCK_BYTES`), one search for each block, so its size is not bounded by a task's memory.

Words: A-Z lower-cased, then runs of digits, a-z and all characters outside ASCII. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import col, digest, nested, slices, stored, total, unnested

WINDOW = 10
SLOP = 3
SEGMENT_WORDS = 1_000_000
BLOCK_BYTES = 16_000_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

HIT = "number bigint, item string, positions array<int>"


def _byte_table() -> bytes:
    """A-Z to a-z; digits, a-z and bytes of characters outside ASCII stay; all else becomes a space."""
    keep = [i for i in range(256) if 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A or i >= 0x80]
    table = bytearray(b" " * 256)
    for i in keep:
        table[i] = i
    for i in range(0x41, 0x5B):
        table[i] = i + 32
    return bytes(table)


BYTES = _byte_table()


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(BYTES).split() if text else []


Block = list[tuple[str, list[bytes]]]


def benchmark_blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[Block]:
    """The benchmark as blocks of items with a word. Only one number per block and one block at a time reach the driver."""
    items = benchmark.select(
        F.coalesce(col(item_id).cast("string"), F.lit("")).alias("item"), col(text).cast("string").alias("text")
    ).where("text IS NOT NULL")
    size = total(benchmark.sparkSession, items, F.octet_length("text") + 64)
    count = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(count))
    for number in range(count):
        rows = items.where(block == number).collect()
        yield [(r["item"], w) for r in rows if (w := words_of(r["text"]))]


def _index_segment(counts: list[int], words: list[list[bytes]], wanted: dict[bytes, int]):
    """Starts of the documents, the terms found (as numbers) and the ascending positions of each."""
    sizes = np.array(counts, dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    codes = np.fromiter((wanted.get(w, -1) for part in words for w in part), dtype=np.int32, count=int(sizes.sum()))
    place = np.arange(len(codes)) + np.repeat(np.arange(len(sizes)), sizes)
    hits = codes >= 0
    codes, place = codes[hits], place[hits].astype(np.int32)
    order = np.argsort(codes, kind="stable")
    terms, first = np.unique(codes[order], return_index=True)
    return starts, terms, pa.ListArray.from_arrays(np.append(first, len(codes)).astype(np.int32), pa.array(place[order]))


def build_index(docs: DataFrame, terms: set[bytes], segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """docs (number, id, key, text) to segments; `terms` are the words worth keeping."""
    shared = docs.sparkSession.sparkContext.broadcast(sorted(terms))
    kind = docs.schema["id"].dataType.simpleString()
    schema = (
        f"docs array<struct<number:bigint,id:{kind},key:binary,start:int,n_words:int>>, "
        "terms array<string>, positions array<array<int>>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([t.decode("utf-8", "surrogatepass") for t in shared.value], pa.string())
        wanted = {t: i for i, t in enumerate(shared.value)}
        rows: list[pa.RecordBatch] = []
        words: list[list[bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            counts = [len(w) for w in words]
            starts, found, positions = _index_segment(counts, words, wanted)
            number, ids, key = (pa.concat_arrays([r.column(k) for r in rows]) for k in range(3))
            parts = [number, ids, key, pa.array(starts, pa.int32()), pa.array(counts, pa.int32())]
            docs = pa.StructArray.from_arrays(parts, names=["number", "id", "key", "start", "n_words"])
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            columns = [one(docs), one(names.take(pa.array(found, pa.int32()))), one(positions)]
            return pa.RecordBatch.from_arrays(columns, names=["docs", "terms", "positions"])

        for batch in batches:
            for part in slices(batch):
                rows.append(part.select(["number", "id", "key"]))
                words += map(words_of, part.column(3).to_pylist())
                size += sum(map(len, words[-part.num_rows :]))
                if size >= segment_words:
                    yield flush()
                    rows, words, size = [], [], 0
        if words:
            yield flush()

    return docs.select("number", "id", "key", "text").mapInArrow(run, schema)


def _intersect(lists: list[np.ndarray], slop: int) -> np.ndarray:
    """Starts p such that term k lies at p + k (+ up to `slop`), read from the rarest list on."""
    order = sorted(range(len(lists)), key=lambda k: len(lists[k]))
    rarest = order[0]
    starts = lists[rarest] - rarest
    for k in order[1:]:
        at = np.searchsorted(lists[k], starts + k - slop)
        near = lists[k][np.minimum(at, len(lists[k]) - 1)]
        starts = starts[np.abs(near - starts - k) <= slop]
        if not len(starts):
            break
    return starts


def _windows(block: list[tuple[str, list[bytes]]], window: int) -> dict[tuple[bytes, ...], list[str]]:
    """Each distinct window with the items that hold it."""
    found: dict[tuple[bytes, ...], list[str]] = {}
    for item, words in block:
        width = min(window, len(words))
        for spot in {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}:
            found.setdefault(spot, []).append(item)
    return found


def search_index(index: DataFrame, block: list[tuple[str, list[bytes]]], window: int = WINDOW, slop: int = 0) -> DataFrame:
    """(number, item, positions): for each document and item with a match, the positions of the document's matched words.

    With `slop` 0 a match is the exact phrase. Otherwise it is a proximity match: every term within `slop` words of its
    place after the rarest one, in the same document; positions are then those of the phrase from its first word.
    """
    shared = index.sparkSession.sparkContext.broadcast(_windows(block, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots = list(shared.value.items())
        vocabulary = {t: i for i, t in enumerate(sorted({t for spot, _ in spots for t in spot}))}
        matrix = np.full((len(spots), window), -1, dtype=np.int64)
        for i, (spot, _) in enumerate(spots):
            matrix[i, : len(spot)] = [vocabulary[t] for t in spot]
        for batch in batches:
            for row in range(batch.num_rows):
                docs = batch.column(0).slice(row, 1).flatten()
                start, n_words = (docs.field(k).to_numpy() for k in ("start", "n_words"))
                names = batch.column(1).slice(row, 1).flatten().to_pylist()
                nested_lists = batch.column(2).slice(row, 1).flatten()
                lists = {
                    code: k for k, n in enumerate(names) if (code := vocabulary.get(n.encode("utf-8", "surrogatepass"))) is not None
                }
                here = np.zeros(len(vocabulary) + 1, dtype=bool)
                here[-1] = True
                here[list(lists)] = True
                hits: dict[tuple[int, str], list[np.ndarray]] = {}
                for i in np.flatnonzero(here[matrix].all(axis=1)):
                    spot, items = spots[i]
                    postings = [nested_lists[lists[vocabulary[t]]].values.to_numpy() for t in spot]
                    found = _intersect(postings, slop)
                    if not len(found):
                        continue
                    owner = np.searchsorted(start, found, side="right") - 1
                    if slop:
                        inside = (owner >= 0) & (found + len(spot) <= start[owner] + n_words[owner])
                        found, owner = found[inside], owner[inside]
                    for d in np.unique(owner):
                        places = (found[owner == d][:, None] - start[d] + np.arange(len(spot))).ravel()
                        for item in items:
                            hits.setdefault((int(d), item), []).append(places)
                if hits:
                    ids = docs.field("number")
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[d].as_py() for d, _ in hits], pa.int64()),
                            pa.array([item for _, item in hits], pa.string()),
                            pa.array([np.unique(np.concatenate(p)).tolist() for p in hits.values()], pa.list_(pa.int32())),
                        ],
                        names=["number", "item", "positions"],
                    )

    return index.mapInArrow(run, HIT)


def match_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    slop: int = 0,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per input row: id, key (digest of the text), n_words, n_hit (words inside a match), items (ids, ascending).

    Items without a word match nothing; rows with one item id count as one item, a null id as the empty one. The index
    numbers the rows, so null and repeated ids need no care. An empty table gives an empty result.
    """
    source = docs.select(
        F.monotonically_increasing_id().alias("number"),
        col(doc_id).alias("id"),
        digest(col(text)).alias("key"),
        col(text).cast("string").alias("text"),
    )
    terms: set[bytes] = set()
    for block in benchmark_blocks(benchmark, item_id, item_text, block_bytes):
        terms.update(w for _, words in block for w in words)
    index = stored(build_index(source, terms), "index")
    found = None
    for block in benchmark_blocks(benchmark, item_id, item_text, block_bytes):
        part = search_index(index, block, window, slop)
        found = part if found is None else found.unionByName(part)
    per_document = found.groupBy("number").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("n_hit"),
        F.sort_array(F.collect_set("item")).alias("items"),
    )
    listed = index.select(F.inline("docs"))
    return listed.join(per_document, "number", "left").select(
        "id",
        "key",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The pipeline's form: rows whose text holds a benchmark window go; the columns stay as they are."""
    hit = match_benchmark(docs, benchmark, text, doc_id).where("n_hit > 0").select("key").distinct()
    kept = nested(docs, key=digest(col(text))).join(hit, "key", "left_anti")
    return unnested(kept, docs.columns)
