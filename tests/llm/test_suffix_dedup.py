"""Exact substring dedup against a plain statement of its rule."""

import random
from collections import Counter

import numpy as np
import pytest
from corpusloom.llm import suffix_dedup
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, k1 string, row string"


def plain(texts, least):
    """(spans, kept) per text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + least] for d in data for i in range(len(d) - least + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - least + 1):
            if seen[d[i : i + least]] > 1:
                gone[i : i + least] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone])))
        spans = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
        out.append((spans, bytes(b for b, g in zip(d, gone) if not g)))
    return out


def check(spark, texts, least, **settings):
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], DOCS)
    done = suffix_dedup.remove_repeats(docs, least=least, **settings)
    got = {r["row"]["doc_id"]: ([tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in done.collect()}
    want = dict(enumerate(plain(texts, least)))
    assert got == want
    return want


def words(rng, n):
    return " ".join("".join(rng.choice("abcdéf") for _ in range(rng.randint(2, 8))) for _ in range(n))


def corpus(seed, n=60):
    """Copies, near copies, shared passages inside one and across texts, and texts of their own."""
    rng = random.Random(seed)
    base = [words(rng, rng.randint(5, 60)) for _ in range(n)]
    passage = words(rng, 30)
    texts = base[:]
    for t in base[: n // 2]:
        cut = rng.randrange(len(t))
        texts.append(rng.choice([t, t[:cut] + "#" + t[cut + 1 :], t[:cut] + t[cut + 2 :], words(rng, 9) + t[cut:] + words(rng, 9)]))
    texts += [words(rng, 6) + passage + words(rng, 6) for _ in range(12)]
    texts += [base[0] + "--" + base[0], "a" * 300, "ab" * 200, None, "", None]
    return texts


@pytest.mark.parametrize("least", [24, 41, 100])
@pytest.mark.parametrize("hot", [1024, 2])
def test_equals_brute_force(spark, least, hot):
    want = check(spark, corpus(least), least, hot=hot, block=2000)
    assert any(spans for spans, _ in want.values()) and any(not spans for spans, _ in want.values())


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 97)
    rng = random.Random(1)
    long = words(rng, 3000)
    data = [np.frombuffer(t.encode(), np.uint8) for t in (long, words(rng, 5) + long[2000:9000])]
    # the same contexts, whatever the pieces: every start lies in exactly one
    import pyarrow as pa

    part = pa.RecordBatch.from_arrays(
        [pa.array([1, 2], pa.int64()), pa.array([1, 2], pa.int64()), pa.array([d.tobytes() for d in data], pa.binary())],
        names=["k1", "k2", "text"],
    )
    made = suffix_dedup._contexts_of(part, 60).to_pydict()
    for key, d in ((1, data[0]), (2, data[1])):
        spans = sorted((a, b) for k, a, b in zip(made["k1"], made["low"], made["high"]) if k == key)
        assert [a for a, _ in spans] == [0, *(b + 1 for _, b in spans[:-1])] and spans[-1][1] == len(d) - 60
    check(spark, [long, words(rng, 5) + long[2000:9000]], 60)


def test_production_length(spark):
    rng = random.Random(2)
    passage = words(rng, 200)
    texts = [words(rng, 50) + passage[:399], passage[:399] + words(rng, 50), words(rng, 20) + passage[300:900] + "!", passage[290:700]]
    texts += ["x" * 5000, words(rng, 3000)]
    check(spark, texts, 400)


def test_hot_group_of_copies_and_edges(spark):
    """Many texts share a passage, each in surroundings of its own: its edges make one bucket of distinct contexts."""
    rng = random.Random(3)
    passage = words(rng, 40)
    texts = [words(rng, 8) + passage + words(rng, 8) for _ in range(120)] + [passage] * 30
    check(spark, texts, 64, hot=8, block=1500)


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []


def test_digests(spark):
    docs = spark.createDataFrame([(1, "é" * 300, "", ""), (2, None, "", "")], DOCS)
    got = {r["doc_id"]: r for r in suffix_dedup.digest_columns(suffix_dedup.remove_repeats(docs)).collect()}
    assert (got[1]["n_bytes"], got[1]["n_removed"], got[1]["n_spans"]) == (600, 600, 1)
    empty = spark.range(1).select(F.sha2(F.lit(b""), 256)).first()[0]
    assert got[1]["kept_sha256"] == got[2]["kept_sha256"] == empty


@pytest.mark.parametrize("prime", [2, 3, 5, 7])
def test_difference_cover(prime):
    v, cover = suffix_dedup.difference_cover(prime)
    assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_sorted_order_of_a_block():
    """Classes and order equal those of plainly sorted strings, also where ties are long."""
    rng = random.Random(4)
    unit = bytes(rng.randrange(97, 100) for _ in range(70))
    data = unit * 6 + bytes(rng.randrange(97, 99) for _ in range(300)) + unit * 3 + b"a" * 200
    start = np.arange(len(data) - 50)
    rng.shuffle(start)
    order, kind = suffix_dedup.repeat_classes(np.frombuffer(data, np.uint8), start, 50)
    strings = [data[i : i + 50] for i in start[order].tolist()]
    assert strings == sorted(strings)
    assert all((a == b) == (x == y) for a, b, x, y in zip(strings, strings[1:], kind, kind[1:]))
