"""Recall of near-duplicate classes against brute force, and groups around one shared passage."""

import itertools
import random

import numpy as np
from corpusloom.llm import order_minhash
from pyspark.sql import functions as F

DOCS = "doc_id long, text string"


def edited(rng, words, share, kind):
    """A copy with that share of its words replaced, deleted or followed by new ones, at scattered places."""
    out = list(words)
    for at in sorted(rng.sample(range(len(words)), round(share * len(words))), reverse=True):
        new = [f"n{rng.randrange(10**9)}"]
        out[at : at + 1] = {"replace": new, "delete": [], "insert": [words[at], *new]}[kind]
    return out


def classes(spark, rows):
    return {r.id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}


def test_recall_over_the_grid_of_similarity_and_edits(spark):
    rng = random.Random(1)
    rows, pairs = [], {}
    for level, kind, _ in itertools.product((0.8, 0.83, 0.86, 0.9, 0.94, 0.98), ("replace", "delete", "insert"), range(12)):
        words = [f"w{rng.randrange(10**9)}" for _ in range(rng.randint(120, 400))]
        copy = edited(rng, words, (1 - level) * 0.98, kind)
        a, b = ([w.encode() for w in x] for x in (words, copy))
        i = len(rows)
        rows += [(i, " ".join(words)), (i + 1, " ".join(copy))]
        if order_minhash.similar(a, b):
            pairs.setdefault(level, []).append((i, i + 1))
    got = classes(spark, rows)
    found = {level: sum(got[a] == got[b] for a, b in some) / len(some) for level, some in pairs.items()}
    total = sum(got[a] == got[b] for some in pairs.values() for a, b in some) / sum(map(len, pairs.values()))
    assert total >= 0.9 and found[0.8] >= 0.65 and all(share == 1 for level, share in found.items() if level >= 0.9), found
    # no two texts of different pairs came together
    assert len(set(got.values())) >= len(rows) // 2


def test_texts_around_one_passage_meet_by_what_else_they_share(spark):
    """300 texts hold a passage of 300 words and are not similar by it. Forty of them are near copies in pairs."""
    rng = random.Random(2)
    new = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    passage = new(300)
    rows, pairs = [], []
    for i in range(0, 520, 2):
        own = passage + new(rng.randint(120, 200))
        rows.append((i, " ".join(own)))
        if i < 40:
            rows.append((i + 1, " ".join(passage + edited(rng, own[300:], 0.3, "replace"))))
            pairs.append((i, i + 1))
    got = classes(spark, rows)
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)
    assert all(got[i] == i for i, _ in rows if i % 2 == 0)


def test_a_rest_that_many_leaders_left_is_sketched_once(spark, monkeypatch):
    """Texts of many lengths hold one passage: each fails several leaders, and all of them leave it the same rest."""
    rng = random.Random(3)
    new = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    passage = new(100)
    rows = [(i, " ".join(passage + new(60 + i))) for i in range(0, 120, 2)]
    rows.append((1, " ".join(edited(rng, rows[0][1].split(), 0.05, "replace"))))
    seen, sketched = [], order_minhash._sketched_again
    monkeypatch.setattr(order_minhash, "_sketched_again", lambda rests: seen.append(rests.select("key", "rest").collect()) or sketched(rests))
    got = classes(spark, rows)
    assert got[1] == got[0] == 0 and len(set(got.values())) == len(rows) - 1
    assert seen[0]
    for part in seen:
        rests = [(r.key, frozenset(r.rest)) for r in part]
        assert len(set(rests)) == len(rests)


def around_a_passage(rng, pairs):
    """Texts of 310 common and 86 to 90 other words. Of some pairs the others have 22 single words in common, no run of five."""
    new = lambda n: [f"p{rng.randrange(10**9)}" for _ in range(n)]
    passage = new(310)
    texts = [passage + new(86) for _ in range(30)]
    for _ in range(pairs):
        own, other = new(90), new(90)
        kept = [w if i % 4 == 0 else o for i, (w, o) in enumerate(zip(own, other, strict=True))]
        texts += [passage + own, passage + kept]
    return texts


def test_pairs_alike_only_by_what_their_leader_holds_too(spark, monkeypatch):
    """Their words beyond the passage share no k-mer, so no sketch of a rest brings them together. Tiles of any size find them."""
    texts = around_a_passage(random.Random(4), 8)
    alike = [order_minhash.similar(*([w.encode() for w in texts[i]] for i in p)) for p in ((30, 31), (0, 30), (0, 1), (31, 32))]
    assert alike == [True, False, False, False]
    rows = [(i, " ".join(words)) for i, words in enumerate(texts)]
    want = {i: i if i < 30 else i - i % 2 for i in range(len(rows))}
    assert classes(spark, rows) == want
    monkeypatch.setattr(order_minhash, "TILE_TEXTS", 10)
    assert classes(spark, rows) == want


def test_a_text_like_one_that_its_leaders_settled(spark):
    """One text is like all leaders, another like that text only, and what the two share the leaders hold too."""
    rng = random.Random(5)
    new = lambda n: [f"q{rng.randrange(10**9)}" for _ in range(n)]
    passage, first = new(310), new(90)
    kept = lambda words, rest: [w if i % 4 == rest else n for i, (w, n) in enumerate(zip(words, new(90), strict=True))]
    leaders = [passage + kept(first, 0)[: 86 + i % 4] for i in range(30)]
    second = kept(first, 0)
    third = kept(second, 2)
    texts = [*leaders, passage + second, passage + third]
    alike = lambda i, j: order_minhash.similar(*([w.encode() for w in texts[k]] for k in (i, j)))
    assert all(alike(i, 30) and not alike(i, 31) for i in range(30)) and alike(30, 31)
    assert set(classes(spark, [(i, " ".join(words)) for i, words in enumerate(texts)]).values()) == {0}


def test_bound_of_a_tile_loses_no_pair():
    rng = random.Random(6)
    texts = [[f"r{rng.randrange(40)}" for _ in range(rng.randint(5, 40))] for _ in range(60)]
    texts += [edited(rng, t, 0.15, kind) for t in texts for kind in ("replace", "delete", "insert")] + [["x"] * 300, ["x"] * 330]
    texts = sorted((t for t in texts if t), key=len)
    hashed, bounds = order_minhash.hash_words([[w.encode() for w in t] for t in texts])
    bags = [hashed[i:j].astype("uint16").tobytes() for i, j in itertools.pairwise(bounds)]
    n = np.array([len(t) for t in texts])
    alike = {p for p in itertools.combinations(range(len(texts)), 2) if order_minhash.similar(*([w.encode() for w in texts[i]] for i in p))}
    whole = {(i, int(j)) for i, at, _ in order_minhash.like_pairs(n, np.arange(len(n)), n * 0, bags, 0.8) for j in at}
    assert alike and alike <= whole and len(whole) < len(n) ** 2 / 4
    sides, roots = np.arange(len(n)) % 2, np.arange(len(n)) // 7
    cut = {(i, int(j)) for i, at, _ in order_minhash.like_pairs(n, roots, sides, bags, 0.8) for j in at}
    assert cut == {(i, j) for i, j in whole if sides[i] != sides[j] and roots[i] != roots[j]}


def test_rows_with_map_columns_pass(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, text), (3, None)], DOCS).withColumn("tags", F.create_map(F.lit("a"), F.lit(1)))
    kept = order_minhash.drop_near_duplicates(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3] and kept.columns == docs.columns
