"""Corpus-wide operators against brute force on the smallest tables, and on awkward rows."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import compare
import corpus_pipeline
from corpusloom.llm import components, decontaminate, line_dedup, order_minhash, queries, substring_dedup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, key string, spans string, id string"


def frame(spark, rows):
    """(doc_id, text) with columns named as the operators name theirs."""
    return spark.createDataFrame([(i, t, "en", None, 1, "r", "k", "s", "i") for i, t in rows], SCHEMA)


BODY = " ".join(f"word{i}" for i in range(80))
LINES = "one line\ntwo lines\n\nthree lines\nfour"
AWKWARD = [
    (None, None),
    (1, None),
    (2, ""),
    (3, " \n "),
    (4, LINES),
    (4, LINES),
    (None, LINES),
    (5, "x " * 20000),
    (6, BODY),
    (7, BODY + " more"),
    (7, BODY + " other"),
    (8, "short text"),
]


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r.doc_id: r.text for r in queries.table(spark, sf_dir, "documents").collect()}


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql_twin(spark, sf_dir, name):
    df, cur = queries.QUERIES[name](spark, sf_dir), compare.connect(sf_dir).execute(queries.ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert compare.rows_of(df.columns, [tuple(r) for r in df.collect()]) == compare.rows_of(columns, cur.fetchall())


def test_line_dedup_awkward(spark):
    rows = line_dedup.line_dedup(frame(spark, AWKWARD)).collect()
    kept = collections.defaultdict(list)
    for r in rows:
        kept[r.row.doc_id].append((r.text, r.n_lines, r.n_removed))
    assert len(rows) == len(AWKWARD)
    assert kept[4] == [(LINES, 5, 0)] * 2  # equal rows are one document
    assert sorted(kept[None], key=str) == [("", 5, 5), (None, 0, 0)]  # null ids come last
    assert kept[2] == [("", 1, 0)] and kept[1] == [(None, 0, 0)]


def test_line_dedup_merges_and_keeps_its_own_first(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\n\nc\nd\ny"), (3, "z\nz\nz\nz\nz")]
    got = {r.row.doc_id: r.text for r in line_dedup.line_dedup(frame(spark, rows)).collect()}
    assert got == {1: "a\nb\nc\nd", 2: "x\ny", 3: "z\nz\nz"}


def shingles(text):
    words = order_minhash.words_of(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates_find_all_similar_pairs(spark, sf_dir, documents):
    rows = queries.op4_order_minhash(spark, sf_dir).collect()
    classes = {r.doc_id: r.class_id for r in rows}
    assert len(rows) == len(documents)
    sets = {d: shingles(t) for d, t in documents.items()}
    holders = collections.defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    common = collections.Counter((a, b) for v in holders.values() for a in v for b in v if a < b)
    pairs = [p for p, n in common.items() if n / (len(sets[p[0]]) + len(sets[p[1]]) - n) >= 0.8]
    assert pairs and all(classes[a] == classes[b] for a, b in pairs)
    apart = [(d, c) for d, c in classes.items() if d != c and not sets[d] & sets[c]]
    assert not apart
    assert sum(r.keeper for r in rows) == len(set(classes.values()))


def test_near_duplicates_awkward(spark):
    rows = order_minhash.near_duplicates(frame(spark, AWKWARD)).collect()
    assert len(rows) == len(AWKWARD)
    classes = collections.defaultdict(set)
    for r in rows:
        classes[r.id].add(r.class_id)
    assert classes[6] == classes[7] == {6} and classes[4] == {4} and classes[1] == {1} and classes[8] == {8}
    kept = order_minhash.drop_near_duplicates(frame(spark, AWKWARD))
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert ids == {None: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 8: 1}
    assert order_minhash.near_duplicates(frame(spark, [])).count() == 0


def test_edit_bound_equals_plain_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
            row = now
        return row[-1]

    draw = random.Random(5)
    for _ in range(600):
        a = [b"%d" % draw.randrange(draw.choice([3, 20])) for _ in range(draw.randint(1, 40))]
        b = list(a)
        for _ in range(draw.randint(0, 10)):
            i = draw.randrange(len(b))
            b[i : i + draw.randint(0, 1)] = [b"%d" % draw.randrange(20)] * draw.randint(0, 1) or b[i : i + 1]
        limit = int(0.2 * max(len(a), len(b)) + 1e-9)
        assert order_minhash.similar(a, b) == (plain(a, b) <= limit)
        most = draw.randint(0, 12)
        codes = [np.array([int(w) for w in x], dtype=np.int64) for x in (a, b)]
        found = order_minhash.edits_within(*codes, most)
        assert found == (plain(a, b) if plain(a, b) <= most else None)


def test_hot_bucket_keeps_links_across_leaders(spark):
    """A chain of texts, each near the next only, stays one class."""
    words = [f"w{i}" for i in range(200)]
    rows = []
    for step in range(12):
        rows.append((step, " ".join(words)))
        words[step * 16 : step * 16 + 3] = [f"new{step}-{k}" for k in range(3)]
    got = {r.class_id for r in order_minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {0}


def test_hot_bucket_keeps_edited_pairs_behind_other_leaders(spark):
    """Pairs of 7 % changed words, in buckets led by longer texts that hold one of the pair and are linked with neither."""
    draw = random.Random(23)
    new = lambda n: [f"v{draw.randrange(10**9)}" for _ in range(n)]
    rows = []
    for i in range(0, 2000, 100):
        base = new(300)
        copy = list(base)
        for at in draw.sample(range(300), 21):
            copy[at : at + 1] = new(1)
        rows += [(i, " ".join(base)), (i + 1, " ".join(copy))]
        for k in range(8):
            longer = base + new(80)
            rows += [(i + 10 + 3 * k + v, " ".join(longer[:-1] + new(1))) for v in range(3)]
    got = {r.id: r.class_id for r in order_minhash.near_duplicates(frame(spark, rows)).collect()}
    sketch = lambda text: order_minhash.sketch(order_minhash.labelled(order_minhash.kmers(order_minhash.hash_words([order_minhash.words_of(text)])[0], 5)))
    texts = dict(rows)
    met = [i for i in range(0, 2000, 100) if (sketch(texts[i]) == sketch(texts[i + 1])).any()]
    assert len(met) > 15 and all(got[i + 1] == i for i in met)
    assert all(got[i + 10] == i + 10 for i in met)


def test_components(spark):
    draw = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(draw.randint(200, 300), draw.randint(200, 300)) for _ in range(60)]
    roots = {}
    find = lambda x: x if roots.setdefault(x, x) == x else find(roots[x])
    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            roots[high] = low
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    for node in got:
        assert got[node] == find(node)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert linked - set(got) == {find(x) for x in linked}


def test_decontamination_awkward(spark):
    items = [(None, " ".join(f"word{i}" for i in range(30))), (2, None), (3, "..."), (4, "Short TEXT"), (4, "short text")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    for block_bytes in (10, 10_000):
        rows = decontaminate.match_benchmark(frame(spark, AWKWARD), benchmark, block_bytes=block_bytes).collect()
        assert len(rows) == len(AWKWARD)
        hits = {(r.id, r.n_hit, tuple(r.items)) for r in rows if r.n_hit}
        assert hits == {(6, 30, ("",)), (7, 30, ("",)), (8, 2, ("4",))}
    assert decontaminate.match_benchmark(frame(spark, AWKWARD), benchmark.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.match_benchmark(frame(spark, []), benchmark).count() == 0


def test_proximity_match(spark):
    benchmark = spark.createDataFrame([(1, "red green blue")], "item_id bigint, text string")
    docs = frame(spark, [(1, "a red very green and blue b"), (2, "red green blue"), (3, "blue red x x x x x x green")])
    exact = {r.id for r in decontaminate.match_benchmark(docs, benchmark).where("n_hit > 0").collect()}
    near = {r.id for r in decontaminate.match_benchmark(docs, benchmark, slop=3).where("n_hit > 0").collect()}
    assert exact == {2} and near == {1, 2}


def test_substring_dedup_covers_exact_runs(spark, sf_dir, documents):
    words = {d: order_minhash.words_of(t) for d, t in documents.items()}
    first, due, got = {}, collections.defaultdict(set), collections.defaultdict(set)
    for d in sorted(words):
        runs = [(i, tuple(words[d][i : i + 60])) for i in range(len(words[d]) - 59)]
        for i, g in runs:
            if first.setdefault(g, d) != d:
                due[d].update(range(i, i + 60))
    for r in queries.op3_substring_dedup(spark, sf_dir).collect():
        assert r.end - r.start >= 50 and r.similarity >= 0.8 and r.source_id < r.doc_id
        got[r.doc_id].update(range(r.start, r.end))
    assert due and all(got[d] & places for d, places in due.items())
    assert sum(len(p & got[d]) for d, p in due.items()) >= 0.99 * sum(map(len, due.values()))


def test_substring_dedup_fuzzy_and_awkward(spark):
    changed = BODY.replace("word30 ", "else ").replace("word61 ", "")
    rows = substring_dedup.repeated_passages(frame(spark, [(20, "start " + changed + " end"), *AWKWARD])).collect()
    found = {(r.doc_id, r.source_id) for r in rows}
    assert (20, 6) in found or (20, 7) in found
    assert not any(r.doc_id in (1, 2, 3, 8) for r in rows)
    assert substring_dedup.repeated_passages(frame(spark, [])).count() == 0


def test_substring_dedup_finds_exact_copies_with_partial_earlier_holders(spark):
    """Earlier documents hold parts of each passage, so that its seeds point to several first holders."""
    draw = random.Random(11)
    new = lambda n: [f"v{draw.randrange(10**9)}" for _ in range(n)]
    rows = []
    for i in range(60):
        passage = new(50 + i % 4)
        parts = [passage[:26], passage[13:39], passage[24:]] if i % 2 else [passage[: 30 + i % 3]]
        texts = [new(20) + p + new(20) for p in parts] + [new(30) + passage + new(30) for _ in range(2)]
        rows += [(10 * i + k, " ".join(t)) for k, t in enumerate(texts)]
    first, due = {}, collections.defaultdict(set)
    for d, text in rows:
        words = text.split()
        for s in range(len(words) - 49):
            if first.setdefault(tuple(words[s : s + 50]), d) != d:
                due[d].update(range(s, s + 50))
    got = collections.defaultdict(set)
    texts = {d: t.split() for d, t in rows}
    for r in substring_dedup.repeated_passages(frame(spark, rows)).collect():
        got[r.doc_id].update(range(r.start, r.end))
        assert r.source_id < r.doc_id and r.end - r.start >= 50
        assert r.similarity < 1 or texts[r.doc_id][r.start : r.end] == texts[r.source_id][r.source_start : r.source_end]
    assert len(due) == 60 and all(places <= got[d] for d, places in due.items())


def test_substring_dedup_recall_of_edited_copies(spark):
    """Copies with scattered changed, added and missing words among unrelated text, down to a similarity of 0.8."""
    draw = random.Random(17)
    new = lambda n: [f"v{draw.randrange(10**9)}" for _ in range(n)]
    rows, due = [], collections.defaultdict(set)
    for i in range(400):
        size, edits, kinds = draw.choice([(51, 1), (51, 3), (51, 5), (51, 8), (60, 8), (60, 12), (80, 8)]) + (i % 2,)
        passage = new(size)
        copy = list(passage)
        for at in sorted(draw.sample(range(1, size - 1), edits), reverse=True):
            copy[at : at + 1] = draw.choice([new(1), new(1) + [copy[at]], []] if kinds else [new(1)])
        if len(copy) >= 50:
            rows += [(2 * i, " ".join(new(60) + passage + new(60))), (2 * i + 1, " ".join(new(60) + copy + new(60)))]
            due[size, edits].add(2 * i + 1)
    got = {r.doc_id for r in substring_dedup.repeated_passages(frame(spark, rows)).collect() if r.source_id == r.doc_id - 1}
    lost = {case: (len(ids - got), len(ids)) for case, ids in sorted(due.items())}
    print(lost)
    assert sum(n for n, _ in lost.values()) <= 0.01 * len(rows) / 2
    assert not any(lost[case][0] for case in ((51, 1), (51, 3), (51, 5), (80, 8)))


def test_chain_prefers_the_ascending_run():
    import numpy as np

    pos, rpos = np.array([0, 10, 20, 30, 31]), np.array([50, 10, 20, 30, 5])
    best = substring_dedup.chain(pos, rpos)[0]
    assert best.tolist() == [1, 2, 3]


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    total = docs.count()
    counts = [total]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = docs.sparkSession.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * total
    assert counts[1] == total  # every document there has letters and a clear language
    clean = decontaminate.match_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert clean.where("n_hit > 0").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == counts[-1]


def test_pipeline_stages_awkward(spark, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        for rows in (AWKWARD, []):
            docs = frame(spark, rows)
            done = stage(spark, docs, sf_dir)
            assert done.count() <= max(len(rows), 60)
            if stage is not corpus_pipeline.STAGES[-1][1]:
                assert done.schema.names == docs.schema.names
    kept = corpus_pipeline.STAGES[0][1](spark, frame(spark, AWKWARD), sf_dir)
    assert kept.where(F.col("text").isNull()).count() == 0
