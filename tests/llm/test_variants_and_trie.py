"""Spelling variants and the conversation trie against plain statements of their rules."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from corpusloom.llm import prefix_trie, queries, spelling
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, source string"


def near(a, b):
    if a == b:
        return False
    cuts = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
    replaced = len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1
    return replaced or b in cuts(a) or a in cuts(b)


def grouped(counts, least=6, often=5, ratio=5):
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= often}
    around = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, found in around.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), n, len(around[w]), words.get(form[w])) for w, n in words.items())


def some_words(seed, n, alphabet="abcé"):
    rng = random.Random(seed)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 9))) for _ in range(n)]
    for w in base[:]:
        i = rng.randrange(len(w))
        base += [w[:i] + w[i + 1 :], w[:i] + rng.choice(alphabet) + w[i:], w[:i] + rng.choice(alphabet) + w[i + 1 :]]
    return Counter({w: 5 ** rng.randint(0, 4) + rng.randint(0, 9) for w in base})


def shown(df):
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("tile", [1024, 3])
def test_variants_equal_brute_force(spark, tile):
    counts = some_words(1, 60)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert shown(spelling.variants(words, tile_words=tile)) == grouped(counts)


def test_variants_in_one_hot_block(spark):
    """All words share their first half; tiles of eight words split the block."""
    rng = random.Random(5)
    counts = Counter({"aaaaaa" + "".join(rng.choice("xy") for _ in range(6)): rng.randint(5, 900) for _ in range(60)})
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert shown(spelling.variants(words, tile_words=8)) == grouped(counts)


def test_one_edit():
    rng = random.Random(3)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 4))) for _ in range(60)]
    assert all(spelling.one_edit(a, b) == near(a, b) for a in words for b in words)


def test_word_counts_and_planted_errors(spark):
    texts = ["Ångström ångström NAÏVE naïve×2 don't", None, "", "x" * 50_000 + " tail", "tail TAIL", "tail TAIL"]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "tail", None)]
    docs = spark.createDataFrame(rows, DOCS)
    want = Counter()
    for i, t, _ in rows:
        for run in spelling.RUN.findall(t or ""):
            want[queries.misspelt("" if i is None else str(i), spelling.lower_ascii(run))] += 1
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs, change=queries.misspelt).collect()}
    assert got == dict(want)
    assert got["ångström"] == 1 and got["Ångström"] == 1  # only A to Z are lower-cased


def test_misspelt_deletes_one_code_point():
    word = next(w for w in (f"w{'é' * k}" for k in range(1, 5000)) if zlib.crc32(f"7:{w}".encode()) % 199 == 0)
    at = zlib.crc32(f"7:{word}".encode()) % len(word)
    assert queries.misspelt("7", word) == word[:at] + word[at + 1 :]


def test_no_words(spark):
    assert shown(spelling.group_variants(spark.createDataFrame([], DOCS))) == []
    assert shown(spelling.group_variants(spark.createDataFrame([(1, "1 2 3", "s")], DOCS))) == []


TURNS = "conv_id long, turn int, role string, text string, depth string"


def plain_trie(sequences):
    """{conv: [(role, text)]} to rows of the contract."""
    key = lambda s: tuple(s)
    members, ends = defaultdict(list), defaultdict(list)
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[key(turns[:d])].append(conv)
        ends[key(turns)].append(conv)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    rows = []
    for node, convs in members.items():
        under = [other for other in members if other[: len(node)] == node]
        saved = sum((len(members[o]) - 1) * len(o[-1][1].encode()) for o in under if o)
        parent = min(members[node[:-1]]) if node else None
        said = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        leaves = sum(not children[o] for o in under)
        rows.append((min(convs), len(node), parent, len(convs), len(children[node]), leaves, saved, said))
    return sorted(rows, key=repr)


def trie_rows(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def some_conversations(seed, n, kinds=3, longest=6):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            said = rng.choice(["", "é", "word", "a longer text"][:kinds])
            rows.append((conv, turn, rng.choice(["user", "assistant"]), said, "x"))
    return rows


def sequences_of(rows):
    out = defaultdict(list)
    for conv, turn, role, text, _ in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1])):
        out[conv].append((role or "", text or ""))
    return out


@pytest.mark.parametrize("chunk", [1, 2, 7, 8192])
def test_trie_equals_brute_force(spark, chunk):
    rows = some_conversations(2, 60) + [(1000, None, None, None, "first"), (1000, 3, "user", "é", None)]
    turns = spark.createDataFrame(rows, TURNS)
    got = prefix_trie.trie(prefix_trie.paths(prefix_trie.turn_digests(turns)), chunk_keys=chunk)
    assert trie_rows(got) == plain_trie(sequences_of(rows))


def test_trie_of_copies_and_long_conversations(spark):
    """A third of the rows are copies of one conversation; another one is long; one turn is very long."""
    rows = [(c, t, "user", f"turn {t}", "x") for c in range(40) for t in range(5)]
    rows += [(500, t, "user", f"turn {t}" if t < 3 else f"own {t}", "x") for t in range(400)]
    rows += [(600, 0, "user", "long " * 100_000, "x"), (601, 0, "user", "long " * 100_000, "x")]
    turns = spark.createDataFrame(rows, TURNS)
    got = prefix_trie.trie(prefix_trie.paths(prefix_trie.turn_digests(turns)), chunk_keys=3)
    assert trie_rows(got) == plain_trie(sequences_of(rows))


def test_query_rebuilds_by_blocks(spark, tmp_path):
    rows = [r for r in some_conversations(4, 83, kinds=2, longest=11) if r[0] not in (5, 11, 40)]
    spark.createDataFrame(rows, TURNS).drop("depth").write.parquet(f"{tmp_path}/conversations.parquet")
    own = sequences_of(rows)
    rebuilt = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        rebuilt[conv] = own.get(conv - conv % 5, [])[:h] + turns[h:]
    assert any(not turns for turns in rebuilt.values()) and len(rebuilt) == len(own)
    assert trie_rows(queries.op13_conversation_trie(spark, str(tmp_path))) == plain_trie(rebuilt)


def test_trie_of_nothing_and_of_null_ids(spark):
    assert trie_rows(prefix_trie.prefix_trie(spark.createDataFrame([], TURNS))) == []
    rows = [(None, 0, "user", "a", "x"), (None, 0, "user", "a", "x"), (7, 0, "user", "a", "x")]
    got = {r["depth"]: r for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()}
    assert [got[d]["n_convs"] for d in range(3)] == [2, 2, 1]
    assert got[2]["conv_id"] is None and got[2]["parent_conv_id"] == 7
    assert got[2]["ends_sha256"] == hashlib.sha256(b"null").hexdigest()


def test_equal_turn_numbers_are_ordered_alike(spark):
    rows = [(1, 0, "user", "a", "x"), (1, 0, "user", "b", "x"), (2, 0, "user", "b", "x"), (2, 0, "user", "a", "x")]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS))
    assert sorted(r["n_convs"] for r in got.collect()) == [2, 2, 2]


def test_radix_layouts_grow_and_keep_order():
    rng = random.Random(9)
    keys = list({bytes([rng.randrange(256) for _ in range(rng.choice([4, 8, 12]))]) for _ in range(3000)})
    keys += [bytes([1, 2, 3, b]) + bytes(4) for b in range(256)]
    keys = list(dict.fromkeys(keys))
    tree = prefix_trie.RadixTree()
    for i, key in enumerate(keys):
        tree.insert(key, i)
    path, found, rooms = bytearray(), [], set()
    for above, edge, value in tree.walk():
        del path[above:]
        path += edge
        if value is not None:
            found.append((bytes(path), value))
    stack = [tree.top]
    while stack:
        node = stack.pop()
        rooms.add(node.room)
        for byte, kid in node.children():
            assert node.child(byte) is kid
            stack.append(kid)
    assert found == sorted((k, i) for i, k in enumerate(keys))
    assert rooms == {4, 16, 48, 256}
