"""Row-wise operators against plain versions, on awkward rows and on whole small tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from corpusloom.llm import chat_format, language_id, packing, quality, queries, token_counts, tokens, toxicity

AWKWARD = [
    None,
    "",
    " \n\t ",
    "a",
    "don't  stop <|endoftext|> now\r\n\n  x² ½ _under_ ’s 12٩ 你好 \U0001f600 éÉİ",
    "word " * 3000,
    "x" * 5000,
    "\x1c\x1d tab\x85 nbsp end",
]
SCHEMA = "doc_id bigint, text string, number int, row string, key string, spans string"


def frame(spark, texts, ids=None):
    """Rows with columns named as the operators name theirs."""
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, 1, "r", "k", "s") for i, t in zip(ids, texts, strict=True)], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r.doc_id: r.text for r in queries.table(spark, sf_dir, "documents").collect()}


def test_ids_equal_the_library(library, documents):
    for text in [*AWKWARD, *documents.values()]:
        assert tokens.encode(text).tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_plain_characters_split_alike(library):
    plain = [chr(c) for c in range(0x250) if not tokens.strange().search(chr(c))]
    assert len(plain) > 400
    for c in plain:
        text = f"a{c} {c}b1{c}2 .{c}!{c}{c} '{c}s"
        assert tokens.Counter(1).count([text]) == [len(library.encode(text, add_special_tokens=False).ids)]


def test_token_counts(spark, library):
    rows = token_counts.token_counts(frame(spark, AWKWARD), doc_id=F.col("doc_id")).collect()
    for row in rows:
        text = AWKWARD[row.doc_id] or ""
        assert row.n_tokens == len(library.encode(text, add_special_tokens=False).ids)
        assert row.n_bytes == len(text.encode())


def check_pieces(rows, texts, library):
    of_doc, of_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        of_doc[r.doc_id].append(r)
        of_sequence[r.sequence_id].append(r)
    for doc, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(of_doc[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for parts in of_sequence.values():
        size = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == size
            size += r.length
        assert size <= 2048
        total += size
        padding += 2048 - size if size & (size - 1) else 0
    return padding, total


def test_packing(spark, sf_dir, library, documents):
    padding, total = check_pieces(queries.op9_packing(spark, sf_dir).collect(), documents, library)
    assert padding <= 0.01 * total


def test_packing_awkward_and_empty(spark, library):
    docs = frame(spark, AWKWARD).coalesce(1)
    rows = packing.digest_columns(packing.pack(docs, doc_id=F.col("doc_id"))).collect()
    check_pieces(rows, dict(enumerate(AWKWARD)), library)
    assert packing.pack(frame(spark, []), doc_id=F.col("doc_id")).count() == 0


def test_step_groups_are_balanced():
    packer = packing.Packer(0)
    for i, size in enumerate(np.random.default_rng(0).integers(1, 3000, 3000)):
        packer.add(i, int(size))
    pieces = packer.drain(True)
    per_group = collections.defaultdict(set)
    for _, _, _, sequence, _, tier, group in pieces:
        per_group[tier, group].add(sequence)
    full = collections.Counter(tier * len(s) for (tier, _), s in per_group.items())
    assert max(full) == packing.STEP_TOKENS and sum(n for size, n in full.items() if size < packing.STEP_TOKENS) <= 4


def quality_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for k in range(8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside), failed


def test_quality(spark, sf_dir, documents):
    texts = [*documents.values(), *AWKWARD, "a b c d e f g h " * 9, "l\nl\n \n \nl"]
    for row in quality.quality(frame(spark, texts), doc_id=F.col("doc_id")).collect():
        got = (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed)
        assert got == quality_by_hand(texts[row.doc_id] or "")
        assert not (row.base_failed and row.kept)


def test_bands_reject_repetition_and_noise():
    import random

    import zstandard

    tool, draw = zstandard.ZstdCompressor(level=quality.LEVEL), random.Random(1)
    noise = bytes(draw.randrange(33, 127) for _ in range(6000))
    assert not quality.band_verdict(b"the same line again\n" * 300, tool)[3]
    assert not quality.band_verdict(noise, tool)[3]


def test_chat_round_trip(spark, sf_dir):
    texts = ["</s>[INST] ok [/INST]", "<|end|><\\|end|>\\", "[\\INST] <s", "", "你 <|text|><|turn|>"]
    for text in texts:
        ids, mask = chat_format.format_turn("assistant", text)
        role, back, loss, printed = chat_format.read_turn(ids, mask)
        assert (role, back, loss) == ("assistant", text, text)
        shown = "".join(chat_format.PRINTED.get(i) or tokens.rank_encoder().decode([i]) for i in ids.tolist()) if text.isascii() else ""
        assert not text.isascii() or (len(shown) == printed and shown.count("<|end|>") == 1)


def test_chat_digests_with_nulls_and_ties(spark):
    rows = [(None, None, None, None), (1, 0, "user", None), (1, 0, "assistant", "b"), (1, 0, "assistant", "b"), (1, 1, "user", "c")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn int, role string, text string, ids string")
    done = chat_format.conversation_digests(chat_format.read_back(chat_format.format_turns(turns)))
    got = {r.conv_id: r for r in done.collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"assistant\nb\nassistant\nb\nuser\n\nuser\nc\n").hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (4, 2, hashlib.sha256(b"bb").hexdigest())
    assert got[None].n_turns == 1
    empty = chat_format.format_turns(turns.limit(0))
    assert chat_format.conversation_digests(chat_format.read_back(empty)).count() == 0


def test_forward_sums_all_segmentations():
    pieces = {p: i for i, p in enumerate(language_id.vocabulary())}
    table = np.random.default_rng(2).random((len(pieces) + 1, 2)) * 0.1

    def by_hand(word, k):
        alpha = [1.0]
        for end in range(1, len(word) + 1):
            mass = 0.0
            for width in range(1, min(end, language_id.MAX_PIECE) + 1):
                piece = pieces.get(word[end - width : end])
                if piece is not None:
                    mass += alpha[end - width] * table[piece, k]
                elif width == 1:
                    mass += alpha[end - 1] * table[-1, k]
            alpha.append(mass)
        return np.log(alpha[-1])

    words = ["▁the", "▁therein", "▁你好", "▁a", "▁überall"]
    got = language_id.forward(words, table)
    for i, word in enumerate(words):
        for k in (0, 1):
            assert got[i, k] == pytest.approx(by_hand(word, k))


def test_expected_counts_add_up():
    table = np.full(len(language_id.vocabulary()) + 1, 1e-3)
    counts = language_id.expected_counts(["▁in"], np.array([2.0]), table)
    pieces = language_id.vocabulary()
    chars = sum(n * (len(pieces[i]) if i < len(pieces) else 1) for i, n in enumerate(counts))
    assert chars == pytest.approx(2 * len("▁in"))


def test_language_id(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in queries.table(spark, sf_dir, "documents").collect()}
    rows = queries.op10_language_id(spark, sf_dir).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95


def test_language_id_awkward(spark):
    texts = ["the end of the thing", "und der die das", None, "", "12 ²", "x" * 9000, "the end of it all"]
    docs = frame(spark, texts).withColumn("lang", F.expr("CASE doc_id % 2 WHEN 0 THEN 'en' WHEN 1 THEN 'de' END"))
    model = language_id.fit(docs)
    rows = {r.doc_id: r for r in language_id.identify(docs, model, doc_id=F.col("doc_id")).collect()}
    assert [rows[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and rows[0].lang_pred == "en"
    empty = language_id.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language_id.identify(docs, empty, doc_id=F.col("doc_id")).collect()} == {"und"}


def test_toxicity_learns_stems_and_scopes(spark):
    clean = [f"the quiet river number{i} runs on" for i in range(400)]
    toxic = [f"the quiet river number{i} is a zorgl{chr(97 + i % 20)}. You zorglx" for i in range(100)]
    texts = [*clean, *toxic]
    docs = frame(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, int(i >= 400)) for i in range(500)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model, doc_id=F.col("doc_id")).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all((r.score >= 0.5) == (400 <= r.doc_id < 500) for r in held)
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == 502
    nothing = toxicity.fit(docs, labels.limit(0))
    assert len(toxicity.score(docs, nothing, doc_id=F.col("doc_id")).collect()) == 502


def test_scope_machine():
    model = toxicity.Model(lexicon={"clod$": 9.0})
    found = lambda t: toxicity.matches_of([t], model)[0]
    assert found("a clod") == {"insult3/plain"}
    assert found("not a clod") == {"insult3/negated"}
    assert found("you clod") == {"insult3/target"}
    assert found("she said it. clod") == {"insult3/plain"}
    assert found("she said clod") == {"insult3/reported"}


def test_schema_types(spark, sf_dir):
    done = queries.op10_language_id(spark, sf_dir)
    assert isinstance(done.schema["score"].dataType, T.DoubleType)


def test_any_number_of_languages_can_be_told(spark):
    """600 languages of two documents each; every one is learned and predicted, those of few rows too."""
    draw = random.Random(4)
    rows = []
    for k in range(600):
        own = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
        rows += [(2 * k + i, f"{own} {own} {own}", f"l{k:03d}") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    learned = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5}
    assert set(model.languages) == learned and len(learned) > 550


def test_step_groups_are_balanced_over_many_tasks(spark):
    draw = random.Random(6)
    rows = [(i, " ".join("word" for _ in range(draw.choice([3, 40, 200, 700, 3000])))) for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(32)
    pieces = packing.pack(docs, doc_id=F.col("doc_id"))
    groups = packing.step_groups(pieces.select("sequence_id", "tier", "length"))
    tokens = collections.defaultdict(int)
    for r in groups.collect():
        tokens[r.tier, r.step_group] += r.n_tokens
    for tier in packing.TIERS:
        sizes = [n for (t, _), n in sorted(tokens.items()) if t == tier]
        assert sorted(g for t, g in tokens if t == tier) == list(range(len(sizes)))
        assert all(abs(n - packing.STEP_TOKENS) < tier for n in sizes[:-1])
    assert len(tokens) > 8
