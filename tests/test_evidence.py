import random

from helpers import matched, near, rows
from pyspark.sql import functions as F

from corpusloom.operators import evidence as ev
from corpusloom.session import materialize

CHUNKS = "document_id string, chunk_id string, text string, structural_context struct<page int, section string>, order int"
REFS = "document_id string, chunk_id string, evidence string, n int"
WORDS = "the cat dog house river on at en el la perro niño été über ξ 123 lorem ipsum".split()


def phrase(rng, longest):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, longest)))


def garbled(rng, text):
    out = list(text)
    for _ in range(rng.randint(0, max(1, len(out) // 5))):
        i = rng.randrange(len(out))
        out[i : i + rng.randint(0, 1)] = rng.choice(["#", "", "zz", " \n "])
        out = out or ["x"]
    return "".join(out)


def corpus(rng, docs, chunks, refs):
    texts = {(d, f"chunk-{c:03d}"): phrase(rng, 40) for d in docs for c in range(chunks)}
    quotes = []
    for n in range(refs):
        d, c = rng.choice(docs), f"chunk-{rng.randrange(chunks + 1):03d}"
        source = texts[d, rng.choice([k[1] for k in texts if k[0] == d])]
        i = rng.randrange(len(source))
        quote = source[i : i + rng.choice([3, 20, 60, 250])]
        quotes.append((d, c, rng.choice([quote, quote, garbled(rng, quote), phrase(rng, 8), " \n"]), n))
    return texts, quotes


def frames(spark, texts, quotes):
    chunks = [(d, c, t, (None, None), int(c[6:])) for (d, c), t in texts.items()]
    return spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(quotes, REFS)


def want(texts, quotes):
    by_doc = {}
    for (d, c), t in texts.items():
        by_doc.setdefault(d, {})[c] = t
    return {n: matched(e, c, by_doc[d]) for d, c, e, n in quotes}


def test_similarity_equals_the_full_search():
    rng = random.Random(1)
    for _ in range(1500):
        text = phrase(rng, 50) if rng.random() < 0.95 else ""
        quote = garbled(rng, text[: rng.choice([1, 9, 70, 300])] or "x") if rng.random() < 0.8 else phrase(rng, 6)
        assert ev.similar(quote, text) == near(quote, text), (quote, text)


def test_similarity_over_slices(monkeypatch):
    monkeypatch.setattr(ev, "COUNT_CELLS", 1)
    rng = random.Random(2)
    for _ in range(200):
        text = phrase(rng, 120)
        i = rng.randrange(len(text))
        quote = garbled(rng, text[i : i + 40])
        assert ev.similar(quote, text) == near(quote, text)


def test_verification_equals_brute_force(spark):
    texts, quotes = corpus(random.Random(3), ["a", "b", "c"], 4, 150)
    chunks, refs = frames(spark, texts, quotes)
    got = {r.n: r.match for r in ev.verify_evidence(refs, chunks).collect()}
    assert got == want(texts, quotes)
    assert set(got.values()) == {"referenced", "elsewhere", "similar", "none"}


def test_one_hot_document_in_several_batches_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ev, "CHUNK_BLOCK", 4)
    texts, quotes = corpus(random.Random(4), ["hot"], 30, 260)
    quotes += [("hot", "chunk-000", "the same words again", 1000 + i) for i in range(200)]
    chunks, refs = frames(spark, texts, quotes)
    keys = ev.evidence_keys(refs)
    batches = ev.evidence_batches(keys, chunks, batch=64, block=4)
    assert batches.select("_block").distinct().count() == 8
    assert batches.select(F.max(F.size("evidences"))).first()[0] < 200
    got = {r.n: r.match for r in ev.verify_evidence(refs, chunks, settle=lambda df: materialize(df, "k")).collect()}
    assert got == want(texts, quotes)


def test_summary_and_flags(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "document_id string")
    els = spark.createDataFrame([("a", True), ("a", False)], "document_id string, verified boolean")
    assert rows(ev.verification_summary(docs, els)) == [("a", 1, 2, 0.5), ("b", 0, 0, 0.0)]
    owners = spark.createDataFrame([(k,) for k in "xyz"], "k string")
    refs = spark.createDataFrame([("x", False), ("x", True), ("y", False)], "k string, evidence_verified boolean")
    assert rows(ev.all_evidence_unverified(owners, refs, ["k"])) == [("x", False), ("y", True), ("z", False)]


def test_fingerprints_of_a_part_are_those_of_the_whole(spark):
    rng = random.Random(6)
    whole = phrase(rng, 400)
    parts = [whole[i : i + ev.MEET + rng.randint(0, 90)] for i in range(0, len(whole) - ev.MEET - 90, 7)]
    texts = spark.createDataFrame([(p,) for p in [whole, *parts]], "t string")
    got = {r.t: set(r.fingerprints) for r in ev.with_fingerprints(texts, "t").collect()}
    assert all(got[p] and got[p] <= got[whole] for p in parts)
    assert len(got[whole]) < len(whole) / 8


def test_any_chunk_by_fingerprint_equals_brute_force(spark):
    """Long texts in several pieces, boilerplate in every chunk, near misses that share windows, quotes at either end."""
    rng = random.Random(7)
    stock = phrase(rng, 60)
    texts = {("a", f"chunk-{i:03d}"): f"{phrase(rng, 120)} {stock} {phrase(rng, 120)}" for i in range(25)}
    texts |= {("b", "chunk-000"): phrase(rng, 900), ("b", "chunk-001"): "", ("b", "chunk-002"): "x" * 2000}
    quotes = []
    for n in range(300):
        d, c = rng.choice(list(texts))
        flat = " ".join(texts[d, c].split())
        size = rng.choice([ev.MEET - 1, ev.MEET, 60, 200, 700])
        i = rng.choice([0, max(len(flat) - size, 0), rng.randrange(len(flat) + 1)])
        quote = flat[i : i + size]
        if n % 3 == 0 and len(quote) > 50:
            quote = quote[:45] + "#" + quote[46:]
        quotes.append((rng.choice([d, d, "b"]), c, quote or "q", n))
    quotes += [("a", "chunk-000", stock + f" {i}", 1000 + i) for i in range(9)] + [("none", "chunk-000", stock, 2000)]
    chunks, refs = frames(spark, texts, quotes)
    keys = ev.evidence_keys(refs)
    got = {(r.document_id, r.evidence): r.in_any for r in ev.match_any_chunk(keys, chunks).collect()}
    flat = {}
    for (d, _), t in texts.items():
        flat.setdefault(d, []).append(" ".join(t.split()))
    want_ = {(d, e): any(e in t for t in flat.get(d, [])) for d, e in got}
    assert got == want_ and set(got.values()) == {True, False}


def test_one_document_of_many_chunks_makes_rows_in_proportion(spark):
    """12,000 chunks, an evidence from each: candidates to compare are about one for each evidence, not 12,000."""
    text = F.concat_ws(" ", *[F.sha2(F.concat(F.lit(str(k)), F.col("id").cast("string")), 256) for k in range(3)])
    chunks = spark.range(12_000).select(
        F.lit("hot").alias("document_id"),
        F.concat(F.lit("chunk-"), F.col("id").cast("string")).alias("chunk_id"),
        text.alias("text"),
        F.col("id").cast("int").alias("order"),
    )
    texts = chunks.select("document_id", F.substring("text", 30, 60).alias("evidence"))
    kept = []

    def settle(df):
        kept.append(materialize(df, "marks"))
        return kept[-1]

    assert ev.find_by_fingerprint(texts, chunks, settle).distinct().count() == 12_000
    marks, tried = (df.count() for df in kept)
    assert marks <= 12_000 * 6 and tried == 12_000


def test_few_evidences_are_not_hashed(spark, monkeypatch):
    """Documents with few evidences meet their chunks directly; both ways give the same."""
    rng = random.Random(11)
    texts = {("a", f"chunk-{i:03d}"): phrase(rng, 200) for i in range(6)} | {("b", "chunk-000"): phrase(rng, 90)}
    flat = {k: " ".join(t.split()) for k, t in texts.items()}
    quotes = [("a", "chunk-000", t[20:80], n) for n, t in enumerate(flat.values())]
    quotes += [("a", "chunk-001", flat["a", "chunk-001"][5:60] + "#", 50), ("c", "chunk-000", flat["a", "chunk-000"][:60], 51)]
    chunks = spark.createDataFrame([(*k, t, int(k[1][-3:])) for k, t in texts.items()], "document_id string, chunk_id string, text string, order int")
    keys = ev.evidence_keys(spark.createDataFrame(quotes, "document_id string, chunk_id string, evidence string, n int"))
    asked = {(d, c, " ".join(q.split())) for d, c, q, _ in quotes}
    want = sorted((d, c, q, any(q in t for (e, _), t in flat.items() if e == d)) for d, c, q in asked if q)
    hashed = []
    plain = ev.chunk_fingerprints

    def counted(rows):
        hashed.append(rows.count())
        return plain(rows)

    monkeypatch.setattr(ev, "chunk_fingerprints", counted)
    for few, chunks_hashed in ((ev.FEW, 0), (0, 6)):
        monkeypatch.setattr(ev, "FEW", few)
        hashed.clear()
        assert sorted(tuple(r) for r in ev.match_any_chunk(keys, chunks).select(*ev.KEY, "in_any").collect()) == want
        assert hashed == [chunks_hashed]
