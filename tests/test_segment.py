import pytest
from helpers import markdown_chunks, packed, plaintext_chunks, random_texts, rows
from pyspark.sql import functions as F

from corpusloom.operators import segment as seg

DOCS = "document_id string, text string"


def flat(chunks):
    return rows(chunks, "document_id", "order", "text", "structural_context.section")


@pytest.mark.parametrize(
    "fn, rule, seed, alphabet",
    [
        (seg.chunk_markdown, markdown_chunks, 1, "##  \n\nab\t# \x1c"),
        (seg.chunk_plaintext, plaintext_chunks, 2, "===---\n\n\nAB a\r\x0b1"),
        (seg.chunk_plaintext, plaintext_chunks, 3, "=\n=\n=\nÁÑ中ª \x85 -"),
    ],
)
def test_text_chunks_follow_the_sequential_rule(spark, fn, rule, seed, alphabet):
    texts = random_texts(600, seed, alphabet)
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], DOCS)
    want = sorted((str(i), *c) for i, t in enumerate(texts) for c in rule(t))
    assert flat(fn(docs)) == want


def test_markdown_sections(spark):
    docs = spark.createDataFrame([("a", "intro\n# One\nx\n### deep\ny\n## Two\n\n# \n"), ("b", "   "), ("c", "plain")], DOCS)
    assert flat(seg.chunk_markdown(docs)) == [
        ("a", 0, "intro", "(preamble)"),
        ("a", 1, "# One\nx\n### deep\ny", "# One"),
        ("a", 2, "## Two\n\n#", "## Two"),
        ("c", 0, "plain", "(preamble)"),
    ]


def test_chunk_numbers_grow_past_three_digits(spark):
    docs = spark.createDataFrame([("a", "\n".join(f"# h{i}" for i in range(1002)))], DOCS)
    assert rows(seg.chunk_markdown(docs).where("order >= 1000"), "chunk_id") == [("chunk-1000",), ("chunk-1001",)]


def test_packing_is_greedy(spark):
    texts = random_texts(300, 4, "ab \n\n\n")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.p for r in df.select("i", seg.pack_paragraphs(F.col("text"), 6).alias("p")).collect()}
    assert got == {i: packed(t, 6) for i, t in enumerate(texts)}


def test_pages_number_over_the_document(spark):
    pages = [("a", p, t) for p, t in enumerate(["one", "  ", "x\n\n" * 3 + "y" * 9, "last"], 1)]
    pages += [("b", p, f"page {p}") for p in range(1, 9001)]
    out = seg.chunk_pages(spark.createDataFrame(pages, "document_id string, page int, text string"), limit=8)
    a = rows(out.where("document_id = 'a'"), "order", "structural_context.page", "text")
    assert a == [(0, 1, "one"), (1, 3, "x\n\nx\n\nx"), (2, 3, "y" * 9), (3, 4, "last")]
    assert out.where("document_id = 'b' and order = structural_context.page - 1").count() == 9000


def test_samples_and_segments(spark):
    texts = ["a" * 900, "b" * 300, "c" * 1500, "d" * 10]
    chunks = spark.createDataFrame(
        [("a", f"chunk-{i:03d}", t, (None, "s"), i) for i, t in enumerate(texts)],
        "document_id string, chunk_id string, text string, structural_context struct<page int, section string>, order int",
    )
    assert seg.language_sample(chunks).first().sample == " ".join(texts)[:1000]
    assert seg.type_sample(chunks).first().sample == "\n".join([texts[0], texts[1], texts[2][:800]])
    assert seg.full_text(chunks).first().text == "\n".join(texts)
    assert rows(seg.segment_chunks(chunks, 1200), "order", "segment") == [(0, 0), (1, 0), (2, 1), (3, 2)]
    assert rows(seg.segment_chunks(chunks, 5000), "segment") == [(0,)] * 4
    assert [c.chunk_id for c in seg.structural_contexts(chunks).first().contexts] == [f"chunk-00{i}" for i in range(4)]
