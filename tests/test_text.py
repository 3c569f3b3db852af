import random
import re

import pytest
from helpers import random_texts
from pyspark.sql import functions as F

from corpusloom.functions import files as ff
from corpusloom.functions import text as tx
from corpusloom.operators import profile as pf

SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def one(spark, column, value=None):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("r")).first().r


def test_whitespace_is_unicode(spark):
    texts = random_texts(500, 5, SPACES + "aaaaaaaa")
    got = spark.createDataFrame([(t,) for t in texts], "v string").select("v", tx.normalize_ws("v").alias("n"), tx.strip("v").alias("s"))
    for r in got.collect():
        assert r.n == re.sub(r"\s+", " ", r.v).strip()
        assert r.s == r.v.strip()


@pytest.mark.parametrize(
    "text, language",
    [
        ("The cat is on the mat and it was there for the night", "en"),
        ("El perro de la casa es muy bueno y no se va con los otros", "es"),
        ("Le chat noir dort profondément sur sofa rouge chaque soir", "unknown"),
        ("Der Hund läuft schnell durch einen großen dunklen Wald", "unknown"),
        ("1 2 3 4 5 6 7 8", "unknown"),
        ("the and of", "unknown"),
        ("niño piensa rápido ¿verdad? ¡claro!", "es"),
        ("the is de la uno veinte tres cuatro", "unknown"),
        ("", "unknown"),
    ],
)
def test_language(spark, text, language):
    assert one(spark, tx.detect_language("v"), text) == language


@pytest.mark.parametrize(
    "name, safe",
    [
        ("../../etc/passwd", "passwd"),
        ("a\\b.md", "a_b.md"),
        ("my file (1).txt", "my_file_1_.txt"),
        ("...", "unnamed_file"),
        ("informe_año.pdf", "informe_año.pdf"),
        ("a..b", "a.b"),
    ],
)
def test_file_names(spark, name, safe):
    assert one(spark, tx.sanitize_filename("v"), name) == safe


@pytest.mark.parametrize(
    "name, fmt, routed, upload",
    [
        ("a.MD", "markdown", "markdown", ".md"),
        ("a.b.txt", "plain_text", "plain_text", ".txt"),
        (".md", None, "markdown", ".md"),
        ("a.", None, None, "."),
        ("noext", None, None, ""),
        ("x.html", None, None, ".html"),
    ],
)
def test_formats(spark, name, fmt, routed, upload):
    row = spark.createDataFrame([(name,)], "v string").select(
        ff.detect_format("v"), ff.route_format("v"), ff.dot_suffix("v")
    ).first()
    assert tuple(row) == (fmt, routed, upload)


def test_file_checks_in_order(spark):
    big, pdf = ff.MAX_TEXT_BYTES, ff.MAX_PDF_BYTES
    files = [
        ("ok.md", big, b"x", None),
        ("big.md", big + 1, b"x", "file_too_large"),
        ("ok.pdf", pdf, b"\xff", None),
        ("big.pdf", pdf + 1, b"\xff", "file_too_large"),
        ("latin.txt", 3, b"\xe9a", "invalid_encoding"),
        ("half.txt", 3, "ñ".encode()[:1], "invalid_encoding"),
        ("surrogate.txt", 3, b"\xed\xa0\x80", "invalid_encoding"),
        ("a.docx", big * 99, b"\xff", "unsupported_format"),
    ]
    df = spark.createDataFrame(files, "filename string, length long, content binary, want string")
    got = df.select("want", ff.file_error(F.col("filename"), F.col("length"), F.col("content")).code.alias("code"))
    assert all(r.want == r.code for r in got.collect())


def test_error_words(spark):
    cases = {
        "Scanned size": "scanned_pdf",
        "format not supported": "unsupported_format",
        "the SIZE": "file_too_large",
        "bad UTF-8": "invalid_encoding",
        "boom": "extraction_failed",
        None: "extraction_failed",
    }
    for message, code in cases.items():
        assert one(spark, ff.classify_error("v"), message) == code


def test_retention():
    assert [ff.retention_seconds(v) for v in (None, "60", "x", 5)] == [86400, 60, 86400, 5]


def test_small_rules(spark):
    row = spark.range(1).select(
        tx.clamp_score(F.lit(12.9)), tx.clamp_score(F.lit(-3)), tx.clamp_score(F.lit(None).cast("double")),
        tx.rate_percent(F.lit(0.125)), tx.rate_percent(F.lit(0.005)),
        tx.evidence_preview(F.lit("x" * 200)), tx.evidence_preview(F.lit("x" * 201)),
        tx.relation_tokens(F.lit("ab"), F.lit("cd"), F.lit("e"), F.lit(None).cast("string")),
        tx.relation_tokens(F.lit(""), F.lit(""), F.lit(""), F.lit("")),
        tx.chunk_label("fields", F.lit("c"), F.lit(0), F.lit("")), tx.chunk_label("tags", F.lit("c"), F.lit(0), F.lit("")),
        tx.chunk_label("tags", F.lit("c"), F.lit(2), F.lit("s")),
    ).first()
    assert tuple(row) == (
        10, 0, 0, 13, 1, "x" * 200, "x" * 200 + "…", 2, 1, "[chunk_id=c, page=0, section=]", "[chunk:c]", "[chunk:c] [section:s] [page:2]"
    )


def test_question_length(spark):
    got = [one(spark, ff.valid_question("v"), v) for v in (None, "", " ", "x" * 1000, "x" * 1001)]
    assert got == [False, False, True, True, False]


def test_outline_of_many_headings(spark):
    """More headings than one block of the fold, and levels that skip."""
    rng = random.Random(8)
    levels = [rng.randint(1, 6) for _ in range(700)]
    docs = spark.createDataFrame([("a", "\n".join("#" * k + f" t{i}" for i, k in enumerate(levels))), ("b", "no heading")], "document_id string, text string")
    want = [next((j for j in range(i - 1, -1, -1) if levels[j] < k), None) for i, k in enumerate(levels)]
    got = pf.section_tree(docs).orderBy("line").collect()
    assert [(r.document_id, r.line, r.level, r.title, r.parent_line) for r in got] == [
        ("a", i, k, f"t{i}", want[i]) for i, k in enumerate(levels)
    ]


def test_near_sections_equal_brute_force(spark):
    rng = random.Random(9)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(rng.randint(3, 60))] for _ in range(30)]
    rows = []
    for i, words in enumerate(base):
        edited = list(words)
        for _ in range(rng.randint(0, 3)):
            edited[rng.randrange(len(edited))] = "x" + str(rng.random())
        for order, part in ((i * 3, words), (i * 3 + 1, edited), (i * 3 + 2, words if i % 2 else words[::-1])):
            rows.append((f"d{i % 3}", f"# heading {order}\n" + " ".join(part), order))
    chunks = spark.createDataFrame(rows, "document_id string, text string, order int")
    seen, want = {}, set()
    for d, text, order in sorted(rows, key=lambda r: r[2]):
        seen.setdefault((d, text.split("\n", 1)[1]), order)
    runs = lambda t: {" ".join(t.split()[i : i + 5]) for i in range(max(len(t.split()) - 4, 1))}
    found = [(d, order, runs(t)) for (d, t), order in seen.items()]
    for d, order, a in found:
        for e, near, b in found:
            if d == e and order > near and len(a & b) / len(a | b) >= 0.8:
                want.add((d, order, near))
    got = {tuple(r)[:3] for r in pf.near_duplicate_sections(chunks).collect()}
    assert want and len(got & want) >= 0.9 * len(want) and got <= want


def test_only_keys_and_ids_of_sections_meet(spark):
    """No feature vector is shuffled, and a large document's equal-sized sections are all found."""
    rng = random.Random(10)
    words = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(40)]
    rows = [("a", " ".join(w), i) for i, w in enumerate(words)] + [("a", " ".join([*w[:-1], "end"]), 100 + i) for i, w in enumerate(words)]
    rows += [("b", " ".join(words[0]), 0), (None, " ".join(words[0]), 0)]
    chunks = spark.createDataFrame(rows, "document_id string, text string, order int")
    out = pf.near_duplicate_sections(chunks)
    assert sorted((r.document_id, r.order, r.near_order) for r in out.collect()) == [("a", 100 + i, i) for i in range(40)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    keyed = [line for line in plan.splitlines() if "Exchange hashpartitioning(document_id" in line and "key#" in line]
    assert keyed and "datasetA" not in plan and "entry#" not in plan


def test_keys_of_sections_follow_the_set_of_runs():
    """Order and repetition of runs do not count, and a text shorter than a run is one."""
    words = [f"w{i}" for i in range(30)]
    a, b, c = " ".join(words), " ".join(words + words), " ".join(words[15:] + words + words[:15])
    n, keys = pf._band_keys([a, b, c, "x y", "x", "x y", "é  z"], 5, 19)
    assert n.tolist() == [len(pf._runs(t, 5)) for t in (a, b, c, "x y", "x", "x y", "é  z")] == [26, 30, 30, 1, 1, 1, 1]
    assert (keys[1] == keys[2]).all() and (keys[3] == keys[5]).all() and not (keys[3] == keys[4]).any()
    alone = [pf._band_keys([t], 5, 19)[1][0] for t in (a, b, "x")]
    assert all((x == keys[i]).all() for x, i in zip(alone, (0, 1, 4), strict=True))


def test_sections_are_normalised_once_and_no_runs_are_rows(spark):
    chunks = spark.createDataFrame([("a", "x y z", 0)], "document_id string, text string, order int")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(pf._bodies(chunks)).count("lower(") == 1
    assert "array_distinct" not in plan(pf.near_duplicate_sections(chunks))
