import datetime as dt

import pytest
from helpers import rows
from pyspark.sql import functions as F

from corpusloom.model import QUALITY_PHASES
from corpusloom.operators import ingest as ing
from corpusloom.operators import sessions as ss
from corpusloom.operators.prefix import previous_value, running_total
from corpusloom.session import materialize
from corpusloom.sources import tables
from corpusloom.sources.files import scan_files
from corpusloom.streaming import arrivals

CHUNKS = "document_id string, chunk_id string, text string, structural_context struct<page int, section string>, order int"


def now():
    return F.lit("2024-05-01 00:00:00").cast("timestamp")


@pytest.mark.parametrize(
    "orders, ids, sequential, unique",
    [
        ([0, 1, 2], "abc", True, True),
        ([2, 0, 1], "abc", True, True),
        ([1, 2, 3], "abc", False, True),
        ([0, 2, 3], "abc", False, True),
        ([0, 1, 1], "abc", False, True),
        ([0, 1, 2], "aba", True, False),
        ([0, 0, 3, 3, 5, 5, 6, 7], "abcdefgh", False, True),
    ],
)
def test_chunk_check(spark, orders, ids, sequential, unique):
    chunks = spark.createDataFrame([("a", i, "t", (None, None), o) for o, i in zip(orders, ids)], CHUNKS)
    assert rows(ing.check_chunks(chunks)) == [("a", len(orders), sequential, unique)]


def test_two_level_windows_equal_plain_ones(spark):
    df = spark.range(3000).select(
        (F.col("id") % 3).alias("k"), (F.col("id") * 7 % 3001).alias("o"), (F.col("id") % 11).alias("v")
    )
    want, last = {}, {}
    for r in df.orderBy("k", "o").collect():
        total, prev = last.get(r.k, (0, None))
        want[r.k, r.o] = (total, prev)
        last[r.k] = (total + r.v, r.v)
    sums = running_total(df, ["k"], "o", F.col("v"), "before", block=50)
    both = previous_value(sums, ["k"], "o", "v", "prev")
    assert {(r.k, r.o): (r.before, r.prev) for r in both.collect()} == want


def test_previous_value_of_one_hot_key_spreads_over_tasks(spark):
    """A million timestamps, most of them in one dense stretch: no task gets more than a few ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        micros = F.when(F.col("id") % 10 == 0, F.col("id") * 1_000_000_000).otherwise(F.col("id"))
        events = spark.range(1_000_000).select(F.lit("hot").alias("k"), F.timestamp_micros(micros).alias("at"), "id")
        kept = []

        def settle(df):
            kept.append(materialize(df, "ranges"))
            return kept[-1]

        done = previous_value(events, ["k"], "at", "id", "before", settle)
        sizes = [r["count"] for r in kept[0].groupBy("_block").count().collect()]
        assert len(sizes) == 16 and max(sizes) < 2 * sum(sizes) / 16
        tasks = [r["count"] for r in done.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(tasks) >= 6 and max(tasks) <= 5 * max(sizes)
        assert done.where("before IS NULL").count() == 1
        text = done._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(k#" in text and ", _block#" in text
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_ingest_all_formats(spark, tmp_path):
    (tmp_path / "in").mkdir()
    files = {"a.md": b"# T\nthe cat is on the mat and it was", "b.txt": b"HEAD\nbody", "c.pdf": b"%PDF", "d.pdf": b"%PDF", "e.html": b"x", "f.md": b"\xff", "g.md": b" "}
    for name, content in files.items():
        (tmp_path / "in" / name).write_bytes(content)
    scanned = scan_files(spark, str(tmp_path / "in"))
    ids = {r.filename: r.document_id for r in scanned.select("filename", "document_id").collect()}
    assert set(ids) == set(files)
    pages = spark.createDataFrame([(ids["c.pdf"], 1, "page text " * 10), (ids["d.pdf"], 1, "few")], "document_id string, page int, text string")
    done = ing.ingest(scanned, now(), pages=pages)
    assert rows(done.documents, "original_filename", "status", "language") == [
        ("a.md", "ready", "en"), ("b.txt", "ready", "unknown"), ("c.pdf", "ready", "unknown"), ("d.pdf", "failed", None), ("g.md", "ready", "unknown")
    ]
    assert rows(done.rejected, "filename", "error_code") == [("e.html", "unsupported_format"), ("f.md", "invalid_encoding")]
    status = ing.document_status(done.documents, done.chunks)
    assert rows(status, "filename", "chunk_count") == [("a.md", 1), ("b.txt", 1), ("c.pdf", 1), ("d.pdf", None), ("g.md", 0)]

    tables.write_ir(done.documents, done.chunks, str(tmp_path / "ir"))
    one = tables.read_ir(spark, str(tmp_path / "ir"), ids["b.txt"])
    assert [c.text for c in one.first().chunks] == ["HEAD\nbody"]
    # one document is read from one bucket of each table
    assert len({f.split("bucket=")[1].split("/")[0] for f in one.inputFiles()}) == 1


def test_paged_files_without_page_text_fail(spark):
    files = spark.createDataFrame([("p", "p.pdf", 4, b"%PDF"), ("t", "t.txt", 1, b"x")], "document_id string, filename string, length long, content binary")
    none = spark.createDataFrame([], "document_id string, page int, text string")
    for pages in (None, none):
        done = ing.ingest(files, now(), pages=pages)
        assert rows(done.documents, "document_id", "status", "error_message") == [("p", "failed", ing.SCANNED_MESSAGE), ("t", "ready", None)]


def test_an_over_long_file_is_rejected_unread(spark, tmp_path):
    with open(tmp_path / "big.pdf", "wb") as f:
        f.truncate(3 * 2**30)  # sparse, and beyond what Spark loads into a row
    (tmp_path / "a.md").write_bytes(b"# T\nx")
    done = ing.ingest(scan_files(spark, str(tmp_path)), now())
    assert rows(done.rejected, "filename", "error_code") == [("big.pdf", "file_too_large")]
    assert rows(done.documents, "original_filename", "status") == [("a.md", "ready")]


def test_the_stream_reads_page_text_and_fails_files_without_it(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.pdf", "b.pdf"):
        (tmp_path / "in" / name).write_bytes(b"%PDF" + name.encode())
    ids = {r.filename: r.document_id for r in scan_files(spark, str(tmp_path / "in")).collect()}
    pages = spark.createDataFrame([(ids["a.pdf"], 1, "page text " * 10)], "document_id string, page int, text string")
    out = str(tmp_path / "out")
    arrivals.ingest_stream(spark, str(tmp_path / "in"), out, str(tmp_path / "progress"), pages=pages).awaitTermination()
    done = spark.read.parquet(f"{out}/documents")
    assert rows(done, "original_filename", "status") == [("a.pdf", "ready"), ("b.pdf", "failed")]


def test_a_reader_that_numbers_badly_fails_its_documents(spark):
    def skips(docs):
        return ing.segment.chunk_markdown(docs).withColumn("order", F.col("order") * 2)

    def repeats(docs):
        return ing.segment.chunk_plaintext(docs).withColumn("chunk_id", F.lit("same"))

    files = spark.createDataFrame(
        [(n, n, 9, b"# A\nb\n# C\nd" if n.endswith("md") else b"HEAD\nx\nTAIL\ny") for n in ("a.md", "b.txt")] + [("c.md", "c.md", 3, b"# A")],
        "document_id string, filename string, length long, content binary",
    )
    done = ing.ingest(files, now(), registry={"markdown": skips, "plain_text": repeats})
    assert rows(done.documents, "document_id", "status", "error_message") == [
        ("a.md", "failed", "Chunk ordering is not sequential."), ("b.txt", "failed", "Duplicate chunk_id found."), ("c.md", "ready", None)
    ]


def test_own_reader(spark):
    docs = spark.createDataFrame([("a", "markdown", "x")], "document_id string, format string, text string")
    mine = ing.readers() | {"markdown": lambda d: ing.segment.chunk_plaintext(d)}
    assert ing.chunk_by_format(docs, registry=mine).first().structural_context.section == "(document)"


def test_expiry_is_strict_and_cascades(spark):
    at = dt.datetime(2024, 5, 1)
    docs = spark.createDataFrame([("old", at - dt.timedelta(seconds=1)), ("now", at), ("none", None)], "document_id string, expires_at timestamp")
    kids = spark.createDataFrame([("old",), ("now",)], "document_id string")
    out = ing.purge_expired(docs, now(), chunks=kids, sessions=kids)
    assert rows(out.documents, "document_id") == [("none",), ("now",)]
    assert rows(out.dependents["chunks"]) == rows(out.dependents["sessions"]) == [("now",)]
    assert out.deleted.count() == 1


def events(spark, *items):
    return spark.createDataFrame(
        [(d, t, i, None, s, f"p{i}") for i, (d, t, s) in enumerate(items)],
        "document_id string, track string, seq long, ts timestamp, status string, payload string",
    )


def test_legal_life(spark):
    good = ["inferring_type", "awaiting_confirmation", "extracting", "verifying", "completed"]
    quality = ["analyzing", *QUALITY_PHASES, "completed", "analyzing", "failed", "analyzing"]
    e = events(spark, *[("a", "analysis", s) for s in good], *[("a", "quality", s) for s in quality])
    assert ss.check_moves(e).where("not legal").count() == 0
    bad = events(spark, ("a", "analysis", "extracting"), ("a", "analysis", "completed"), ("b", "quality", "completed"))
    assert ss.check_moves(bad).where("legal").count() == 0


def test_current_state(spark):
    e = events(spark, ("a", "analysis", "inferring_type"), ("a", "analysis", "failed"), ("b", "analysis", "completed"), ("b", "quality", "failed"), ("b", "quality", "analyzing"))
    assert rows(ss.current_sessions(e)) == [
        ("a", "failed", "p1", False, None, None, False),
        ("b", "completed", None, True, "analyzing", None, False),
    ]


def test_gates(spark):
    e = events(spark, ("done", "analysis", "completed"), ("busy", "analysis", "completed"), ("busy", "quality", "analyzing_ambiguities"), ("wait", "analysis", "awaiting_confirmation"))
    sessions = ss.current_sessions(e)
    docs = spark.createDataFrame([(d, "ready") for d in ("done", "busy", "wait", "new")] + [("raw", "processing")], "document_id string, status string")
    asked = spark.createDataFrame([(d,) for d in ("done", "busy", "wait", "new", "raw", "gone")], "document_id string")
    models = spark.createDataFrame([("done",)], "document_id string")
    verdicts = lambda df: dict(rows(df, "document_id", "verdict"))
    assert verdicts(ss.gate_analysis(asked, docs, sessions)) == {
        "done": "analysis_exists", "busy": "analysis_exists", "wait": "analysis_exists", "new": "ok", "raw": "document_not_ready", "gone": "not_found"
    }
    assert verdicts(ss.gate_quality(asked, docs, sessions)) == {
        "done": "ok", "busy": "analysis_in_progress", "wait": "km_not_completed", "new": "km_not_completed", "raw": "km_not_completed", "gone": "not_found"
    }
    assert verdicts(ss.quality_poll_state(asked, docs, sessions))["done"] == "not_triggered"
    query = verdicts(ss.gate_query(asked, docs, sessions, models))
    assert (query["done"], query["busy"], query["wait"], query["new"]) == ("ok", "model_not_found", "km_not_completed", "session_not_found")
    typed = asked.withColumn("document_type", F.when(F.col("document_id") == "done", "memo").otherwise("prd"))
    confirm = verdicts(ss.gate_confirm(typed, sessions))
    assert (confirm["done"], confirm["wait"], confirm["busy"], confirm["new"]) == ("invalid_document_type", "ok", "invalid_session_state", "not_found")


def test_arriving_files(spark, tmp_path):
    src, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.md").write_text(f"# h{i}\ntext")
    arrivals.ingest_stream(spark, src, out, progress, per_trigger=2).awaitTermination()
    (tmp_path / "in" / "late.txt").write_text("late")
    arrivals.ingest_stream(spark, src, out, progress, per_trigger=2).awaitTermination()
    docs = spark.read.parquet(f"{out}/documents")
    assert rows(docs, "original_filename") == [("0.md",), ("1.md",), ("2.md",), ("late.txt",)]
    assert docs.where("expires_at = upload_timestamp + interval 1 day").count() == 4
    assert spark.read.parquet(f"{out}/chunks").count() == 4
