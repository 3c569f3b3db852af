"""Stored tables written again, deleted from, compacted, and read while a run is half done."""

import pytest
from corpusloom.sources import store, tables
from pyspark.sql import functions as F

from tests.helpers import rows

DOCS = "document_id string, name string"
CHUNKS = "document_id string, order int, text string"


def docs(spark, *names):
    return spark.createDataFrame([(d, n) for d, n in names], DOCS)


def chunks(spark, *found):
    return spark.createDataFrame(list(found), CHUNKS)


@pytest.fixture
def path(spark, tmp_path):
    at = str(tmp_path / "store")
    store.replace(
        at,
        buckets=4,
        documents=docs(spark, *[(f"d{i}", "first") for i in range(20)]),
        chunks=chunks(spark, *[(f"d{i}", k, f"text {k}") for i in range(20) for k in range(3)]),
    )
    return at


def test_replace_puts_new_rows_in_place_of_old_ones(spark, path):
    before = store.latest(spark, path)
    store.replace(path, documents=docs(spark, ("d1", "second"), ("x", "new")), chunks=chunks(spark, ("x", 0, "new")))
    got = dict(rows(store.read(spark, path, "documents")))
    assert len(got) == 21 and got["d1"] == "second" and got["x"] == "new" and got["d2"] == "first"
    left = store.read(spark, path, "chunks")
    # d1 was written without chunks: its old ones are gone
    assert left.where("document_id = 'd1'").count() == 0 and left.count() == 19 * 3 + 1
    after = store.latest(spark, path)
    touched = spark.createDataFrame([("d1",), ("x",)], "k string").select(store.bucket("k", 4)).distinct().collect()
    same = [b for b in before.parts["documents"] if b not in {str(r[0]) for r in touched}]
    assert same and all(after.parts["documents"][b] == before.parts["documents"][b] for b in same)


def test_new_documents_rewrite_nothing(spark, path):
    before = store.latest(spark, path).parts["documents"]
    store.replace(path, documents=docs(spark, ("new", "n")), chunks=chunks(spark))
    after = store.latest(spark, path).parts["documents"]
    assert all(after[b][: len(before[b])] == before[b] for b in before)


def test_one_document_opens_one_bucket(spark, path):
    one = store.read(spark, path, "chunks", "d7")
    assert one.count() == 3
    assert {f.split("bucket=")[1].split("/")[0] for f in one.inputFiles()} == {
        str(spark.range(1).select(store.bucket(F.lit("d7"), 4)).first()[0])
    }


def test_half_a_run_is_invisible(spark, path, monkeypatch):
    def die(*args):
        raise KeyboardInterrupt

    monkeypatch.setattr(store, "_commit", die)
    with pytest.raises(KeyboardInterrupt):
        store.replace(path, documents=docs(spark, ("d1", "lost")), chunks=chunks(spark, ("d1", 0, "lost")))
    monkeypatch.undo()
    assert dict(rows(store.read(spark, path, "documents")))["d1"] == "first"
    assert store.read(spark, path, "chunks").count() == 60
    assert store.vacuum(spark, path) == 4  # two of new rows, two of what would have been left of the old ones
    assert store.read(spark, path, "chunks").count() == 60


def test_a_reader_keeps_its_version_until_vacuum(spark, path):
    old = store.read(spark, path, "documents")
    store.delete(spark, path, docs(spark, *[(f"d{i}", "") for i in range(20)]))
    assert store.read(spark, path, "documents").count() == 0 and old.count() == 20
    assert store.vacuum(spark, path) > 0
    assert store.read(spark, path, "documents").count() == 0
    assert len(store.latest(spark, path).parts) == 2


def test_second_writer_fails(spark, path, monkeypatch):
    behind = store.latest(spark, path)
    store.append(path, documents=docs(spark, ("a", "one")))
    monkeypatch.setattr(store, "latest", lambda *_: behind)
    with pytest.raises(RuntimeError, match="nothing was changed"):
        store.append(path, documents=docs(spark, ("b", "two")))
    monkeypatch.undo()
    assert store.read(spark, path, "documents").count() == 21


def test_append_and_compact(spark, path):
    for i in range(3):
        store.append(path, documents=docs(spark, *[(f"d{k}", f"more {i}") for k in range(20)]))
    want = rows(store.read(spark, path, "documents"))
    assert len(want) == 80
    store.compact(spark, path, most=2)
    assert rows(store.read(spark, path, "documents")) == want
    assert all(len(parts) == 1 for parts in store.latest(spark, path).parts["documents"].values())


def test_refused_tables(spark, path):
    with pytest.raises(ValueError, match="buckets"):
        store.append(path, 8, documents=docs(spark))
    with pytest.raises(ValueError, match="is stored as"):
        store.append(path, documents=docs(spark).withColumn("extra", F.lit(1)))
    with pytest.raises(ValueError, match="needs document_id"):
        store.append(path, other=spark.range(1))
    with pytest.raises(ValueError, match="no table"):
        store.read(spark, path, "absent")


def test_rows_of_a_bucket_are_sorted_by_document(spark, path):
    found = store.read(spark, path, "chunks").select("document_id", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"))
    files = {}
    for r in found.orderBy("i").collect():
        files.setdefault(r["f"], []).append(r["document_id"])
    assert files and all(ids == sorted(ids) for ids in files.values())


def test_purge_deletes_from_every_table(spark, tmp_path):
    at = str(tmp_path / "ir")
    records = spark.sql("SELECT 'a' document_id, 'ready' status, timestamp'2024-01-01' expires_at UNION ALL SELECT 'b', 'ready', timestamp'2024-03-01' UNION ALL SELECT 'c', 'ready', null")
    tables.write_ir(records, chunks(spark, ("a", 0, "x"), ("b", 0, "x"), ("c", 0, "x")), at)
    tables.add_session_events(spark.createDataFrame([("a", 1), ("b", 1)], "document_id string, seq long"), at)
    gone = tables.purge_stored(spark, at, F.lit("2024-03-01").cast("timestamp"))
    assert rows(gone, "document_id") == [("a",)]
    assert rows(store.read(spark, at, "documents"), "document_id") == [("b",), ("c",)]
    assert rows(store.read(spark, at, "chunks"), "document_id") == [("b",), ("c",)]
    assert rows(store.read(spark, at, "session_events"), "document_id") == [("b",)]
