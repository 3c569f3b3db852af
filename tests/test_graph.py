import pytest
from helpers import rows

from corpusloom.operators import graph as g

REF = "struct<chunk_id string, page int, section string, evidence string>"
ELS = f"document_id string, pos long, id string, type string, name string, content string, source_ref {REF}, verified boolean"
RELS = "document_id string, element_pos long, pos int, source_id string, target_id string, type string, description string"


def els(spark, *items, doc="a"):
    data = [(doc, i, id_, type_, name, f"about {name}", ("chunk-000", None, None, f"ev {name}"), ok) for i, (id_, type_, name, ok) in enumerate(items)]
    return spark.createDataFrame(data, ELS)


def rels(spark, *edges, doc="a"):
    return spark.createDataFrame([(doc, *e) for e in edges], RELS)


@pytest.fixture()
def abc(spark):
    return els(spark, ("e1", "actor", "A", True), ("e2", "regla", "B", False), ("e3", "concepto", "C", True))


def test_dangling_edges_go(spark, abc):
    r = rels(spark, (0, 0, "e1", "e2", "depends_on", None), (0, 1, "e1", "zz", "depends_on", None))
    assert rows(g.drop_dangling(r, abc), "target_id") == [("e2",)]
    other = els(spark, ("zz", "actor", "Z", True), doc="b")
    assert rows(g.drop_dangling(r, abc.unionByName(other)), "target_id") == [("e2",)]


def test_contradictions_become_mutual_once(spark, abc):
    r = rels(
        spark,
        (0, 0, "e1", "e2", "contradicts", "why"),
        (1, 0, "e2", "e3", "contradicts", None),
        (2, 0, "e3", "e2", "contradicts", None),
        (2, 1, "e3", "e3", "contradicts", None),
    )
    out = g.symmetrize_contradicts(abc, r)
    want = [("e1", "e2", "why"), ("e2", "e1", None), ("e2", "e3", None), ("e3", "e2", None), ("e3", "e3", None)]
    assert rows(out.relations, "source_id", "target_id", "description") == want
    again = g.symmetrize_contradicts(out.elements, out.relations)
    assert rows(again.relations, "source_id", "target_id", "description") == want


def test_repeated_ids_keep_the_last_content_at_the_first_place(spark):
    e = els(spark, ("x", "actor", "old", True), ("y", "actor", "other", True), ("x", "regla", "new", True))
    r = rels(spark, (0, 0, "x", "y", "contradicts", "lost"), (2, 0, "x", "y", "depends_on", None))
    out = g.symmetrize_contradicts(e, r)
    assert rows(out.elements, "pos", "id", "name") == [(0, "x", "new"), (1, "y", "other")]
    # The dropped edge still asks for its reverse.
    assert rows(out.relations, "element_pos", "source_id", "target_id", "type") == [
        (0, "x", "y", "depends_on"),
        (1, "y", "x", "contradicts"),
    ]


def test_first_of_a_name_and_type_is_kept(spark):
    e = els(spark, ("1", "actor", " Ana ", True), ("2", "actor", "ANA", True), ("3", "regla", "ana", True))
    out = g.dedupe_elements(e, rels(spark, (1, 0, "2", "3", "depends_on", None)))
    assert rows(out.elements, "id") == [("1",), ("3",)]
    assert out.relations.count() == 0


def test_one_finding_per_pair(spark, abc):
    r = rels(
        spark,
        (0, 0, "e1", "e2", "contradicts", None),
        (1, 0, "e2", "e1", "contradicts", "later"),
        (2, 0, "e3", "e3", "contradicts", "x" * 600),
        (2, 1, "e3", "gone", "contradicts", None),
    )
    found, refs = g.structural_contradictions(abc, r)
    got = rows(found, "affected_element_ids", "description", "severity", "involves_unverified_elements")
    assert got == [
        (["e1", "e2"], "Element 'A' contradicts element 'B'.", "high", True),
        (["e3", "e3"], "x" * 500, "high", False),
    ]
    assert rows(refs, "ref_pos", "evidence") == [(0, "ev A"), (0, "ev C"), (1, "ev B"), (1, "ev C")]


def test_place_of_the_cited_chunk_wins_unless_empty(spark):
    e = els(spark, ("1", "actor", "A", True))
    e = e.withColumn("source_ref", e.source_ref.withField("page", __import__("pyspark.sql.functions").sql.functions.lit(7)))
    ctx = "document_id string, chunk_id string, structural_context struct<page int, section string>"

    def page(fmt, value):
        docs = spark.createDataFrame([("a", fmt)], "document_id string, format string")
        chunks = spark.createDataFrame([("a", "chunk-000", (value, "s"))], ctx)
        return g.enrich_source_refs(e, chunks, docs).first().source_ref

    assert page("pdf", 3).page == 3 and page("pdf", 0).page == 7 and page("plain_text", 3).page == 7
    assert page("markdown", 3).section == "s" and page("pdf", 3).section is None


def test_type_groups_and_listings(spark, abc):
    docs = spark.createDataFrame([("a",), ("none",)], "document_id string")
    groups = rows(g.elements_by_type(docs, abc).where("document_id = 'a'"), "type_pos", "type", "element_count")
    assert groups == [(0, "proposito", 0), (1, "concepto", 1), (2, "actor", 1), (3, "regla", 1), (4, "proceso", 0), (5, "restriccion", 0)]
    assert rows(g.lacks_purpose(docs, abc)) == [("a", True), ("none", True)]
    r = rels(spark, (0, 0, "e1", "e2", "contradicts", None), (0, 1, "e1", "e9", "depends_on", None), (0, 2, "e1", "e2", "contradicts", "again"))
    assert rows(g.relationship_list(abc, r), "source_name", "type", "target_name") == [
        ("A", "contradicts", "B"), ("A", "contradicts", "B"), ("A", "depends_on", "e9")
    ]
    assert rows(g.edge_set(r), "source_id", "target_id", "type") == [
        ("e1", "e2", "contradicts"), ("e1", "e9", "depends_on"), ("e2", "e1", "contradicts")
    ]
