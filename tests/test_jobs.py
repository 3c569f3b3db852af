"""The composed jobs with a scripted model."""

import json

from helpers import rows
from pyspark.sql import functions as F
from test_graph import els

from corpusloom.model import type_schema
from corpusloom.operators.segment import chunk_markdown
from corpusloom.plans import analysis, completion

TEXT = "# Goal\nThe portal lets staff file requests.\n# Rules\nRequests close after thirty days."
ELEMENTS = [
    {
        "id": "e1", "type": "proposito", "name": " Goal ", "content": "file requests",
        "source_ref": {"chunk_id": "chunk-000", "evidence": "lets staff  file requests"},
        "relations": [{"target_id": "e2", "type": "contradicts", "description": "x"}, {"target_id": "zz", "type": "depends_on"}],
    },
    {"id": "e2", "type": "regla", "name": "Closing", "content": "thirty days", "source_ref": {"chunk_id": "chunk-000", "evidence": "Requests close after thirty days"}},
    {"id": "e3", "type": "actor", "name": "Staff", "content": "people", "source_ref": {"chunk_id": "chunk-001", "evidence": "nothing of the kind at all"}},
]
REF = {"chunk_id": "chunk-000", "evidence": "The portal lets staff"}


def test_a_document_over_the_limit_in_one_segment_is_still_deduplicated(spark):
    """Three pieces of ten characters join to 32, over the limit of 31, yet their sizes add up to 30."""
    chunks = spark.createDataFrame([(d, i, "x" * n) for d, n in (("over", 10), ("under", 9)) for i in range(3)], "document_id string, order int, text string")
    data = [(d, f"e{i}", i, "actor", "Staff", "c") for d in ("over", "under") for i in range(2)]
    elements = spark.createDataFrame(data, "document_id string, id string, pos long, type string, name string, content string")
    edges = spark.createDataFrame([], "document_id string, source_id string, target_id string, type string, description string, element_pos long")
    out = analysis.merge_segments(elements, edges, chunks, limit=31).elements
    assert rows(out, "document_id", "id") == [("over", "e0"), ("under", "e0"), ("under", "e1")]


def scripted():
    """Made inside a function, so that it travels to the workers by value."""

    def model(name, prompt, temperature):
        if prompt.startswith("Decide"):
            return '{"document_type": "prd", "justification": "goals"}'
        if prompt.startswith("Extract"):
            return "no json" if "broken" in prompt else "```json\n" + json.dumps({"elements": ELEMENTS}) + "\n```"
        if prompt.startswith("Find statements"):
            raise completion.TransientError("busy")
        if prompt.startswith("Find undefined"):
            return json.dumps({"ambiguities": [{"id": "m1", "category": "c", "description": "vague", "severity": "high", "affected_element_ids": ["e3"], "source_ref": REF}]})
        if prompt.startswith("Judge"):
            return '{"assessments": [{"expected_element_name": "usuarios/actores", "classification": "partial", "severity": "low"}]}'
        if prompt.startswith("Suggest"):
            assert "m1" in prompt and "contra-struct-" in prompt and "miss-" in prompt
            return '{"suggestions": [{"id": "s1", "description": "say who", "related_finding_ids": ["m1"]}]}'
        if prompt.startswith("Score"):
            return '[{"id": "e1", "score": 9}, {"id": "e3", "score": 0}]' if "goal" in prompt else "[]"
        return json.dumps({"answer": "It files requests.", "answerable": True, "source_refs": [REF, {"chunk_id": "c", "evidence": "made up entirely, no trace"}]})

    return model


def corpus(spark):
    docs = spark.createDataFrame([("a", TEXT), ("b", "# broken\ntext")], "document_id string, text string")
    info = docs.select("document_id", F.lit("markdown").alias("format"))
    return info, chunk_markdown(docs)


def test_types_extraction_quality_and_answers(spark):
    model = scripted()
    docs, chunks = corpus(spark)
    types = analysis.infer_types(chunks, model).rows
    assert rows(types, "document_id", "suggested_type") == [("a", "prd"), ("b", "prd")]

    out = analysis.analyse(docs, chunks, types, model)
    assert rows(out.elements, "id", "name", "verified", "source_ref.section") == [
        ("e1", "Goal", True, "# Goal"), ("e2", "Closing", True, "# Goal"), ("e3", "Staff", False, "# Rules")
    ]
    assert rows(out.relations, "source_id", "target_id") == [("e1", "e2"), ("e2", "e1")]
    assert [r[0] for r in rows(out.failures)] == ["b"]
    assert rows(out.summary, "document_id", "element_count", "relationship_count", "lacks_purpose") == [("a", 3, 2, False)]
    assert round(out.summary.first().verification_rate, 3) == 0.667

    typed = types.select("document_id", "document_type").where("document_id = 'a'")
    done = analysis.assess_quality(typed, out.elements, out.relations, chunks, type_schema(spark), model)
    assert rows(done.findings, "type", "severity", "involves_unverified_elements", "all_evidence_unverified") == [
        ("ambiguity", "high", True, False), ("contradiction", "high", False, False)
    ]
    # The contradiction call failed, the explicit one stays and the document is assessed.
    assert done.failures.count() == 0
    result = done.results.first()
    assert (result.contradictions, result.ambiguities, result.missing_elements) == (1, 1, 5)
    run = result.metadata
    assert run.model_id == "primary" and run.document_type == "prd" and run.started_at <= run.completed_at
    assert run.prompt_versions["suggestion_generation"] == "suggestion-v1"
    assert run.finding_counts["missing_elements"] == 5
    covered = {f for r in done.suggestions.collect() for f in r.related_finding_ids}
    high = {r.finding_id for r in done.findings.where("severity = 'high'").collect()}
    assert high <= covered

    questions = spark.createDataFrame(
        [("q1", "a", "what goal"), ("q2", "a", "weather"), ("q3", "b", "goal")], "question_id string, document_id string, question string"
    )
    said = analysis.answer_questions(questions, out.elements, out.relations, chunks, model, F.lit("2024-05-01").cast("timestamp"))
    assert rows(said.answers, "question_id", "answerable", "all_evidence_unverified", "model_id") == [
        ("q1", True, False, "primary"), ("q2", False, False, "none"), ("q3", False, False, "none")
    ]
    assert rows(said.refs, "ref_pos", "evidence_verified") == [(0, True), (1, False)]
    assert said.failures.count() == 0


def test_a_reply_that_never_came_fails_its_document(spark):
    docs = spark.createDataFrame([("a", "prd"), ("b", "generic")], "document_id string, document_type string")
    e = els(spark, ("1", "proposito", "Propósito", True)).unionByName(els(spark, ("1", "actor", "zzz", True), doc="b"))
    reply = "document_id string, step string, content string, error string"
    every = [(d, step, text, None) for d in "ab" for step, text in (("ambiguity", '{"ambiguities": []}'), ("completeness", "{}"), ("suggestion", '{"suggestions": []}'))]
    catalogue = type_schema(spark)

    def failures(replies):
        got = analysis.phase_failures(docs, e, catalogue, spark.createDataFrame(replies, reply))
        return rows(got, "document_id", "error_phase", "error_message")

    assert failures(every) == []
    # nothing is asked about the completeness of a generic document; the contradiction call may be missing
    assert failures([r for r in every if r[:2] != ("b", "completeness")]) == []
    assert failures([r for r in every if r[:2] != ("a", "completeness")]) == [("a", "analyzing_completeness", "no reply")]
    assert failures([r for r in every if r[1] != "ambiguity"]) == [(d, "analyzing_ambiguities", "no reply") for d in "ab"]
    refused = [r for r in every if r[:2] != ("b", "suggestion")] + [("b", "suggestion", None, "auth: key")]
    assert failures(refused) == [("b", "generating_suggestions", "auth: key")]
