import json
import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from corpusloom.functions import replies as rp
from corpusloom.operators import replies as rs
from corpusloom.plans import completion

COLUMNS = "document_id string, step string, segment int, question_id string, attempt int, prompt_version string, content string, model_id string, error string"


def replies(spark, step, *contents, question=True):
    data = [(f"d{i}", step, 0, f"q{i}" if question else None, 1, "v", c, "m", None) for i, c in enumerate(contents)]
    return spark.createDataFrame(data, COLUMNS)


def test_strict_json_equals_the_standard_parser(spark):
    rng, texts = random.Random(7), []
    good = ['{"a": [1, 2, {"b": null}]}', "[1, 2]", '"x"', "12", "true", "null", '{"é": "ñ"}', "[]", "{}", ""]
    for text in good:
        texts.append(text)
        for _ in range(40):
            i = rng.randint(0, len(text))
            texts.append(text[:i] + rng.choice(['"', "{", "}", "[", "]", ",", " ", "1", "x", ',"v":2', "]]", "}} x"]) + text[i:])
            texts.append(text[:i] + text[i + 1 :])

    def valid(text):
        try:
            seen = json.loads(text, object_pairs_hook=lambda p: p)
        except ValueError:
            return False
        return True if seen is not None or text.strip() == "null" else False

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", rp.strict_json("t").isNotNull().alias("ok"))
    wrong = [(r.t, r.ok) for r in df.collect() if r.ok != valid(r.t)]
    assert wrong == []


def test_the_last_of_repeated_keys_counts(spark):
    element = '{"id": "a", "id": "b", "type": "actor", "name": "n", "content": "c"}'
    out = rs.parse_elements(replies(spark, "extraction", '{"elements": 1, "elements": [' + element + "]}"))
    assert [r.id for r in out.elements.collect()] == ["b"] and out.failures.count() == 0


@pytest.mark.parametrize(
    "dialect, text, want",
    [
        ("first_line", "```json\n{}\n```", "{}"),
        ("first_line", "``` x y\n{}", "{}"),
        ("first_line", "```", ""),
        ("first_line", " {} ", "{}"),
        ("json_prefix", "```json{}```", "{}"),
        ("json_prefix", "```{}", "{}"),
        ("json_prefix", "{}```", "{}"),
        ("anywhere", "see\n```json\n{}\n``` end", "{}"),
        ("none", " ```x``` ", "```x```"),
    ],
)
def test_fences(spark, dialect, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(rp.strip_code_fence("t", dialect)).first()[0] == want


def test_bad_elements_go_alone(spark):
    ok = {"id": "1", "type": "actor", "name": "n", "content": "c"}
    items = [
        {**ok, "relations": [{"target_id": "2", "type": "contradicts"}, {"target_id": 2, "type": "contradicts"}, {"target_id": "2", "type": "likes"}, 5]},
        {**ok, "id": 5},
        {**ok, "type": "Actor"},
        {k: v for k, v in ok.items() if k != "name"},
        {**ok, "source_ref": None},
        {**ok, "source_ref": {"page": "x"}},
        {**ok, "source_ref": {"page": "3", "evidence": None}},
        {**ok, "id": "9", "source_ref": {"page": 3.0, "section": None, "evidence": "e"}, "relations": "none"},
        "text",
    ]
    out = rs.parse_elements(replies(spark, "extraction", json.dumps({"elements": items}), "[]", '{"elements": {}}', "{}"))
    assert rows(out.elements, "pos", "id", "source_ref.chunk_id", "source_ref.page", "source_ref.evidence") == [
        (0, "1", "unknown", None, ""),
        (7, "9", "unknown", 3, "e"),
    ]
    assert rows(out.relations, "source_id", "target_id", "type") == [("1", "2", "contradicts")]
    assert [r[0] for r in rows(out.failures)] == ["d1", "d2", "d3"]


def test_severity_rules_differ(spark):
    ref = {"chunk_id": "c", "evidence": "e"}
    clash = {"type": "contradiction", "description": "d", "severity": "odd", "affected_element_ids": [], "source_refs": [ref]}
    vague = {"id": "1", "category": "c", "description": "d", "severity": "odd", "source_ref": ref}
    found = rs.parse_contradictions(replies(spark, "contradiction", json.dumps({"findings": [clash]}), json.dumps({"findings": [{**clash, "description": "x" * 501}]})))
    assert rows(found.findings, "document_id", "severity") == [("d0", "medium")]
    assert [r[0] for r in rows(found.failures)] == ["d1"]
    unclear = rs.parse_ambiguities(replies(spark, "ambiguity", json.dumps({"ambiguities": [vague]}), json.dumps({"ambiguities": [{**vague, "severity": "low"}]})))
    assert [r[0] for r in rows(unclear.findings)] == ["d1"] and [r[0] for r in rows(unclear.failures)] == ["d0"]
    advice = rs.parse_suggestions(replies(spark, "suggestion", '{"suggestions": [{"priority": "odd"}]}', '{"suggestions": [{}]}', '{"suggestions": [{"source_refs": [{"evidence": "%s"}]}]}' % ("x" * 501)))
    assert rows(advice.findings, "document_id", "category", "priority") == [("d1", "structure", "medium")]
    assert [r[0] for r in rows(advice.failures)] == ["d0", "d2"]


def test_scores_fall_back(spark):
    q = spark.createDataFrame([(f"q{i}", f"d{i}") for i in range(4)], "question_id string, document_id string")
    out = rs.parse_scores(replies(spark, "scoring", '[{"id": "e", "score": 99}, {"id": "f"}]', "none", '{"id": "e"}'), q)
    assert rows(out.scores, "id", "score") == [("e", 10), ("f", 0)]
    assert [r[0] for r in rows(out.unscored)] == ["q1", "q2", "q3"]


def test_answers(spark):
    ref = {"chunk_id": "c", "evidence": "e"}
    texts = [
        'Sure: {"answer": "a } b", "answerable": true, "source_refs": []} and {more',
        '```json\n{"answer": "a", "answerable": 1}\n```',
        '```json\n{"answer": "a", "answerable": 1} x\n```',
        json.dumps({"answer": "x" * 5001, "answerable": True}),
        json.dumps({"answer": "a", "answerable": True, "source_refs": [ref] * 11}),
        json.dumps({"answer": "a", "answerable": True, "source_refs": [{**ref, "evidence": "x" * 501}]}),
        '["a"]',
        "  ",
        '{"answer": "a", "answerable": "maybe"}',
        json.dumps({"answer": "a", "answerable": False, "source_refs": [ref] * 10, "extra": 1}),
    ]
    out = rs.parse_answers(replies(spark, "answer", *texts))
    assert rows(out.answers, "question_id", "answerable") == [("q0", True), ("q1", True), ("q9", False)]
    assert out.refs.count() == 10
    assert out.failures.count() == 7


def test_partials(spark):
    docs = spark.createDataFrame([(f"d{i}", "prd") for i in range(4)], "document_id string, document_type string")
    texts = ['{"assessments": [{"classification": "PARTIAL", "severity": "odd"}]}', "bad", "{}", '{"assessments": [{"classification": null}]}']
    out = rs.parse_partials(replies(spark, "completeness", *texts), docs)
    assert rows(out.rows, "document_id", "expected_element", "severity") == [("d0", "unknown", "medium")]
    assert [r[0] for r in rows(out.failures)] == ["d3"]


def prompts(spark, *texts):
    return spark.createDataFrame(
        [(f"d{i}", "answer", 0, f"q{i}", 1, tier, "v", t) for i, (tier, t) in enumerate(texts)],
        "document_id string, step string, segment int, question_id string, attempt int, tier string, prompt_version string, prompt string",
    )


def test_fallback_and_credentials(spark):
    def fn(model, prompt, temperature):
        if prompt == "auth":
            raise completion.AuthError("no")
        if prompt == "down" or (prompt == "busy" and model != "fallback"):
            raise completion.TransientError("wait")
        if prompt == "bug":
            raise ValueError("x")
        return f"{model}/{prompt}"

    asked = prompts(spark, ("primary", "hi"), ("light", "hi"), ("primary", "busy"), ("primary", "down"), ("primary", "auth"), ("light", "bug"))
    assert rows(completion.complete(asked, fn), "question_id", "content", "model_id", "error") == [
        ("q0", "primary/hi", "primary", None),
        ("q1", "light/hi", "light", None),
        ("q2", "fallback/busy", "fallback", None),
        ("q3", None, "fallback", "transient: wait"),
        ("q4", None, "primary", "auth: no"),
        ("q5", None, "light", "ValueError: x"),
    ]


def test_prompts_are_dealt_out(spark):
    asked = prompts(spark, *[("primary", f"p{i}") for i in range(1000)])
    done = completion.complete(asked, lambda model, prompt, temperature: prompt, calls=completion.Calls(16, 4))
    got = done.select("question_id", "content", F.spark_partition_id().alias("task")).collect()
    assert {(r.question_id, r.content) for r in got} == {(f"q{i}", f"p{i}") for i in range(1000)}
    assert len(got) == 1000 and len({r.task for r in got}) == 16


def test_one_retry(spark):
    def fn(model, prompt, temperature):
        if "could not be used" in prompt:
            return '{"answer": "second", "answerable": true}' if prompt.startswith("mend") else "still bad"
        return '{"answer": "first", "answerable": true}' if prompt == "good" else "bad"

    asked = prompts(spark, ("primary", "good"), ("primary", "mend"), ("primary", "never"))
    out = completion.retry_unparsed(asked, completion.complete(asked, fn), fn)
    assert rows(out.answers, "question_id", "answer", "attempt") == [("q0", "first", 1), ("q1", "second", 2)]
    assert rows(out.failures, "question_id", "attempt") == [("q2", 2)]


def test_types(spark):
    out = rs.parse_types(replies(spark, "type", '{"document_type": "prd", "justification": "j"}', '{"document_type": "generic"}', '{"document_type": "x"}', "?", "[]"))
    assert rows(out.rows, "document_id", "document_type", "suggested_type") == [
        ("d0", "prd", "prd"), ("d1", None, "generic"), ("d2", None, "generic"), ("d3", None, "generic")
    ]
    assert [r[0] for r in rows(out.failures)] == ["d4"]
    assert out.rows.where(F.length("justification") > 5).count() == 2
