"""Parsing the responses table into the library's tables.

Each reply is judged and read inside its own row; replies that break their contract come back as failure rows, never as
an exception. Row shapes follow FIXTURES section 2.

`judge` parses every reply once, whatever its step, and says whether it keeps its contract. Each parser takes the table of
responses, or better the judged one, stored: elements, edges, references and failures are then read from the same rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import replies as R
from corpusloom.functions.text import clamp_score, owner_key, stable_id, strip
from corpusloom.model import (
    DOCUMENT_TYPES,
    ELEMENT_TYPES,
    MAX_ANSWER_CHARS,
    MAX_ANSWER_REFS,
    MAX_DESCRIPTION_CHARS,
    MAX_EVIDENCE_CHARS,
    MAX_SUGGESTION_CHARS,
    RELATION_TYPES,
    SEVERITIES,
    SUGGESTION_CATEGORIES,
)
from corpusloom.session import REPLY_SETTINGS

SEGMENT_STRIDE = 1_000_000_000

# --- Fixed values -------------------------------------------------------------------------------------------------

UNPARSED_TYPE = "Could not parse LLM response; defaulting to generic classification."
UNKNOWN_TYPE = "Unrecognized document type; defaulting to generic."
PARTIAL_TEXT = "Element partially covers the expected content."


class ParsedElements(NamedTuple):
    elements: DataFrame
    relations: DataFrame
    failures: DataFrame


class ParsedScores(NamedTuple):
    scores: DataFrame
    unscored: DataFrame


class ParsedFindings(NamedTuple):
    findings: DataFrame
    refs: DataFrame
    failures: DataFrame


class ParsedRows(NamedTuple):
    rows: DataFrame
    failures: DataFrame


class ParsedAnswers(NamedTuple):
    answers: DataFrame
    refs: DataFrame
    failures: DataFrame


def of_step(responses: DataFrame, step: str) -> DataFrame:
    """Replies of one step (calls that failed have no content)."""
    return responses.where((F.col("step") == step) & F.col("content").isNotNull())


def _bound(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Add a column that is computed once per row.

    A plain derived column would be repeated inside every filter pushed below it; a generator is not looked through.
    """
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _failed(rows: DataFrame, message: str, *keys: str) -> DataFrame:
    return rows.where("NOT _ok").select(*keys, F.lit(message).alias("error_message"))


def judge(responses: DataFrame) -> DataFrame:
    """Responses with the parsed reply `_v`, its list of items `_items` and the verdict `_ok`.

    The session must let the last of repeated keys count (`session.REPLY_SETTINGS`), as parsing would refuse them.
    """
    conf = responses.sparkSession.conf
    for name, value in REPLY_SETTINGS.items():
        if str(conf.get(name)).lower() != value:
            raise ValueError(f"replies are read with {name}={value}; set it on the session")
    step, plain = F.col("step"), strip("content")
    fenced = lambda kind: R.strip_code_fence("content", kind)
    text = F.when(step.isin("extraction", "scoring", "suggestion"), fenced("first_line"))
    text = text.when(step == "ambiguity", fenced("json_prefix")).otherwise(plain)
    value = F.when(step == "answer", R.answer_object("content")).otherwise(R.strict_json(text))
    rows = _bound(responses, F.when(F.col("content").isNotNull(), value), "_v")
    v, items = F.col("_v"), F.col("_items")

    listed = F.try_variant_get(v, "$", "array<variant>")
    found = F.when(step == "scoring", listed).when(step == "completeness", _assessments(v))
    for name, field in LISTS.items():
        found = found.when(step == name, R.items_at(v, field))
    rows = _bound(rows, found, "_items")

    ok = F.when(step == "type", v.isNull() | R.is_object(v)).when(step == "extraction", items.isNotNull())
    for name, item_ok in ITEM_RULES.items():
        ok = ok.when(step == name, R.all_items(items, item_ok))
    ok = ok.when(step == "answer", _answer_ok(v))
    return rows.withColumn("_ok", F.coalesce(F.col("content").isNotNull() & ok, F.lit(False)))


def _judged(responses: DataFrame, step: str) -> DataFrame:
    rows = of_step(responses, step)
    return rows if "_ok" in responses.columns else judge(rows)


def parse_types(responses: DataFrame) -> ParsedRows:
    """Type suggestions; unreadable, unknown and `generic` replies suggest `generic` without a type."""
    rows = _judged(responses, "type")
    named = F.when(R.is_text(F.col("_v"), "document_type"), R.text_at(F.col("_v"), "document_type"))
    known = F.coalesce(named.isin(DOCUMENT_TYPES), F.lit(False))
    given = F.coalesce(R.text_at(F.col("_v"), "justification"), F.lit(""))
    reason = F.when(F.col("_v").isNull(), UNPARSED_TYPE).when(~known & (given == ""), UNKNOWN_TYPE).otherwise(given)
    sure = known & (named != "generic")
    parsed = rows.where("_ok").select(
        "document_id",
        F.when(sure, named).alias("document_type"),
        F.when(sure, named).otherwise("generic").alias("suggested_type"),
        reason.alias("justification"),
    )
    return ParsedRows(parsed, _failed(rows, "Type reply is not a JSON object.", "document_id"))


def _ref_fields(v: Column, default_chunk: str | None = None) -> list[Column]:
    chunk, evidence = R.text_at(v, "chunk_id"), R.text_at(v, "evidence")
    if default_chunk is not None:
        chunk, evidence = F.coalesce(chunk, F.lit(default_chunk)), F.coalesce(evidence, F.lit(""))
    return [
        chunk.alias("chunk_id"),
        R.int_at(v, "page").alias("page"),
        R.text_at(v, "section").alias("section"),
        evidence.alias("evidence"),
    ]


def _ref_ok(v: Column, limit: int | None, required: bool = True) -> Column:
    text = R.is_text if required else R.text_or_absent
    return (
        R.is_object(v)
        & text(v, "chunk_id")
        & text(v, "evidence", limit)
        & R.is_optional_int(v, "page")
        & R.is_optional_text(v, "section")
    )


def _refs(rows: DataFrame, keys: list[str], owner: Column, items: Column, default_chunk: str | None = None) -> DataFrame:
    read = F.transform(items, lambda r: F.struct(*_ref_fields(r, default_chunk)))
    return rows.select(*keys, owner.alias("owner_id"), F.posexplode(read).alias("ref_pos", "r")).select(
        *keys, "owner_id", "ref_pos", "r.*", F.lit(False).alias("evidence_verified")
    )


def _element_ok(e: Column) -> Column:
    ref = R.at(e, "source_ref")
    fields = R.is_object(e)
    for name in ("id", "type", "name", "content"):
        fields = fields & R.is_text(e, name)
    return fields & R.text_at(e, "type").isin(ELEMENT_TYPES) & (ref.isNull() | _ref_ok(ref, None, required=False))


def _relation_ok(r: Column) -> Column:
    return (
        R.is_object(r)
        & R.is_text(r, "target_id")
        & R.is_text(r, "type")
        & R.text_at(r, "type").isin(RELATION_TYPES)
        & R.is_optional_text(r, "description")
    )


def parse_elements(responses: DataFrame) -> ParsedElements:
    """Elements and edges of extraction replies.

    A reply that is no JSON object with a list of elements fails its document; a bad element or edge is dropped alone.
    """
    rows = _judged(responses, "extraction")
    each = rows.where("_ok").select("document_id", "segment", F.posexplode("_items").alias("_i", "e"))
    good = each.where(F.coalesce(_element_ok(F.col("e")), F.lit(False)))
    e = F.col("e")
    pos = (F.coalesce("segment", F.lit(0)).cast("long") * SEGMENT_STRIDE + F.col("_i")).alias("pos")
    ref = R.at(e, "source_ref")
    elements = good.select(
        "document_id",
        pos,
        *[R.text_at(e, n).alias(n) for n in ("id", "type", "name", "content")],
        F.struct(*_ref_fields(ref, "unknown")).alias("source_ref"),
        F.lit(False).alias("verified"),
    )
    edges = F.filter(F.coalesce(R.items_at(e, "relations"), F.array().cast("array<variant>")), _relation_ok)
    relations = good.select(
        "document_id",
        pos.alias("element_pos"),
        R.text_at(e, "id").alias("source_id"),
        F.posexplode(edges).alias("pos", "r"),
    ).select(
        "document_id",
        "element_pos",
        "pos",
        "source_id",
        *[R.text_at(F.col("r"), n).alias(n) for n in ("target_id", "type", "description")],
    )
    message = "Complete parse failure: reply is not a JSON object with a list of elements."
    return ParsedElements(elements, relations, _failed(rows, message, "document_id").distinct())


def _score_ok(s: Column) -> Column:
    number = R.kind(R.at(s, "score"))
    numeric = number.isin("BIGINT", "DOUBLE", "BOOLEAN") | F.startswith(number, F.lit("DECIMAL"))
    written = (number == "STRING") & F.trim(R.text_at(s, "score")).rlike(r"\A[+-]?\d+\z")
    return R.is_object(s) & F.coalesce(numeric | written, F.lit(True))


def parse_scores(responses: DataFrame, questions: DataFrame | None = None) -> ParsedScores:
    """Scores per question and element; questions whose reply (or call) failed are listed as unscored."""
    keys = ["question_id", "document_id"]
    rows = _judged(responses, "scoring")
    scores = (
        rows.where("_ok")
        .select(*keys, F.posexplode("_items").alias("pos", "s"))
        .select(
            *keys,
            "pos",
            F.coalesce(R.text_at(F.col("s"), "id"), F.lit("")).alias("id"),
            clamp_score(F.try_variant_get("s", "$.score", "double")).alias("score"),
        )
    )
    if questions is None:
        return ParsedScores(scores, rows.where("NOT _ok").select(*keys))
    scored = rows.where("_ok").select(*keys)
    return ParsedScores(scores, questions.select(*keys).join(scored, keys, "left_anti"))


def _finding_columns(type_: str, description: Column, severity: Column, affected: Column) -> list[Column]:
    return [
        F.lit(type_).alias("type"),
        description.alias("description"),
        severity.alias("severity"),
        affected.alias("affected_element_ids"),
        F.lit(False).alias("involves_unverified_elements"),
        F.lit(False).alias("all_evidence_unverified"),
        F.lit(False).alias("from_explicit_relationship"),
    ]


def _contradiction_ok(f: Column) -> Column:
    return (
        R.is_object(f)
        & R.is_text(f, "type")
        & R.is_text(f, "description", MAX_DESCRIPTION_CHARS)
        & R.is_text(f, "severity")
        & R.is_text_list(f, "affected_element_ids")
        & R.all_items(R.items_at(f, "source_refs"), lambda r: _ref_ok(r, MAX_EVIDENCE_CHARS))
    )


def parse_contradictions(responses: DataFrame) -> ParsedFindings:
    """Model contradictions. One field out of shape or too long fails the reply; an unknown severity becomes medium."""
    rows = _judged(responses, "contradiction")
    each = rows.where("_ok").select("document_id", F.posexplode("_items").alias("_i", "f"))
    each = each.withColumns({"finding_id": stable_id("contra-llm-", "document_id", "_i"), "owner": owner_key("contradiction", "_i")})
    f = F.col("f")
    severity = R.text_at(f, "severity")
    findings = each.select(
        "document_id",
        "finding_id",
        "owner",
        F.array(F.lit(1).cast("long"), F.col("_i").cast("long")).alias("ord"),
        *_finding_columns(
            "contradiction",
            R.text_at(f, "description"),
            F.when(severity.isin(SEVERITIES), severity).otherwise("medium"),
            R.texts_at(f, "affected_element_ids"),
        ),
    )
    refs = _refs(each, ["document_id", "owner"], F.col("finding_id"), R.items_at(f, "source_refs"))
    return ParsedFindings(findings, refs, _failed(rows, "Contradiction reply breaks its contract.", "document_id"))


def _ambiguity_ok(f: Column) -> Column:
    return (
        R.is_object(f)
        & R.is_text(f, "id")
        & R.is_text(f, "category")
        & R.is_text(f, "description", MAX_DESCRIPTION_CHARS)
        & R.is_text(f, "severity")
        & R.text_at(f, "severity").isin(SEVERITIES)
        & (~R.has(f, "affected_element_ids") | R.is_text_list(f, "affected_element_ids"))
        & _ref_ok(R.at(f, "source_ref"), MAX_EVIDENCE_CHARS)
    )


def parse_ambiguities(responses: DataFrame) -> ParsedFindings:
    """Ambiguities with exactly one reference each; an unknown severity fails the reply. Ids are kept as given."""
    rows = _judged(responses, "ambiguity")
    each = rows.where("_ok").select("document_id", F.posexplode("_items").alias("_i", "f"))
    each = each.withColumn("owner", owner_key("ambiguity", "_i"))
    f = F.col("f")
    findings = each.select(
        "document_id",
        R.text_at(f, "id").alias("finding_id"),
        "owner",
        F.array(F.lit(2).cast("long"), F.col("_i").cast("long")).alias("ord"),
        *_finding_columns(
            "ambiguity", R.text_at(f, "description"), R.text_at(f, "severity"), R.texts_at(f, "affected_element_ids")
        ),
    )
    refs = _refs(each, ["document_id", "owner"], R.text_at(f, "id"), F.array(R.at(f, "source_ref")))
    return ParsedFindings(findings, refs, _failed(rows, "Ambiguity reply breaks its contract.", "document_id"))


def _assessments(v: Column) -> Column:
    """The listed assessments; none where the reply is no JSON or does not list any, null where it is something else."""
    none = F.array().cast("array<variant>")
    listed = F.when(R.has(v, "assessments"), R.items_at(v, "assessments")).otherwise(none)
    return F.when(v.isNull(), none).when(R.is_object(v), listed)


def _assessment_ok(a: Column) -> Column:
    return (
        R.is_object(a)
        & R.text_or_absent(a, "classification")
        & (
            (F.lower(F.coalesce(R.text_at(a, "classification"), F.lit(""))) != "partial")
            | (R.text_or_absent(a, "expected_element_name") & R.text_or_absent(a, "description"))
        )
    )


def parse_partials(responses: DataFrame, documents: DataFrame) -> ParsedRows:
    """Expectations the model calls partly covered. Text that is no JSON means none; a bad severity becomes medium."""
    rows = _judged(responses, "completeness")
    a = F.col("a")
    severity = F.when(R.has(a, "severity"), R.text_at(a, "severity")).otherwise("medium")
    partial = (
        rows.where("_ok")
        .select("document_id", F.posexplode("_items").alias("_i", "a"))
        .where(F.lower(R.text_at(a, "classification")) == "partial")
        .join(documents.select("document_id", "document_type"), "document_id")
        .select(
            "document_id",
            stable_id("miss-", "document_id", F.lit("partial"), "_i").alias("finding_id"),
            owner_key("partial", "_i").alias("owner"),
            F.array(F.lit(1).cast("long"), F.col("_i").cast("long")).alias("ord"),
            F.lit("partial").alias("classification"),
            F.coalesce(R.text_at(a, "expected_element_name"), F.lit("unknown")).alias("expected_element"),
            F.coalesce(R.text_at(a, "description"), F.lit(PARTIAL_TEXT)).alias("description"),
            F.when(severity.isin(SEVERITIES), severity).otherwise("medium").alias("severity"),
            F.col("document_type").alias("schema_reference"),
        )
    )
    return ParsedRows(partial, _failed(rows, "Completeness reply breaks its contract.", "document_id"))


def _suggestion_ok(s: Column) -> Column:
    def in_domain(name: str, domain: list[str]) -> Column:
        return ~R.has(s, name) | (R.is_text(s, name) & R.text_at(s, name).isin(domain))

    refs = R.items_at(s, "source_refs")
    return (
        R.is_object(s)
        & R.text_or_absent(s, "id")
        & R.text_or_absent(s, "description", MAX_SUGGESTION_CHARS)
        & in_domain("category", SUGGESTION_CATEGORIES)
        & in_domain("priority", SEVERITIES)
        & (~R.has(s, "related_finding_ids") | R.is_text_list(s, "related_finding_ids"))
        & (~R.has(s, "source_refs") | R.all_items(refs, lambda r: _ref_ok(r, MAX_EVIDENCE_CHARS, required=False)))
    )


def parse_suggestions(responses: DataFrame) -> ParsedFindings:
    """Suggestions with defaults filled in; one invalid item fails the reply."""
    rows = _judged(responses, "suggestion")
    s = F.col("s")
    each = rows.where("_ok").select("document_id", F.posexplode("_items").alias("_i", "s"))
    named = F.coalesce(R.text_at(s, "id"), stable_id("sug-", "document_id", "_i"))
    each = each.withColumns({"suggestion_id": named, "owner": owner_key("suggestion", "_i")})
    suggestions = each.select(
        "document_id",
        "suggestion_id",
        "owner",
        F.col("_i").cast("long").alias("pos"),
        F.coalesce(R.text_at(s, "description"), F.lit("")).alias("description"),
        F.coalesce(R.text_at(s, "category"), F.lit("structure")).alias("category"),
        F.coalesce(R.text_at(s, "priority"), F.lit("medium")).alias("priority"),
        R.texts_at(s, "related_finding_ids").alias("related_finding_ids"),
        F.lit(False).alias("all_evidence_unverified"),
    )
    items = F.coalesce(R.items_at(s, "source_refs"), F.array().cast("array<variant>"))
    refs = _refs(each, ["document_id", "owner"], F.col("suggestion_id"), items, default_chunk="")
    return ParsedFindings(suggestions, refs, _failed(rows, "Suggestion reply breaks its contract.", "document_id"))


def _answer_ok(v: Column) -> Column:
    def ref_ok(r: Column) -> Column:
        return _ref_ok(r, MAX_EVIDENCE_CHARS) & (~R.has(r, "evidence_verified") | R.is_flag(r, "evidence_verified"))

    refs = R.items_at(v, "source_refs")
    refs_ok = ~R.has(v, "source_refs") | (R.all_items(refs, ref_ok) & (F.size(refs) <= MAX_ANSWER_REFS))
    meta = R.at(v, "metadata")
    meta_ok = meta.isNull() | (
        R.is_text(meta, "prompt_version")
        & R.is_text(meta, "model_id")
        & F.try_variant_get(meta, "$.temperature", "double").isNotNull()
        & F.try_to_timestamp(R.text_at(meta, "timestamp")).isNotNull()
    )
    return (
        v.isNotNull()
        & R.is_text(v, "answer", MAX_ANSWER_CHARS)
        & R.is_flag(v, "answerable")
        & (~R.has(v, "all_evidence_unverified") | R.is_flag(v, "all_evidence_unverified"))
        & refs_ok
        & meta_ok
    )


def parse_answers(responses: DataFrame) -> ParsedAnswers:
    """Answers and their references; failures keep the reply, so that it can be asked for again."""
    keys = ["question_id", "document_id"]
    rows, v = _judged(responses, "answer"), F.col("_v")
    good = rows.where("_ok")
    answers = good.select(
        *keys,
        R.text_at(v, "answer").alias("answer"),
        R.flag_at(v, "answerable").alias("answerable"),
        F.coalesce(R.flag_at(v, "all_evidence_unverified"), F.lit(False)).alias("all_evidence_unverified"),
        "model_id",
        "attempt",
    )
    items = F.coalesce(R.items_at(v, "source_refs"), F.array().cast("array<variant>"))
    refs = _refs(good, keys, F.col("question_id"), items)
    message = (
        F.when(F.trim("content") == "", "Empty reply, no JSON to parse.")
        .when(v.isNull(), "Reply is not a JSON object.")
        .otherwise("Reply does not conform to the answer schema.")
    )
    failures = rows.where("NOT _ok").select(*keys, "attempt", "content", message.alias("error_message"))
    return ParsedAnswers(answers, refs, failures)


# Where a step's reply lists its items, and what each item must be.
LISTS = {"extraction": "elements", "contradiction": "findings", "ambiguity": "ambiguities", "suggestion": "suggestions"}
ITEM_RULES = {
    "scoring": _score_ok,
    "contradiction": _contradiction_ok,
    "ambiguity": _ambiguity_ok,
    "completeness": _assessment_ok,
    "suggestion": _suggestion_ok,
}
