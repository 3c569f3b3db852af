"""Prompt tables: one row per model call, made only of columns that come from the document.

A prompt is one string per document (or question), so its parts are gathered per document; texts are at most the accepted
file size and extraction is cut into segments first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import chunk_label, truncate
from corpusloom.model import CANNOT_ANSWER, DOCUMENT_TYPES, ELEMENT_TYPES, PROMPT_VERSIONS, RELATION_TYPES, SCORING_PREVIEW_CHARS
from corpusloom.operators.segment import context_list, segment_chunks, type_sample

TIERS = {"type": "light", "scoring": "light"}
JSON_ONLY = "Reply with JSON only."


def _ordered(order: list[str], value: Column) -> Column:
    """Values of a group as an array in the given order."""
    return F.transform(
        F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], value.alias("_value")))), lambda r: r["_value"]
    )


def to_json_list(rows: DataFrame, keys: list[str], order: list[str], fields: list[Column | str], out: str) -> DataFrame:
    """JSON list of the chosen fields per key, in order; nothing but these fields leaves the table."""
    listed = _ordered(order, F.struct(*fields))
    return rows.groupBy(*keys).agg(F.to_json(listed, {"ignoreNullFields": "false"}).alias(out))


def labelled_text(chunks: DataFrame, style: str, keys: list[str] | None = None) -> DataFrame:
    """Chunk texts under their labels, a blank line between chunks.

    Labels are made after the grouping, so that prompts with different ones share its shuffle.
    """

    def labelled(c: Column) -> Column:
        label = chunk_label(style, c["chunk_id"], c["structural_context"]["page"], c["structural_context"]["section"])
        return F.struct(c["order"].alias("order"), F.concat(label, F.lit(" " if style == "id" else "\n"), c["text"]).alias("part"))

    keys = keys or ["document_id"]
    grouped = chunks.repartition(*keys).groupBy(*keys).agg(
        F.collect_list(F.struct("order", "chunk_id", "structural_context", "text")).alias("_chunks")
    )
    parts = F.transform(F.array_sort(F.transform("_chunks", labelled)), lambda p: p["part"])
    return grouped.withColumn("text", F.array_join(parts, "\n\n")).drop("_chunks")


def _prompt(rows: DataFrame, step: str, *parts: Column | str) -> DataFrame:
    text = F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])
    return rows.select(
        "document_id",
        F.lit(step).alias("step"),
        (F.col("segment") if "segment" in rows.columns else F.lit(0)).cast("int").alias("segment"),
        (F.col("question_id") if "question_id" in rows.columns else F.lit(None)).cast("string").alias("question_id"),
        F.lit(1).alias("attempt"),
        F.lit(TIERS.get(step, "primary")).alias("tier"),
        F.lit(PROMPT_VERSIONS[step]).alias("prompt_version"),
        text.alias("prompt"),
    )


def type_prompts(chunks: DataFrame) -> DataFrame:
    return _prompt(
        type_sample(chunks),
        "type",
        f"Decide which kind of document this sample comes from: {', '.join(DOCUMENT_TYPES)}.\n"
        'Give {"document_type": ..., "justification": ...}. ' + JSON_ONLY + "\n\nSample:\n",
        F.col("sample"),
    )


def extraction_prompts(chunks: DataFrame, types: DataFrame) -> DataFrame:
    """One prompt per document, or per segment of a large one."""
    cut = segment_chunks(chunks)
    keys = ["document_id", "segment"]
    texts = cut.groupBy(*keys).agg(
        F.array_join(_ordered(["order"], F.col("text")), "\n").alias("text"), context_list().alias("contexts")
    )
    rows = texts.join(types.select("document_id", "document_type"), "document_id")
    return _prompt(
        rows,
        "extraction",
        "Extract the knowledge elements of this ",
        F.col("document_type"),
        f" document. Element types: {', '.join(ELEMENT_TYPES)}. Relation types: {', '.join(RELATION_TYPES)}.\n"
        'Give {"elements": [{"id", "type", "name", "content", "source_ref": {"chunk_id", "page", "section", "evidence"}, '
        '"relations": [{"target_id", "type", "description"}]}]}, evidence quoted word for word. ' + JSON_ONLY + "\n\nChunks:\n",
        F.to_json("contexts"),
        "\n\nText:\n",
        F.col("text"),
    )


def _edges(relations: DataFrame) -> DataFrame:
    return to_json_list(
        relations,
        ["document_id"],
        ["element_pos", "pos", "target_id"],
        ["source_id", "target_id", "type", "description"],
        "edges",
    )


def contradiction_prompts(elements: DataFrame, relations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with elements only."""
    ref = F.struct("source_ref.chunk_id", "source_ref.page", "source_ref.section").alias("source_ref")
    listed = to_json_list(elements, ["document_id"], ["pos"], ["id", "type", "name", "content", ref], "items")
    rows = listed.join(_edges(relations), "document_id", "left").join(labelled_text(chunks, "id"), "document_id", "left")
    return _prompt(
        rows,
        "contradiction",
        'Find statements that contradict each other. Give {"findings": [{"type", "description", "severity", '
        '"affected_element_ids", "source_refs"}]}. ' + JSON_ONLY + "\n\nElements:\n",
        F.col("items"),
        "\n\nRelations:\n",
        F.coalesce("edges", F.lit("[]")),
        "\n\nText:\n",
        F.col("text"),
    )


def ambiguity_prompts(documents: DataFrame, elements: DataFrame, chunks: DataFrame) -> DataFrame:
    listed = to_json_list(elements, ["document_id"], ["pos"], ["id", "type", "name", "content", "verified"], "items")
    rows = (
        documents.select("document_id")
        .join(listed, "document_id", "left")
        .join(labelled_text(chunks, "fields"), "document_id", "left")
    )
    return _prompt(
        rows,
        "ambiguity",
        "Find undefined terms, vague quantities, unclear references and open conditions. "
        'Give {"ambiguities": [{"id", "category", "description", "severity", "affected_element_ids", "source_ref"}]}. '
        + JSON_ONLY + "\n\nElements:\n",
        F.coalesce("items", F.lit("[]")),
        "\n\nText:\n",
        F.col("text"),
    )


def completeness_prompts(matches: DataFrame, catalogue: DataFrame) -> DataFrame:
    """From `schema_matches`: which met expectations are met in part only?"""
    keys = ["document_id", "document_type", "schema_pos", "expected_element"]
    met = matches.groupBy(*keys).agg(
        _ordered(["pos"], F.struct("name", "type", "content")).alias("km_elements")
    )
    items = met.groupBy("document_id", "document_type").agg(
        F.to_json(
            _ordered(["schema_pos"], F.struct(F.col("expected_element").alias("expected_element_name"), "km_elements"))
        ).alias("items")
    )
    expected = to_json_list(
        catalogue, ["document_type"], ["pos"], ["name", "description", "importance"], "expected"
    )
    return _prompt(
        items.join(expected, "document_type"),
        "completeness",
        'Judge how far each expectation is met. Give {"assessments": [{"expected_element_name", "classification", '
        '"description", "severity"}]}, classification complete or partial. ' + JSON_ONLY + "\n\nExpected:\n",
        F.col("expected"),
        "\n\nFound:\n",
        F.col("items"),
    )


def suggestion_prompts(
    documents: DataFrame, findings: DataFrame, missing: DataFrame, elements: DataFrame, chunks: DataFrame
) -> DataFrame:
    found = to_json_list(
        findings,
        ["document_id"],
        ["ord", "finding_id"],
        [F.col("finding_id").alias("id"), "type", "description", "severity", "affected_element_ids"],
        "found",
    )
    gaps = to_json_list(
        missing,
        ["document_id"],
        ["ord", "finding_id"],
        [
            F.col("finding_id").alias("id"),
            "classification",
            "expected_element",
            "description",
            "severity",
            "schema_reference",
        ],
        "gaps",
    )
    listed = to_json_list(elements, ["document_id"], ["pos"], ["id", "type", "name", "content"], "items")
    rows = documents.select("document_id")
    for part in (found, gaps, listed, labelled_text(chunks, "tags")):
        rows = rows.join(part, "document_id", "left")
    return _prompt(
        rows,
        "suggestion",
        'Suggest improvements. Give {"suggestions": [{"id", "description", "category", "priority", "related_finding_ids", '
        '"source_refs"}]}. ' + JSON_ONLY + "\n\nFindings:\n",
        F.coalesce("found", F.lit("[]")),
        "\n\nGaps:\n",
        F.coalesce("gaps", F.lit("[]")),
        "\n\nElements:\n",
        F.coalesce("items", F.lit("[]")),
        "\n\nText:\n",
        F.col("text"),
    )


def scoring_prompts(questions: DataFrame, elements: DataFrame) -> DataFrame:
    """The element list is made once per document and shared by its questions; documents without elements have none."""
    preview = truncate("content", SCORING_PREVIEW_CHARS).alias("content_preview")
    listed = to_json_list(elements, ["document_id"], ["pos"], ["id", "type", "name", preview], "items")
    return _prompt(
        questions.select("question_id", "document_id", "question").join(listed, "document_id"),
        "scoring",
        'Score from 0 to 10 how much each element helps to answer the question. Give [{"id", "score"}]. '
        + JSON_ONLY + "\n\nQuestion:\n",
        F.col("question"),
        "\n\nElements:\n",
        F.col("items"),
    )


def answer_prompts(questions: DataFrame, context_elements: DataFrame, context_relations: DataFrame) -> DataFrame:
    """Questions with context only; the others are answered by `cannot_answer`."""
    keys = ["question_id", "document_id"]
    ordered = context_elements.withColumn("_role", F.when(F.col("role") == "direct", 0).otherwise(1))
    ordered = ordered.withColumns(
        {"_place": F.coalesce("place", F.lit(0)), "_unverified": (~F.col("verified")).cast("int")}
    )
    items = to_json_list(
        ordered,
        keys,
        ["_role", "_place", "_unverified", "name", "id"],
        ["type", "name", "content", F.col("source_ref.evidence").alias("evidence"), "verified"],
        "items",
    )
    edges = to_json_list(
        context_relations, keys, ["rank", "element_pos", "pos", "target_id"], ["source_id", "target_id", "type"], "edges"
    )
    rows = questions.select(*keys, "question").join(items, keys).join(edges, keys, "left")
    return _prompt(
        rows,
        "answer",
        "Answer the question from the knowledge below only, in the language of the question. "
        'Give {"answer", "answerable", "source_refs": [{"chunk_id", "page", "section", "evidence"}]}. ' + JSON_ONLY
        + f" If the knowledge does not hold the answer, set answerable to false ({CANNOT_ANSWER[:36]}...).\n\nKnowledge:\n",
        F.col("items"),
        "\n\nRelations:\n",
        F.coalesce("edges", F.lit("[]")),
        "\n\nQuestion:\n",
        F.col("question"),
    )
