"""Findings, gaps against the type's expectations, and suggestions."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import owner_key, stable_id, truncate
from corpusloom.model import MAX_EVIDENCE_CHARS, MAX_SUGGESTION_CHARS, MAX_SUGGESTIONS, PROMPT_VERSIONS, TEMPERATURE

# --- Fixed values -------------------------------------------------------------------------------------------------

COUNTED = ["contradictions", "ambiguities", "missing_elements", "suggestions"]
RUN_VERSIONS = {
    "contradiction": "contradiction_detection",
    "ambiguity": "ambiguity_detection",
    "completeness": "completeness_evaluation",
    "suggestion": "suggestion_generation",
}

FINDING_KEY = ["document_id", "finding_id"]
# Ids come with the reply and may repeat; what belongs to a finding or suggestion hangs on its place instead.
OWNER_KEY = ["document_id", "owner"]


class Suggestions(NamedTuple):
    suggestions: DataFrame
    refs: DataFrame


def flag_unverified(findings: DataFrame, elements: DataFrame) -> DataFrame:
    """Raise `involves_unverified_elements` where an affected id is a known, unverified element; never lower it."""
    bad = elements.where(~F.col("verified")).select("document_id", F.col("id").alias("_id")).distinct()
    hit = (
        findings.select(*OWNER_KEY, F.explode("affected_element_ids").alias("_id"))
        .join(bad, ["document_id", "_id"], "left_semi")
        .select(*OWNER_KEY)
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    flag = F.col("involves_unverified_elements") | F.coalesce("_hit", F.lit(False))
    return (
        findings.join(hit, OWNER_KEY, "left")
        .withColumn("involves_unverified_elements", flag)
        .select(*findings.columns)
    )


def _expected(documents: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Expectations per document: `(document_id, document_type)` with each entry of its type."""
    return documents.select("document_id", "document_type").join(
        catalogue.withColumnsRenamed({"pos": "schema_pos", "name": "expected_element", "description": "expected"}),
        "document_type",
    )


def _meets(expected: Column, name: Column, type_: Column) -> Column:
    e, n, t = F.lower(expected), F.lower(name), F.lower(type_)
    return F.contains(n, e) | F.contains(t, e) | F.contains(e, n) | F.contains(e, t)


def schema_matches(documents: DataFrame, elements: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(expectation, element) pairs that match by name or type, either containing the other."""
    typed = elements.join(documents.select("document_id", "document_type"), "document_id")
    entries = catalogue.select("document_type", F.struct("pos", "name", "description", "importance").alias("_e"))
    met = typed.join(entries, "document_type").where(_meets(F.col("_e.name"), F.col("name"), F.col("type")))
    rows = met.select("document_id", "document_type", "pos", "id", "type", "name", "content", "_e")
    return rows.select(
        "document_id",
        "document_type",
        F.col("_e.pos").alias("schema_pos"),
        F.col("_e.name").alias("expected_element"),
        "pos",
        "id",
        "type",
        "name",
        "content",
    )


def match_schema(documents: DataFrame, elements: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Each document's expectations with `present`."""
    found = (
        schema_matches(documents, elements, catalogue)
        .groupBy("document_id", "schema_pos")
        .agg(F.lit(True).alias("_found"))
    )
    return (
        _expected(documents, catalogue)
        .join(found, ["document_id", "schema_pos"], "left")
        .withColumn("present", F.coalesce("_found", F.lit(False)))
        .select("document_id", "document_type", "schema_pos", "expected_element", "expected", "importance", "present")
    )


def completeness_errors(documents: DataFrame, elements: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Documents whose completeness cannot be judged: no elements, or a type nobody described."""
    some = elements.select("document_id").distinct().withColumn("_some", F.lit(True))
    known = catalogue.select("document_type").distinct().withColumn("_known", F.lit(True))
    rows = (
        documents.select("document_id", "document_type")
        .where(F.col("document_type") != "generic")
        .join(some, "document_id", "left")
        .join(known, "document_type", "left")
    )
    empty = F.lit("Completeness cannot be assessed: Knowledge Model contains zero elements.")
    unknown = F.concat(
        F.lit("Document type schema not found for type '"),
        F.col("document_type"),
        F.lit("'. Completeness evaluation cannot proceed without a valid schema."),
    )
    message = F.when(F.col("_some").isNull(), empty).when(F.col("_known").isNull(), unknown)
    return rows.select("document_id", message.alias("error_message")).where(F.col("error_message").isNotNull())


def missing_elements(documents: DataFrame, elements: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Expectations nothing in the document meets; documents without any element are errors, not gaps."""
    judged = documents.where(F.col("document_type") != "generic").join(
        elements.select("document_id").distinct(), "document_id", "left_semi"
    )
    gaps = match_schema(judged, elements, catalogue).where(~F.col("present"))
    text = F.concat(
        F.lit("Expected element '"),
        F.col("expected_element"),
        F.lit("' ("),
        F.col("expected"),
        F.lit(") is not present in the document."),
    )
    return gaps.select(
        "document_id",
        stable_id("miss-", "document_id", "document_type", "schema_pos").alias("finding_id"),
        owner_key("missing", "schema_pos").alias("owner"),
        F.array(F.lit(0).cast("long"), F.col("schema_pos").cast("long")).alias("ord"),
        F.lit("missing").alias("classification"),
        "expected_element",
        text.alias("description"),
        F.col("importance").alias("severity"),
        F.col("document_type").alias("schema_reference"),
    )


def contradictions(structural: DataFrame, modelled: DataFrame) -> DataFrame:
    """Explicit contradictions followed by those the model found.

    A document whose model call failed has no `modelled` rows and keeps its explicit ones; a reply that could not be read
    is reported by `parse_contradictions` and fails the phase.
    """
    return structural.unionByName(modelled)


def all_inconsistencies(contradictions_: DataFrame, ambiguities: DataFrame) -> DataFrame:
    return contradictions_.unionByName(ambiguities)


def finding_counts(documents: DataFrame, findings: DataFrame, missing: DataFrame, suggestions: DataFrame) -> DataFrame:
    kinds = (
        findings.select("document_id", F.when(F.col("type") == "contradiction", 0).otherwise(1).alias("k"))
        .unionByName(missing.select("document_id", F.lit(2).alias("k")))
        .unionByName(suggestions.select("document_id", F.lit(3).alias("k")))
    )
    counts = kinds.groupBy("document_id").agg(
        *[F.count_if(F.col("k") == i).alias(name) for i, name in enumerate(COUNTED)]
    )
    return documents.select("document_id").join(counts, "document_id", "left").na.fill(0, COUNTED)


def run_metadata(results: DataFrame, models: DataFrame, started_at: Column, completed_at: Column) -> DataFrame:
    """Add `metadata` to `finding_counts` rows with a `document_type`: what a result was made with, when, and how much it holds.

    `models(document_id, model_id)` names the model that answered.
    """
    versions = [F.lit(x) for kind, name in RUN_VERSIONS.items() for x in (name, PROMPT_VERSIONS[kind])]
    counts = [x for name in COUNTED for x in (F.lit(name), F.col(name))]
    return results.join(models, "document_id", "left").select(
        *results.columns,
        F.struct(
            F.create_map(*versions).alias("prompt_versions"),
            "model_id",
            F.lit(TEMPERATURE).alias("temperature"),
            "document_type",
            started_at.alias("started_at"),
            completed_at.alias("completed_at"),
            F.create_map(*counts).alias("finding_counts"),
        ).alias("metadata"),
    )


def high_findings(findings: DataFrame, missing: DataFrame) -> DataFrame:
    """High-severity findings with the category a suggestion about them belongs to."""
    category = F.when(F.col("type") == "contradiction", "consistency").otherwise("clarity")
    return (
        findings.where(F.col("severity") == "high")
        .select(*FINDING_KEY, "owner", "description", category.alias("category"))
        .unionByName(
            missing.where(F.col("severity") == "high").select(
                *FINDING_KEY, "owner", "description", F.lit("completeness").alias("category")
            )
        )
    )


def uncovered_high_findings(findings: DataFrame, missing: DataFrame, suggestions: DataFrame) -> DataFrame:
    """High-severity findings no suggestion mentions."""
    covered = suggestions.select("document_id", F.explode("related_finding_ids").alias("finding_id")).distinct()
    return high_findings(findings, missing).join(covered, FINDING_KEY, "left_anti")


def first_chunk_refs(chunks: DataFrame) -> DataFrame:
    """The document's first chunk as a reference."""
    return (
        chunks.groupBy("document_id")
        .agg(
            F.min_by(
                F.struct("chunk_id", "structural_context", truncate("text", MAX_EVIDENCE_CHARS).alias("evidence")), "order"
            ).alias("c")
        )
        .select(
            "document_id",
            "c.chunk_id",
            "c.structural_context.page",
            "c.structural_context.section",
            "c.evidence",
            F.lit(False).alias("evidence_verified"),
        )
    )


def default_suggestion_refs(suggestions: DataFrame, refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """References of suggestions, the document's first chunk standing in where a suggestion has none."""
    bare = suggestions.select(*OWNER_KEY, F.col("suggestion_id").alias("owner_id")).join(refs, OWNER_KEY, "left_anti")
    added = bare.join(first_chunk_refs(chunks), "document_id").withColumn("ref_pos", F.lit(0))
    return refs.unionByName(added.select(*refs.columns))


def cover_high_findings(suggestions: DataFrame, findings: DataFrame, missing: DataFrame) -> DataFrame:
    """Suggestions plus one of high priority for every uncovered high-severity finding, after the others."""
    return suggestions.unionByName(_covering(uncovered_high_findings(findings, missing, suggestions)))


def _covering(high: DataFrame) -> DataFrame:
    """A suggestion for each of these findings."""
    return high.select(
        "document_id",
        stable_id("sug-", "document_id", "finding_id").alias("suggestion_id"),
        owner_key("for", "owner").alias("owner"),
        F.lit(2**40).alias("pos"),
        truncate(F.concat(F.lit("Address: "), F.col("description")), MAX_SUGGESTION_CHARS).alias("description"),
        "category",
        F.lit("high").alias("priority"),
        F.array("finding_id").alias("related_finding_ids"),
        F.lit(False).alias("all_evidence_unverified"),
    )


def top_suggestions(suggestions: DataFrame, limit: int = MAX_SUGGESTIONS) -> DataFrame:
    """At most `limit` suggestions per document with `place` from 1; only a longer list is reordered by priority."""
    weight = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    by_priority = Window.partitionBy("document_id").orderBy(weight, "pos", "suggestion_id", "owner")
    # One row more than the limit tells whether the list is longer, without counting it.
    best = suggestions.withColumn("_n", F.row_number().over(by_priority)).where(F.col("_n") <= limit + 1)
    whole = Window.partitionBy("document_id")
    cut = F.max("_n").over(whole) > limit
    in_order = F.row_number().over(Window.partitionBy("document_id").orderBy("pos", "suggestion_id", "owner"))
    return (
        best.withColumn("place", F.when(cut, F.col("_n")).otherwise(in_order))
        .where(F.col("_n") <= limit)
        .select(*suggestions.columns, "place")
    )


def suggest(
    suggestions: DataFrame,
    refs: DataFrame,
    findings: DataFrame,
    missing: DataFrame,
    chunks: DataFrame,
    limit: int = MAX_SUGGESTIONS,
    settle: Callable[[DataFrame], DataFrame] | None = None,
) -> Suggestions:
    """References filled in, every high-severity finding covered, list limited.

    Does what `cover_high_findings`, `top_suggestions` and `default_suggestion_refs` do one after the other, on rows of
    all kinds that are shuffled by document once. A document without findings and suggestions simply has no rows in any
    of the inputs. `settle` may store the outcome, from which both tables are read.
    """
    keep = (lambda df: df) if settle is None else settle
    listed = [c for c in suggestions.columns if c != "document_id"]
    quoted = [c for c in refs.columns if c != "document_id"]
    asked = _covering(high_findings(findings, missing))
    first = first_chunk_refs(chunks).withColumns({"owner": F.lit(""), "owner_id": F.lit(""), "ref_pos": F.lit(0)})
    none = lambda df, cols: F.lit(None).cast(df.select(F.struct(*cols).alias("x")).schema["x"].dataType)
    s, r = F.struct(*listed).alias("s"), F.struct(*quoted).alias("r")
    no_s, no_r, no_id = none(suggestions, listed).alias("s"), none(refs, quoted).alias("r"), F.lit(None).cast("string")

    def rows(df: DataFrame, kind: str, owner: Column, finding: Column, s: Column, r: Column) -> DataFrame:
        return df.select("document_id", F.lit(kind).alias("kind"), owner.alias("owner"), finding.alias("finding_id"), s, r)

    mentioned = suggestions.select("document_id", F.explode("related_finding_ids").alias("finding_id"))
    every = (
        rows(suggestions, "said", F.col("owner"), no_id, s, no_r)
        .unionByName(rows(mentioned, "mention", no_id, F.col("finding_id"), no_s, no_r))
        .unionByName(rows(asked, "high", F.col("owner"), F.col("related_finding_ids")[0], s, no_r))
        .unionByName(rows(refs, "ref", F.col("owner"), no_id, no_s, r))
        .unionByName(rows(first, "first", no_id, no_id, no_s, r))
    )
    document = Window.partitionBy("document_id")
    mention = F.max(F.col("kind") == "mention").over(Window.partitionBy("document_id", "finding_id"))
    out = every.withColumn("_listed", (F.col("kind") == "said") | ((F.col("kind") == "high") & ~mention))
    weight = F.when(F.col("s.priority") == "high", 0).when(F.col("s.priority") == "medium", 1).otherwise(2)
    place = lambda *order: F.row_number().over(document.orderBy(F.desc("_listed"), *order, "s.pos", "s.suggestion_id", "s.owner"))
    out = out.withColumn("_n", F.when(F.col("_listed"), place(weight)))
    out = out.withColumn("_total", F.max("_n").over(document))
    out = out.withColumn("place", F.when(F.col("_total") > limit, F.col("_n")).otherwise(place()))
    out = out.withColumn("_listed", F.col("_listed") & (F.col("_n") <= limit))
    owned = Window.partitionBy("document_id", "owner")
    out = out.withColumn("_kept", F.max("_listed").over(owned) & F.col("owner").isNotNull())
    out = out.withColumn("_quoted", F.max(F.col("kind") == "ref").over(owned))
    out = out.withColumn("_first", F.max(F.when(F.col("kind") == "first", F.col("r"))).over(document))
    # a suggestion without references gets the document's first chunk, if it has one
    bare = F.col("_listed") & ~F.col("_quoted") & F.col("_first").isNotNull()
    own = {"owner": F.col("s.owner"), "owner_id": F.col("s.suggestion_id")}
    added = F.struct(*[own.get(c, F.col("_first")[c]).alias(c) for c in quoted])
    out = out.withColumn("r", F.when(bare, added).when((F.col("kind") == "ref") & F.col("_kept"), F.col("r")))
    done = keep(out.where("_listed OR r IS NOT NULL").select("document_id", "_listed", "s", "r", "place"))
    kept = done.where("_listed").select("document_id", *[F.col("s")[c].alias(c) for c in listed], "place")
    said = done.where("r IS NOT NULL").select("document_id", *[F.col("r")[c].alias(c) for c in quoted])
    return Suggestions(kept.select(*suggestions.columns, "place"), said.select(*refs.columns))
