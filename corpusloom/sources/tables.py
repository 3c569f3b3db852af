"""The library's tables in a store: documents with chunks, models, quality results.

Writing again replaces what a document had, in all its tables at once; see `sources.store`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.model import MAX_ERROR_CHARS
from corpusloom.operators.ingest import ir_view
from corpusloom.operators.quality import OWNER_KEY
from corpusloom.operators.sessions import current_sessions
from corpusloom.sources import store


def write_ir(documents: DataFrame, chunks: DataFrame, path: str, buckets: int | None = None) -> None:
    """Documents with their chunks; a document written before is replaced, also by one without chunks."""
    store.replace(path, documents, buckets, documents=documents, chunks=chunks)


def read_ir(spark: SparkSession, path: str, document_id: str | None = None) -> DataFrame:
    return ir_view(store.read(spark, path, "documents", document_id), store.read(spark, path, "chunks", document_id))


def add_session_events(events: DataFrame, path: str, buckets: int | None = None) -> None:
    """Events are only ever added."""
    store.append(path, buckets, session_events=events)


def persist_model(
    elements: DataFrame, relations: DataFrame, extractions: DataFrame, path: str, buckets: int | None = None
) -> None:
    """Models of the documents in `extractions`, in the place of earlier ones."""
    store.replace(path, extractions, buckets, elements=elements, relations=relations, extractions=extractions)


def purge_stored(spark: SparkSession, path: str, as_of: Column) -> DataFrame:
    """Delete documents that expired strictly before `as_of` from every table of the store; returns their records."""
    before = store.latest(spark, path)
    documents = store.read(spark, path, "documents")
    gone = documents.where(F.col("expires_at") < as_of)
    # The records are read from the commit before, which stays until `store.vacuum`.
    if before is not None:
        store.delete(spark, path, gone)
    return gone


def model_view(sessions: DataFrame, elements: DataFrame, relations: DataFrame, extractions: DataFrame) -> DataFrame:
    """Nested model of documents whose analysis is completed; others have none."""
    done = sessions.where(F.col("status") == "completed").select("document_id")
    edges = relations.groupBy("document_id", F.col("source_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "target_id", "type", "description"))).alias("relations")
    )
    nested = (
        elements.join(edges, ["document_id", "id"], "left")
        .groupBy("document_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("pos", "id", "type", "name", "content", "source_ref", "verified", "relations")
                )
            ).alias("elements")
        )
    )
    return extractions.join(done, "document_id", "left_semi").join(nested, "document_id", "left")


def read_knowledge_model(spark: SparkSession, path: str, document_id: str | None = None) -> DataFrame:
    """Nested models under `path`, with the session events deciding which are completed."""
    tables = {
        name: store.read(spark, path, name, document_id)
        for name in ("session_events", "elements", "relations", "extractions")
    }
    return model_view(
        current_sessions(tables["session_events"]), tables["elements"], tables["relations"], tables["extractions"]
    )


def quality_rows(findings: DataFrame, failures: DataFrame) -> DataFrame:
    """What a failed assessment keeps: explicit contradictions only; completed documents keep everything."""
    failed = failures.select("document_id", F.lit(True).alias("_failed"))
    marked = findings.join(failed, "document_id", "left")
    return marked.where(F.col("_failed").isNull() | F.col("from_explicit_relationship")).drop("_failed")


def failed_quality(failures: DataFrame) -> DataFrame:
    """Error rows `(document_id, error_phase, error_message)` cut to what is stored."""
    return failures.select(
        "document_id",
        F.lit("failed").alias("status"),
        "error_phase",
        F.substring("error_message", 1, MAX_ERROR_CHARS).alias("error_message"),
    )


def persist_quality(
    findings: DataFrame,
    missing: DataFrame,
    suggestions: DataFrame,
    refs: DataFrame,
    results: DataFrame,
    failures: DataFrame,
    path: str,
    buckets: int | None = None,
) -> None:
    """Write an assessment in the place of earlier ones of its documents.

    Documents in `failures` keep explicit contradictions and their references only; their results hold the error and no
    metadata.
    """
    ids = failures.select("document_id")
    kept = quality_rows(findings, failures)
    proposed = suggestions.join(ids, "document_id", "left_anti")
    owners = kept.select(*OWNER_KEY).unionByName(proposed.select(*OWNER_KEY))
    status = results.join(ids, "document_id", "left_anti").unionByName(
        failed_quality(failures), allowMissingColumns=True
    )
    store.replace(
        path,
        results.select("document_id").unionByName(ids),
        buckets,
        findings=kept,
        missing_elements=missing.join(ids, "document_id", "left_anti"),
        suggestions=proposed,
        refs=refs.join(owners, OWNER_KEY, "left_semi"),
        quality_results=status,
    )


def quality_payload(stored: DataFrame, schema: str) -> DataFrame:
    """Stored results given as JSON text or already nested; absent results stay null."""
    if dict(stored.dtypes)["result"] == "string":
        return stored.withColumn("result", F.from_json("result", schema))
    return stored


def read_quality_result(spark: SparkSession, path: str, document_id: str | None = None) -> dict[str, DataFrame]:
    return {
        name: store.read(spark, path, name, document_id)
        for name in ("quality_results", "findings", "missing_elements", "suggestions", "refs")
    }
