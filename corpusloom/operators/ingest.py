"""From files to checked, numbered chunks."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.files import detect_format, file_error, route_format
from corpusloom.functions.text import detect_language
from corpusloom.model import DEFAULT_RETENTION_SECONDS, SCANNED_BELOW_CHARS
from corpusloom.operators import segment

Reader = Callable[[DataFrame], DataFrame]

# --- Fixed values -------------------------------------------------------------------------------------------------

SCANNED_MESSAGE = (
    "Extraction failed: Scanned PDF detected: this document contains no extractable text. "
    "Scanned PDFs (image-only) are not supported."
)


class Checked(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame


class Ingested(NamedTuple):
    documents: DataFrame
    chunks: DataFrame
    rejected: DataFrame


def validate_files(files: DataFrame) -> Checked:
    """Split `files(filename, length, content)`: format, then size, then encoding; the first failing check is reported."""
    judged = files.withColumn("_error", file_error(F.col("filename"), F.col("length"), F.col("content")))
    accepted = judged.where(F.col("_error").isNull()).drop("_error").withColumn("format", detect_format("filename"))
    rejected = judged.where(F.col("_error").isNotNull()).select(
        *[c for c in files.columns if c != "content"],
        F.col("_error.code").alias("error_code"),
        F.col("_error.message").alias("error_message"),
    )
    return Checked(accepted, rejected)


def readers() -> dict[str, Reader]:
    """Format registry: name -> function from `docs(document_id, text)` to chunks. Add or replace entries freely."""
    return {"markdown": segment.chunk_markdown, "plain_text": segment.chunk_plaintext}


def chunk_by_format(docs: DataFrame, pages: DataFrame | None = None, registry: dict[str, Reader] | None = None) -> DataFrame:
    """Send each `docs(document_id, format, text)` row to its reader; paged documents come in as `pages`."""
    branches = [
        reader(docs.where(F.col("format") == name).select("document_id", "text"))
        for name, reader in (readers() if registry is None else registry).items()
    ]
    if pages is not None:
        branches.append(segment.chunk_pages(pages))
    out = branches[0]
    for branch in branches[1:]:
        out = out.unionByName(branch)
    return out


def check_chunks(chunks: DataFrame) -> DataFrame:
    """Per document: are orders 0..n-1 without gap or repeat, and chunk ids unique?"""
    n = F.count("*")
    return chunks.groupBy("document_id").agg(
        n.alias("chunk_count"),
        (
            (F.min("order") == 0) & (F.max("order") == n - 1) & (F.count_distinct("order") == n)
        ).alias("sequential"),
        (F.count_distinct("chunk_id") == n).alias("unique_ids"),
    )


def chunk_failures(chunks: DataFrame) -> DataFrame:
    """Documents whose reader numbered its chunks badly; their chunks are not shown, as the document is not ready."""
    message = F.when(~F.col("sequential"), "Chunk ordering is not sequential.").otherwise("Duplicate chunk_id found.")
    return check_chunks(chunks).where("NOT (sequential AND unique_ids)").select("document_id", message.alias("error_message"))


def document_records(files: DataFrame, now: Column, retention: int = DEFAULT_RETENTION_SECONDS) -> DataFrame:
    """First record of an accepted file: `processing`, expiring `retention` seconds after `now`."""
    return files.select(
        "document_id",
        F.col("filename").alias("original_filename"),
        "format",
        F.col("length").cast("long").alias("size_bytes"),
        F.lit(None).cast("string").alias("language"),
        now.alias("upload_timestamp"),
        F.array().cast("array<string>").alias("warnings"),
        F.lit("processing").alias("status"),
        F.lit(None).cast("string").alias("error_message"),
        (now + F.make_interval(secs=F.lit(retention))).alias("expires_at"),
    )


def document_languages(chunks: DataFrame) -> DataFrame:
    """Language of each document from the first 1000 characters of its chunks."""
    return segment.language_sample(chunks).select("document_id", detect_language("sample").alias("language"))


def settle_documents(records: DataFrame, chunks: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Records turned `ready` with their language, or `failed` where `failures(document_id, error_message)` says so.

    A document without chunks is legal; its language is unknown.
    """
    out = records.drop("language").join(document_languages(chunks), "document_id", "left")
    out = out.withColumn("language", F.coalesce("language", F.lit("unknown")))
    if failures is None:
        return out.withColumn("status", F.lit("ready")).select(*records.columns)
    failed = failures.select("document_id", F.col("error_message").alias("_message"))
    bad = F.col("_message").isNotNull()
    return (
        out.join(failed, "document_id", "left")
        .withColumn("status", F.when(bad, "failed").otherwise("ready"))
        .withColumn("error_message", F.coalesce("_message", "error_message"))
        .withColumn("language", F.when(bad, F.lit(None)).otherwise(F.col("language")))
        .select(*records.columns)
    )


def ingest(
    files: DataFrame,
    now: Column,
    pages: DataFrame | None = None,
    retention: int = DEFAULT_RETENTION_SECONDS,
    registry: dict[str, Reader] | None = None,
    settle: Callable[[DataFrame], DataFrame] | None = None,
) -> Ingested:
    """Validate, cut and describe `files(document_id, filename, length, content)`.

    Text of paged files is given in `pages(document_id, page, text)`; those with almost no text, or no row there, are
    marked failed.
    A document whose reader leaves gaps in its chunks' order, or repeats an id, is marked failed too.
    `settle` may store the chunks, so that languages are read from the stored table and files are not cut twice.
    """
    checked = validate_files(files)
    records = document_records(checked.accepted, now, retention)
    docs = checked.accepted.select(
        "document_id", route_format("filename").alias("format"), F.col("content").cast("string").alias("text")
    )
    unread = records.where(F.col("format") == "pdf").select("document_id")
    if pages is not None:
        pages = pages.join(unread, "document_id", "left_semi")
        readable = segment.scanned_documents(pages, SCANNED_BELOW_CHARS).where(~F.col("scanned"))
        pages = pages.join(readable, "document_id", "left_semi")
        unread = unread.join(readable, "document_id", "left_anti")
    failures = unread.select("document_id", F.lit(SCANNED_MESSAGE).alias("error_message"))
    chunks = chunk_by_format(docs.where(F.col("format") != "pdf"), pages, registry)
    if settle is not None:
        chunks = settle(chunks)
    failures = failures.unionByName(chunk_failures(chunks))
    return Ingested(settle_documents(records, chunks, failures), chunks, checked.rejected)


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))


def document_status(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Status row per document; the chunk count is shown for ready documents only."""
    ready = F.col("status") == "ready"
    return documents.join(chunk_counts(chunks), "document_id", "left").select(
        "document_id",
        "status",
        F.col("original_filename").alias("filename"),
        "format",
        "language",
        F.when(ready, F.coalesce("chunk_count", F.lit(0))).alias("chunk_count"),
        "warnings",
        "error_message",
    )


class Purged(NamedTuple):
    documents: DataFrame
    dependents: dict[str, DataFrame]
    deleted: DataFrame


def purge_expired(documents: DataFrame, as_of: Column, **dependents: DataFrame) -> Purged:
    """Drop documents whose `expires_at` lies strictly before `as_of`, and rows of dependent tables with them."""
    expired = F.coalesce(F.col("expires_at") < as_of, F.lit(False))
    gone = documents.where(expired)
    ids = gone.select("document_id")
    kept = {name: df.join(ids, "document_id", "left_anti") for name, df in dependents.items()}
    return Purged(documents.where(~expired), kept, gone)


def ir_view(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ready documents with their ordered chunks nested (an empty list when there are none)."""
    nested = chunks.groupBy("document_id").agg(
        F.array_sort(
            F.collect_list(F.struct("order", "chunk_id", "text", "structural_context"))
        ).alias("chunks")
    )
    empty = F.array().cast("array<struct<order:int,chunk_id:string,text:string,structural_context:struct<page:int,section:string>>>")
    return (
        documents.where(F.col("status") == "ready")
        .join(nested, "document_id", "left")
        .withColumn("chunks", F.coalesce("chunks", empty))
    )
