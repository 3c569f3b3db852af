"""Queries that check quoted evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import evidence as ev
from corpusloom.plans import corpus
from corpusloom.plans.catalog.graph import docs, els, rels
from corpusloom.plans.catalog.registry import query
from corpusloom.session import materialize

_N = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_KEYS = f"""k AS (SELECT DISTINCT document_id, chunk_id, {_N.format('evidence')} AS evidence FROM el WHERE {_N.format('evidence')} <> ''),
    nt AS (SELECT document_id, chunk_id, {_N.format('text')} AS t FROM ch),
    m AS (SELECT k.*, EXISTS (SELECT 1 FROM nt WHERE nt.document_id = k.document_id AND nt.chunk_id = k.chunk_id AND contains(t, evidence)) AS in_own,
        EXISTS (SELECT 1 FROM nt WHERE nt.document_id = k.document_id AND contains(t, evidence)) AS in_any FROM k)"""


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return els(spark, sf_dir).select("document_id", "pos", "source_ref.chunk_id", "source_ref.evidence")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.stored(spark, sf_dir, "chunks")


@query(f"WITH {_KEYS} SELECT document_id, chunk_id, evidence, in_own FROM m")
def match_referenced_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.match_referenced_chunk(ev.evidence_keys(refs(spark, sf_dir)), _chunks(spark, sf_dir))


@query(f"WITH {_KEYS} SELECT document_id, chunk_id, evidence, in_any FROM m")
def match_any_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    settle = lambda df: materialize(df, "marks")
    return ev.match_any_chunk(ev.evidence_keys(refs(spark, sf_dir)), _chunks(spark, sf_dir), settle=settle)


@query(f"""WITH {_KEYS} SELECT el.document_id, el.pos, CASE WHEN in_own THEN 'referenced' WHEN in_any THEN 'elsewhere' ELSE 'none' END AS match,
    coalesce(in_any, false) AS evidence_verified FROM el LEFT JOIN m ON m.document_id = el.document_id AND m.chunk_id = el.chunk_id
    AND m.evidence = {_N.format('el.evidence')}""")
def verify_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    settle = lambda df: materialize(df, "exact")
    out = ev.verify_evidence(refs(spark, sf_dir), _chunks(spark, sf_dir), fuzzy=False, settle=settle)
    return out.select("document_id", "pos", "match", "evidence_verified")


@query()
def verify_with_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three steps; the similarity ratio has no SQL form, so tests compare it with a brute-force search."""
    settle = lambda df: materialize(df, "keys")
    out = ev.verify_evidence(refs(spark, sf_dir), _chunks(spark, sf_dir), settle=settle)
    return out.select("document_id", "pos", "match", "evidence_verified")


@query("""SELECT d.document_id, count(el.id) FILTER (verified) AS verified_count, count(el.id) AS total_count,
    CASE WHEN count(el.id) = 0 THEN 0.0 ELSE CAST(count(el.id) FILTER (verified) AS DOUBLE) / count(el.id) END AS verification_rate
    FROM d LEFT JOIN el ON el.document_id = d.document_id AND pos > 0 GROUP BY d.document_id""")
def verification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First elements left out, so that some documents have none."""
    return ev.verification_summary(docs(spark, sf_dir), els(spark, sf_dir).where(F.col("pos") > 0))


@query("SELECT document_id, pos, id FROM el WHERE NOT verified")
def unverified_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.unverified_elements(els(spark, sf_dir))


@query("""SELECT el.document_id, el.id, coalesce((SELECT NOT bool_or((element_pos + re.pos) % 2 = 0) FROM re WHERE re.document_id = el.document_id
    AND re.source_id = el.id AND re.pos > 0), false) AS all_evidence_unverified FROM el""")
def all_evidence_unverified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges stand in for references; elements without such edges have no reference and are not flagged."""
    r = rels(spark, sf_dir).where(F.col("pos") > 0)
    fake = r.select(
        "document_id", F.col("source_id").alias("id"), ((F.col("element_pos") + F.col("pos")) % 2 == 0).alias("evidence_verified")
    )
    return ev.all_evidence_unverified(els(spark, sf_dir).select("document_id", "id"), fake, ["document_id", "id"])
