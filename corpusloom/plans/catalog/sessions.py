"""Queries over session events and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.files import valid_question
from corpusloom.operators import sessions as ss
from corpusloom.plans import corpus
from corpusloom.plans.catalog.registry import query

# Requests: one per document and id up to 1.5 times the users, so that some have no session and some no document.
_REQ = """rq AS (SELECT document_id FROM d UNION SELECT CAST(user_id + 900 AS VARCHAR) FROM events),
    dc AS (SELECT document_id, CASE WHEN doc_id % 6 = 0 THEN 'processing' ELSE 'ready' END AS ds FROM d),
    j AS (SELECT rq.document_id, ds, cu.status AS ss, cu.quality_status AS qs FROM rq LEFT JOIN dc USING (document_id) LEFT JOIN cu USING (document_id))"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = corpus.table(spark, sf_dir, "events").select((F.col("user_id") + 900).cast("string").alias("document_id"))
    return corpus.raw_documents(spark, sf_dir).select("document_id").union(users).distinct()


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.raw_documents(spark, sf_dir).select(
        "document_id", F.when(F.col("doc_id") % 6 == 0, "processing").otherwise("ready").alias("status")
    )


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.current_sessions(corpus.session_events(spark, sf_dir))


@query("""WITH p AS (SELECT *, lag(status) OVER (PARTITION BY document_id, track ORDER BY seq) AS prev FROM se)
    SELECT document_id, track, seq, status, prev AS previous_status, coalesce(CASE WHEN track = 'analysis' THEN CASE status WHEN 'inferring_type' THEN prev IS NULL
    WHEN 'awaiting_confirmation' THEN prev = 'inferring_type' WHEN 'extracting' THEN prev = 'awaiting_confirmation' WHEN 'verifying' THEN prev = 'extracting'
    WHEN 'completed' THEN prev = 'verifying' WHEN 'failed' THEN prev IN ('inferring_type', 'extracting', 'verifying') END
    ELSE CASE status WHEN 'analyzing' THEN prev IS NULL OR prev IN ('completed', 'failed') WHEN 'analyzing_contradictions' THEN prev = 'analyzing'
    WHEN 'completed' THEN prev = 'generating_suggestions' WHEN 'failed' THEN prev LIKE 'analyzing%' OR prev = 'generating_suggestions' END END, false) AS legal FROM p""")
def check_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.check_moves(corpus.session_events(spark, sf_dir)).select(
        "document_id", "track", "seq", "status", "previous_status", "legal"
    )


@query("""SELECT document_id, status, CASE WHEN status = 'failed' THEN payload END AS error_message, status = 'completed' AS has_model, quality_status,
    CASE WHEN quality_status = 'failed' THEN quality_payload END AS quality_error_message,
    coalesce(quality_status IN ('completed', 'failed'), false) AS has_quality_result FROM cu""")
def current_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir)


@query(f"""WITH {_REQ} SELECT document_id, CASE WHEN ds IS NULL THEN 'not_found' WHEN ds <> 'ready' THEN 'document_not_ready'
    WHEN ss IS NOT NULL THEN 'analysis_exists' ELSE 'ok' END AS verdict FROM j""")
def gate_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.gate_analysis(_requests(spark, sf_dir), _documents(spark, sf_dir), _sessions(spark, sf_dir))


@query(f"""WITH {_REQ}, t AS (SELECT *, ['prd', 'memo', 'generic'][CAST(document_id AS BIGINT) % 3 + 1] AS document_type FROM j)
    SELECT document_id, document_type, CASE WHEN document_type = 'memo' THEN 'invalid_document_type' WHEN ss IS NULL THEN 'not_found'
    WHEN ss <> 'awaiting_confirmation' THEN 'invalid_session_state' ELSE 'ok' END AS verdict FROM t""")
def gate_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("document_id").cast("long") % 3
    asked = _requests(spark, sf_dir).withColumn(
        "document_type", F.when(kind == 0, "prd").when(kind == 1, "memo").otherwise("generic")
    )
    return ss.gate_confirm(asked, _sessions(spark, sf_dir))


@query(f"""WITH {_REQ} SELECT document_id, CASE WHEN ds IS NULL THEN 'not_found' WHEN ss IS NULL OR ss <> 'completed' THEN 'km_not_completed'
    WHEN qs LIKE 'analyzing%' OR qs = 'generating_suggestions' THEN 'analysis_in_progress' ELSE 'ok' END AS verdict FROM j""")
def gate_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.gate_quality(_requests(spark, sf_dir), _documents(spark, sf_dir), _sessions(spark, sf_dir))


@query(f"""WITH {_REQ} SELECT document_id, CASE WHEN ds IS NULL OR ss IS NULL THEN 'not_found' WHEN ss <> 'completed' THEN 'km_not_completed'
    WHEN qs IS NULL THEN 'not_triggered' WHEN qs LIKE 'analyzing%' OR qs = 'generating_suggestions' THEN 'in_progress' WHEN qs = 'failed' THEN 'analysis_failed'
    WHEN qs = 'completed' THEN 'completed' ELSE 'internal_error' END AS verdict FROM j""")
def quality_poll_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.quality_poll_state(_requests(spark, sf_dir), _documents(spark, sf_dir), _sessions(spark, sf_dir))


@query(f"""WITH {_REQ} SELECT document_id, CASE WHEN ss IS NULL THEN 'session_not_found' WHEN ss <> 'completed' THEN 'km_not_completed'
    WHEN coalesce(ds, '') <> 'ready' OR CAST(document_id AS BIGINT) % 4 = 0 THEN 'model_not_found' ELSE 'ok' END AS verdict FROM j""")
def gate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = corpus.raw_documents(spark, sf_dir).where(F.col("doc_id") % 4 != 0)
    return ss.gate_query(_requests(spark, sf_dir), _documents(spark, sf_dir), _sessions(spark, sf_dir), models)


@query("SELECT conv_id, turn, length(text) BETWEEN 1 AND 1000 AS valid FROM conversations")
def valid_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "conversations").select("conv_id", "turn", valid_question("text").alias("valid"))
