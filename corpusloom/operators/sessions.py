"""Session events: current state, legal moves, and the gates in front of each step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.model import ANALYSIS_MOVES, DOCUMENT_TYPES, QUALITY_MOVES, QUALITY_PHASES
from corpusloom.operators.prefix import previous_value

# --- Fixed values -------------------------------------------------------------------------------------------------

RUNNING = ["analyzing", *QUALITY_PHASES]


def move_allowed(track: Column, before: Column, after: Column) -> Column:
    """Is `after` a legal follower of `before` (null = first event) on this track?"""
    out = F.lit(False)
    for name, moves in (("analysis", ANALYSIS_MOVES), ("quality", QUALITY_MOVES)):
        for target, sources in moves.items():
            ok = before.isin([s for s in sources if s is not None])
            ok = F.coalesce(ok, F.lit(False)) | (before.isNull() if None in sources else F.lit(False))
            out = F.when((track == name) & (after == target), ok).otherwise(out)
    return out


def check_moves(events: DataFrame) -> DataFrame:
    """Add `previous_status` and `legal` to `events(document_id, track, seq, status)`."""
    staged = previous_value(events, ["document_id", "track"], "seq", "status", "previous_status")
    return staged.withColumn("legal", move_allowed(F.col("track"), F.col("previous_status"), F.col("status")))


def current_sessions(events: DataFrame) -> DataFrame:
    """Latest status per document, one column per track, with the messages that still apply.

    A failed analysis has no model; a new quality run hides what the run before it left.
    """
    latest = events.groupBy("document_id").agg(
        *[
            F.max_by(F.struct("status", "payload"), F.when(F.col("track") == track, F.col("seq"))).alias(track)
            for track in ("analysis", "quality")
        ]
    )
    return latest.select(
        "document_id",
        F.col("analysis.status").alias("status"),
        F.when(F.col("analysis.status") == "failed", F.col("analysis.payload")).alias("error_message"),
        (F.col("analysis.status") == "completed").alias("has_model"),
        F.col("quality.status").alias("quality_status"),
        F.when(F.col("quality.status") == "failed", F.col("quality.payload")).alias("quality_error_message"),
        F.coalesce(F.col("quality.status").isin("completed", "failed"), F.lit(False)).alias("has_quality_result"),
    )


def _requests(requests: DataFrame, documents: DataFrame, sessions: DataFrame) -> DataFrame:
    docs = documents.select("document_id", F.col("status").alias("document_status"))
    states = sessions.select("document_id", F.col("status").alias("session_status"), "quality_status")
    return requests.join(docs, "document_id", "left").join(states, "document_id", "left")


def _gate(rows: DataFrame, keep: list[str], *tests: tuple[Column, str]) -> DataFrame:
    """First test that holds names the refusal; `ok` when none does."""
    verdict = F.lit("ok")
    for condition, code in reversed(tests):
        verdict = F.when(F.coalesce(condition, F.lit(False)), code).otherwise(verdict)
    return rows.select(*keep, verdict.alias("verdict"))


def gate_analysis(requests: DataFrame, documents: DataFrame, sessions: DataFrame) -> DataFrame:
    return _gate(
        _requests(requests, documents, sessions),
        requests.columns,
        (F.col("document_status").isNull(), "not_found"),
        (F.col("document_status") != "ready", "document_not_ready"),
        (F.col("session_status").isNotNull(), "analysis_exists"),
    )


def gate_confirm(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """`requests(document_id, document_type)`."""
    rows = requests.join(
        sessions.select("document_id", F.col("status").alias("session_status")), "document_id", "left"
    )
    return _gate(
        rows,
        requests.columns,
        (F.col("document_type").isNull() | ~F.col("document_type").isin(DOCUMENT_TYPES), "invalid_document_type"),
        (F.col("session_status").isNull(), "not_found"),
        (F.col("session_status") != "awaiting_confirmation", "invalid_session_state"),
    )


def gate_quality(requests: DataFrame, documents: DataFrame, sessions: DataFrame) -> DataFrame:
    running = (
        (F.col("quality_status") == "analyzing")
        | F.startswith("quality_status", F.lit("analyzing_"))
        | (F.col("quality_status") == "generating_suggestions")
    )
    return _gate(
        _requests(requests, documents, sessions),
        requests.columns,
        (F.col("document_status").isNull(), "not_found"),
        (F.col("session_status").isNull() | (F.col("session_status") != "completed"), "km_not_completed"),
        (running, "analysis_in_progress"),
    )


def quality_poll_state(requests: DataFrame, documents: DataFrame, sessions: DataFrame) -> DataFrame:
    """What a poll for quality results is told."""
    return _gate(
        _requests(requests, documents, sessions),
        requests.columns,
        (F.col("document_status").isNull() | F.col("session_status").isNull(), "not_found"),
        (F.col("session_status") != "completed", "km_not_completed"),
        (F.col("quality_status").isNull(), "not_triggered"),
        (F.col("quality_status").isin(RUNNING), "in_progress"),
        (F.col("quality_status") == "failed", "analysis_failed"),
        (F.col("quality_status") == "completed", "completed"),
        (F.lit(True), "internal_error"),
    )


def gate_query(requests: DataFrame, documents: DataFrame, sessions: DataFrame, extractions: DataFrame) -> DataFrame:
    """A question needs a completed session, its model, and the ready document."""
    models = extractions.select("document_id").distinct().withColumn("_model", F.lit(True))
    rows = _requests(requests, documents, sessions).join(models, "document_id", "left")
    return _gate(
        rows,
        requests.columns,
        (F.col("session_status").isNull(), "session_not_found"),
        (F.col("session_status") != "completed", "km_not_completed"),
        (
            F.col("_model").isNull() | F.col("document_status").isNull() | (F.col("document_status") != "ready"),
            "model_not_found",
        ),
    )
