"""Table schemas, closed vocabularies and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- Fixed values -------------------------------------------------------------------------------------------------

ELEMENT_TYPES = ["proposito", "concepto", "actor", "regla", "proceso", "restriccion"]
RELATION_TYPES = ["constrains", "participates_in", "depends_on", "contradicts"]
DOCUMENT_TYPES = ["prd", "technical_spec", "policy_process", "generic"]
SEVERITIES = ["high", "medium", "low"]
SUGGESTION_CATEGORIES = ["structure", "clarity", "completeness", "consistency"]
MISSING_CLASSES = ["missing", "partial"]
FINDING_TYPES = ["contradiction", "ambiguity"]
FORMATS = {".md": "markdown", ".txt": "plain_text", ".pdf": "pdf"}
MIME_TYPES = {
    ".pdf": "application/pdf",
    ".md": "text/markdown",
    ".markdown": "text/markdown",
    ".txt": "text/plain",
}

MAX_TEXT_BYTES = 1_048_576
MAX_PDF_BYTES = 10_485_760
DEFAULT_RETENTION_SECONDS = 86_400
MAX_PAGE_CHARS = 4_000
SCANNED_BELOW_CHARS = 50
LANGUAGE_SAMPLE_CHARS = 1_000
TYPE_SAMPLE_CHARS = 2_000
SEGMENT_CHARS = 100_000
MAX_EVIDENCE_CHARS = 500
MAX_DESCRIPTION_CHARS = 500
MAX_SUGGESTION_CHARS = 300
MAX_ANSWER_CHARS = 5_000
MAX_ANSWER_REFS = 10
MAX_QUESTION_CHARS = 1_000
MAX_ERROR_CHARS = 1_000
SCORING_PREVIEW_CHARS = 100
SIMILARITY_THRESHOLD = 0.8
MAX_SUGGESTIONS = 20
MAX_DIRECT_ELEMENTS = 20
CONTEXT_WINDOW_TOKENS = 128_000
CONTEXT_RATIO = 0.6

PROMPT_VERSIONS = {
    "type": "type-inference-v1",
    "extraction": "extraction-v1",
    "contradiction": "contradiction-v1",
    "ambiguity": "ambiguity-v1",
    "completeness": "completeness-v1",
    "suggestion": "suggestion-v1",
    "scoring": "query-relevance-scoring-v1",
    "answer": "query-answering-v1",
}
TEMPERATURE = 0.1

CANNOT_ANSWER = (
    "The available knowledge does not contain information relevant to this question. "
    "The Knowledge Model does not have elements that match the question's subject matter."
)

# Expected elements per document type: (name, description, importance).
EXPECTED_ELEMENTS = {
    "prd": [
        ("propósito", "Document purpose and product goal", "high"),
        ("usuarios/actores", "Target users and actors", "high"),
        ("requisitos funcionales", "Functional requirements", "high"),
        ("restricciones", "Constraints and limitations", "medium"),
        ("criterios de éxito", "Success criteria and metrics", "medium"),
    ],
    "technical_spec": [
        ("propósito", "Specification purpose and scope", "high"),
        ("alcance", "System scope and boundaries", "high"),
        ("componentes/conceptos", "System components and key concepts", "high"),
        ("interfaces", "API interfaces and contracts", "medium"),
        ("restricciones", "Technical constraints", "medium"),
        ("decisiones", "Design decisions and rationale", "low"),
    ],
    "policy_process": [
        ("propósito", "Policy/process purpose", "high"),
        ("alcance", "Scope of applicability", "high"),
        ("actores/roles", "Involved actors and roles", "high"),
        ("reglas", "Business rules and policies", "high"),
        ("procesos", "Process steps and workflows", "medium"),
        ("excepciones", "Exceptions and edge cases", "low"),
    ],
}

# Session life cycle: status -> statuses it may follow (None = first event). `failed` may follow any running status.
ANALYSIS_MOVES = {
    "inferring_type": [None],
    "awaiting_confirmation": ["inferring_type"],
    "extracting": ["awaiting_confirmation"],
    "verifying": ["extracting"],
    "completed": ["verifying"],
    "failed": ["inferring_type", "extracting", "verifying"],
}
QUALITY_PHASES = [
    "analyzing_contradictions",
    "analyzing_ambiguities",
    "analyzing_completeness",
    "generating_suggestions",
]
QUALITY_MOVES = {
    "analyzing": [None, "completed", "failed"],
    "analyzing_contradictions": ["analyzing"],
    "analyzing_ambiguities": ["analyzing_contradictions"],
    "analyzing_completeness": ["analyzing_ambiguities"],
    "generating_suggestions": ["analyzing_completeness"],
    "completed": ["generating_suggestions"],
    "failed": ["analyzing", *QUALITY_PHASES],
}

# --- Schemas (DDL) ------------------------------------------------------------------------------------------------------

FILES = ("path STRING, modificationTime TIMESTAMP, length LONG, content BINARY")
CONTEXT = "STRUCT<page: INT, section: STRING>"
CHUNKS = (
    f"document_id STRING, chunk_id STRING, text STRING, structural_context {CONTEXT}, order INT"
)
DOCUMENTS = (
    "document_id STRING, original_filename STRING, format STRING, size_bytes LONG, language STRING, "
    "upload_timestamp TIMESTAMP, warnings ARRAY<STRING>, status STRING, error_message STRING, expires_at TIMESTAMP"
)
PAGES = ("document_id STRING, page INT, text STRING")
SOURCE_REF = "STRUCT<chunk_id: STRING, page: INT, section: STRING, evidence: STRING>"
ELEMENTS = (
    f"document_id STRING, pos LONG, id STRING, type STRING, name STRING, content STRING, source_ref {SOURCE_REF}, "
    "verified BOOLEAN"
)
RELATIONS = (
    "document_id STRING, element_pos LONG, pos INT, source_id STRING, target_id STRING, type STRING, description STRING"
)
RESPONSES = (
    "document_id STRING, step STRING, segment INT, question_id STRING, attempt INT, prompt_version STRING, "
    "content STRING, model_id STRING, error STRING"
)
SESSION_EVENTS = ("document_id STRING, track STRING, seq LONG, ts TIMESTAMP, status STRING, payload STRING")
TYPE_SCHEMA = ("document_type STRING, pos INT, name STRING, description STRING, importance STRING")


def type_schema(spark: SparkSession, expected: dict[str, list[tuple[str, str, str]]] | None = None) -> DataFrame:
    """The expected-elements catalogue as a table; pass your own mapping to replace the built-in one."""
    rows = [
        (kind, pos, *entry)
        for kind, entries in (EXPECTED_ELEMENTS if expected is None else expected).items()
        for pos, entry in enumerate(entries)
    ]
    return spark.createDataFrame(rows, TYPE_SCHEMA)
