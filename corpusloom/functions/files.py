"""File-level checks and classifications as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import _col, basename, sanitize_filename
from corpusloom.model import DEFAULT_RETENTION_SECONDS, FORMATS, MAX_PDF_BYTES, MAX_QUESTION_CHARS, MAX_TEXT_BYTES, MIME_TYPES

# --- Fixed values -------------------------------------------------------------------------------------------------

# Error code -> words looked for in a lower-cased message; the first row that matches wins.
ERROR_KEYWORDS = [
    ("scanned_pdf", ["scanned"]),
    ("unsupported_format", ["not supported", "unsupported"]),
    ("file_too_large", ["exceeds", "too large", "size"]),
    ("invalid_encoding", ["utf-8", "encoding"]),
]
DEFAULT_ERROR = "extraction_failed"


def suffix(filename: Column | str) -> Column:
    """Lower-cased last suffix; empty for names such as `.md` or `a.`."""
    return F.lower(F.regexp_extract(basename(filename), r"(?s)\A.+?(\.[^.]+)\z", 1))


def dot_suffix(filename: Column | str) -> Column:
    """Lower-cased text from the last dot on, as the browser-side check reads it (accepts `.md`)."""
    return F.lower(F.regexp_extract(_col(filename), r"(?s)(\.[^.]*)\z", 1))


def format_of(ext: Column) -> Column:
    out = F.lit(None).cast("string")
    for key, name in FORMATS.items():
        out = F.when(ext == key, name).otherwise(out)
    return out


def detect_format(filename: Column | str) -> Column:
    return format_of(suffix(filename))


def route_format(filename: Column | str) -> Column:
    """Reader for a file name: a plain, case-insensitive ends-with test."""
    name = F.lower(_col(filename))
    out = F.lit(None).cast("string")
    for key, fmt in FORMATS.items():
        out = F.when(F.endswith(name, F.lit(key)), fmt).otherwise(out)
    return out


def size_limit(fmt: Column | str) -> Column:
    return F.when(_col(fmt) == "pdf", MAX_PDF_BYTES).otherwise(MAX_TEXT_BYTES)


def size_ok(fmt: Column | str, size: Column | str) -> Column:
    return _col(size) <= size_limit(fmt)


def utf8_ok(fmt: Column | str, content: Column | str) -> Column:
    return (_col(fmt) == "pdf") | F.is_valid_utf8(_col(content).cast("string"))


def file_error(filename: Column, size: Column, content: Column | None, ext: Column | None = None) -> Column:
    """First failing check as STRUCT<code, message>, null when the file is acceptable."""
    ext = suffix(filename) if ext is None else ext
    fmt = format_of(ext)
    limit_mb = (size_limit(fmt) / MAX_TEXT_BYTES).cast("int").cast("string")
    shown = F.when(ext == "", "(none)").otherwise(ext)
    unsupported = F.concat(
        F.lit("File format '"),
        shown,
        F.lit("' is not supported. Please upload a file with one of these extensions: " + ", ".join(FORMATS)),
    )
    too_large = F.concat(
        F.lit("File exceeds the maximum allowed size of "),
        limit_mb,
        F.lit(" MB for "),
        ext,
        F.lit(" files. Please reduce the file size and try again."),
    )
    encoding = F.lit(
        "File is not valid UTF-8 encoded text. Please save the file with UTF-8 encoding and try again."
    )

    def error(code: str, message: Column) -> Column:
        return F.struct(F.lit(code).alias("code"), message.alias("message"))

    out = F.when(fmt.isNull(), error("unsupported_format", unsupported)).when(
        ~size_ok(fmt, size), error("file_too_large", too_large)
    )
    return out if content is None else out.when(~utf8_ok(fmt, content), error("invalid_encoding", encoding))


def upload_error(filename: Column | str, size: Column | str) -> Column:
    """Browser-side form of the check: suffix from the last dot, no encoding test."""
    return file_error(_col(filename), _col(size), None, ext=dot_suffix(filename)).code


def classify_error(message: Column | str) -> Column:
    text = F.lower(_col(message))
    out = F.lit(DEFAULT_ERROR)
    for code, words in reversed(ERROR_KEYWORDS):
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(text, F.lit(word))
        out = F.when(hit, code).otherwise(out)
    return out


def error_detail(code: Column | str, message: Column | str) -> Column:
    """STRUCT<supported_formats, max_size_bytes, required_encoding> with the field that belongs to the code."""
    code = _col(code)
    limit = F.when(F.contains(F.lower(_col(message)), F.lit("pdf")), MAX_PDF_BYTES).otherwise(MAX_TEXT_BYTES)
    return F.struct(
        F.when(code == "unsupported_format", F.array(*[F.lit(k) for k in FORMATS])).alias("supported_formats"),
        F.when(code == "file_too_large", limit).cast("long").alias("max_size_bytes"),
        F.when(code == "invalid_encoding", "utf-8").alias("required_encoding"),
    )


def storage_key(document_id: Column | str, filename: Column | str) -> Column:
    return F.concat_ws("/", _col(document_id), F.lit("original"), sanitize_filename(filename))


def mime_type(filename: Column | str) -> Column:
    ext = suffix(filename)
    out = F.lit("application/octet-stream")
    for key, mime in MIME_TYPES.items():
        out = F.when(ext == key, mime).otherwise(out)
    return out


def retention_seconds(raw: str | int | None) -> int:
    """Retention from a job parameter; anything that is not a whole number falls back to the default."""
    try:
        return DEFAULT_RETENTION_SECONDS if raw is None else int(raw)
    except (TypeError, ValueError):
        return DEFAULT_RETENTION_SECONDS


def valid_question(question: Column | str) -> Column:
    return F.coalesce(F.length(_col(question)).between(1, MAX_QUESTION_CHARS), F.lit(False))
