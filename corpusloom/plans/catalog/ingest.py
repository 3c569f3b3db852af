"""Queries over files, texts and chunks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import files as ff
from corpusloom.functions import text as tx
from corpusloom.model import SCANNED_BELOW_CHARS
from corpusloom.operators import ingest as ing
from corpusloom.operators import segment as seg
from corpusloom.plans import corpus
from corpusloom.plans.catalog.registry import query
from corpusloom.session import shared_dir
from corpusloom.sources import store, tables
from corpusloom.sources.files import scan_files as scan

NOW = "2024-05-01 00:00:00"
_EN = ", ".join(f"'{w}'" for w in tx.ENGLISH_STOPWORDS)
_ES = ", ".join(f"'{w}'" for w in tx.SPANISH_STOPWORDS)
_PUNCT = tx.WORD_PUNCTUATION.replace("'", "''")
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def language_sql(source: str) -> str:
    """The stop-word rule over a relation with columns document_id, sample."""
    return rf"""
    words AS (SELECT document_id, lower(substr(sample, 1, 1000)) AS low, list_filter(list_transform(
        regexp_split_to_array(lower(substr(sample, 1, 1000)), '\s+'), lambda w: trim(w, '{_PUNCT}')), lambda w: w <> '') AS ws FROM {source}),
    counted AS (SELECT document_id, len(ws) AS n, len(list_filter(ws, lambda w: w IN ({_EN}))) AS en,
        len(list_filter(ws, lambda w: w IN ({_ES}))) + CASE WHEN contains(low, 'ñ') THEN 3 ELSE 0 END
        + CASE WHEN contains(low, '¿') THEN 3 ELSE 0 END + CASE WHEN contains(low, '¡') THEN 3 ELSE 0 END AS es FROM words),
    lang AS (SELECT document_id, CASE WHEN n < 5 OR en + es = 0 OR greatest(en, es) / n < 0.15 OR greatest(en, es) / (en + es) < 0.6
        THEN 'unknown' WHEN en > es THEN 'en' WHEN es > en THEN 'es' ELSE 'unknown' END AS language FROM counted)"""


_SAMPLE = "smp AS (SELECT document_id, substr(string_agg(text, ' ' ORDER BY ord), 1, 1000) AS sample FROM ch GROUP BY document_id)"


def sections_by_source_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents and sections, in which language, from which source?"""
    docs = corpus.markdown_documents(spark, sf_dir)
    # Section count and language sample come from one pass: the chunk array stays in its document's row.
    chunks = seg.chunk_markdown(docs, keep=("source",))
    head = F.when(F.col("order") <= 1000, F.struct("order", F.substring("text", 1, 1000).alias("t")))
    per_doc = chunks.groupBy("document_id", "source").agg(
        F.count("*").alias("chunks"),
        F.substring(
            F.array_join(F.transform(F.array_sort(F.collect_list(head)), lambda c: c.t), " "), 1, 1000
        ).alias("sample"),
    )
    return (
        per_doc.withColumn("language", tx.detect_language("sample"))
        .groupBy("source", "language")
        .agg(F.count("*").alias("documents"), F.sum("chunks").alias("chunks"))
    )


query(f"""WITH {_SAMPLE}, {language_sql('smp')},
    per AS (SELECT document_id, count(*) AS n FROM ch GROUP BY document_id)
    SELECT d.source, language, count(*) AS documents, CAST(sum(n) AS BIGINT) AS chunks
    FROM lang JOIN per USING (document_id) JOIN d USING (document_id) GROUP BY d.source, language""")(sections_by_source_language)


@query()
def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir).select("filename", "length", "document_id")


@query("""SELECT document_id, filename AS original_filename, length AS size_bytes, 'processing' AS status,
    TIMESTAMP '2024-05-01 00:00:00' AS upload_timestamp, TIMESTAMP '2024-05-02 00:00:00' AS expires_at FROM fl""")
def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.files(spark, sf_dir).withColumn("format", ff.detect_format("filename"))
    out = ing.document_records(files, F.lit(NOW).cast("timestamp"), ff.retention_seconds("not a number"))
    return out.select("document_id", "original_filename", "size_bytes", "status", "upload_timestamp", "expires_at")


@query("""SELECT document_id, filename, CASE doc_id % 5 WHEN 0 THEN 'markdown' WHEN 1 THEN 'plain_text' WHEN 2 THEN 'pdf' END AS format,
    CASE doc_id % 5 WHEN 0 THEN 'markdown' WHEN 1 THEN 'plain_text' WHEN 2 THEN 'pdf' END AS reader,
    document_id || '/original/' || filename AS storage_key, CASE doc_id % 5 WHEN 0 THEN 'text/markdown' WHEN 1 THEN 'text/plain'
    WHEN 2 THEN 'application/pdf' ELSE 'application/octet-stream' END AS mime FROM fl""")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.files(spark, sf_dir).select(
        "document_id",
        "filename",
        ff.detect_format("filename").alias("format"),
        ff.route_format("filename").alias("reader"),
        ff.storage_key("document_id", "filename").alias("storage_key"),
        ff.mime_type("filename").alias("mime"),
    )


_REJECTED = """rej AS (SELECT document_id, filename, length, CASE WHEN doc_id % 5 > 2 THEN 'unsupported_format' WHEN length >
    CASE WHEN doc_id % 5 = 2 THEN 10485760 ELSE 1048576 END THEN 'file_too_large' END AS error_code,
    CASE doc_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.pdf' WHEN 3 THEN '.docx' ELSE '(none)' END AS ext FROM fl),
    msg AS (SELECT document_id, filename, length, error_code, CASE error_code WHEN 'unsupported_format' THEN 'File format ''' || ext ||
    ''' is not supported. Please upload a file with one of these extensions: .md, .txt, .pdf' ELSE
    'File exceeds the maximum allowed size of ' || CASE ext WHEN '.pdf' THEN '10' ELSE '1' END || ' MB for ' || ext ||
    ' files. Please reduce the file size and try again.' END AS error_message FROM rej WHERE error_code IS NOT NULL)"""


@query(f"WITH {_REJECTED} SELECT * FROM msg")
def rejected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = ing.validate_files(corpus.files(spark, sf_dir)).rejected
    return rejected.select("document_id", "filename", "length", "error_code", "error_message")


@query(f"""WITH {_REJECTED} SELECT fl.document_id, CASE doc_id % 5 WHEN 0 THEN 'markdown' WHEN 1 THEN 'plain_text' ELSE 'pdf' END AS format
    FROM fl WHERE document_id NOT IN (SELECT document_id FROM msg)""")
def accepted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ing.validate_files(corpus.files(spark, sf_dir)).accepted.select("document_id", "format")


@query("""SELECT page_id, 'unsupported_format' AS error_code FROM pages""")
def rejected_web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = corpus.table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".html")).alias("filename"),
        F.octet_length("html").cast("long").alias("length"),
        F.col("html").cast("binary").alias("content"),
    )
    return ing.validate_files(pages).rejected.select("page_id", "error_code")


@query(f"""WITH {_REJECTED} SELECT document_id, CASE WHEN contains(lower(error_message), 'scanned') THEN 'scanned_pdf'
    WHEN contains(lower(error_message), 'not supported') OR contains(lower(error_message), 'unsupported') THEN 'unsupported_format'
    WHEN contains(lower(error_message), 'exceeds') OR contains(lower(error_message), 'too large') OR contains(lower(error_message), 'size')
    THEN 'file_too_large' WHEN contains(lower(error_message), 'utf-8') OR contains(lower(error_message), 'encoding') THEN 'invalid_encoding'
    ELSE 'extraction_failed' END AS code, CASE WHEN error_code = 'unsupported_format' THEN '.md .txt .pdf' END AS supported_formats,
    CAST(CASE WHEN error_code = 'file_too_large' THEN CASE WHEN contains(lower(error_message), 'pdf') THEN 10485760 ELSE 1048576 END END AS BIGINT)
    AS max_size_bytes FROM msg""")
def error_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = ing.validate_files(corpus.files(spark, sf_dir)).rejected
    coded = rejected.withColumn("code", ff.classify_error("error_message"))
    detail = coded.withColumn("d", ff.error_detail("code", "error_message"))
    return detail.select(
        "document_id",
        "code",
        F.when(F.col("d.supported_formats").isNotNull(), F.array_join("d.supported_formats", " ")).alias("supported_formats"),
        "d.max_size_bytes",
    )


@query("""SELECT document_id, CASE WHEN doc_id % 5 > 2 THEN 'unsupported_format' WHEN length > CASE WHEN doc_id % 5 = 2 THEN 10485760
    ELSE 1048576 END THEN 'file_too_large' END AS error_code FROM fl""")
def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.files(spark, sf_dir).select("document_id", ff.upload_error("filename", "length").alias("error_code"))


@query("""SELECT document_id, chunk_id, ord, section, text FROM ch""")
def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.chunks(spark, sf_dir).select(
        "document_id", "chunk_id", F.col("order").alias("ord"), F.col("structural_context.section").alias("section"), "text"
    )


# Plain text with underlined headings: every line whose index is 2 modulo 5 gets an underline, every 7th a double one.
def _underlined(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.when((i % 5 == 2) & (i % 7 == 3), F.concat(line, F.lit("\n====\n---")))
        .when(i % 5 == 2, F.concat(line, F.lit("\n-----")))
        .otherwise(line),
    )
    return corpus.raw_documents(spark, sf_dir).select("document_id", F.array_join(lines, "\n").alias("text"))


@query(rf"""WITH RECURSIVE ul AS (SELECT doc_id, document_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, j:
        CASE WHEN (j - 1) % 5 = 2 AND (j - 1) % 7 = 3 THEN x || chr(10) || '====' || chr(10) || '---' WHEN (j - 1) % 5 = 2
        THEN x || chr(10) || '-----' ELSE x END), chr(10)) AS text FROM d),
    pl AS (SELECT doc_id, document_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM ul),
    fl2 AS (SELECT *, trim(line, {_WS}) AS s, lead(trim(line, {_WS})) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM pl),
    cand AS (SELECT *, s <> '' AND coalesce(regexp_matches(nx, '^(={{3,}}|-{{3,}})$'), false) AS c,
        regexp_matches(line, '\p{{L}}[^\p{{L}}]*\p{{L}}') AND NOT regexp_matches(line, '[\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]') AS caps FROM fl2),
    runs AS (SELECT *, i - max(CASE WHEN c THEN 0 ELSE i END) OVER (PARTITION BY doc_id ORDER BY i) AS nth FROM cand),
    role AS (SELECT *, c AND nth % 2 = 1 AS head FROM runs),
    used AS (SELECT *, coalesce(lag(head) OVER (PARTITION BY doc_id ORDER BY i), false) AS skipped FROM role),
    sec AS (SELECT *, sum(CASE WHEN NOT skipped AND (head OR caps) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sc FROM used),
    pcs AS (SELECT doc_id, document_id, sc, trim(string_agg(line, chr(10) ORDER BY i) FILTER (NOT skipped), {_WS}) AS text,
        CASE WHEN sc = 0 THEN '(document)' ELSE first(s ORDER BY i) END AS section FROM sec GROUP BY doc_id, document_id, sc)
    SELECT document_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sc) - 1 AS INTEGER) AS ord, section, text FROM pcs WHERE text <> ''""")
def chunk_plaintext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.chunk_plaintext(_underlined(spark, sf_dir)).select(
        "document_id", F.col("order").alias("ord"), F.col("structural_context.section").alias("section"), "text"
    )


_PACK = rf"""ps AS (SELECT document_id, page, trim(text, {_WS}) AS t FROM pg),
    par AS (SELECT document_id, page, t, list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda x: trim(x, {_WS})), lambda x: x <> '') AS ps FROM ps WHERE t <> ''),
    fold AS (SELECT document_id, page, 1 AS i, ps, ps[1] AS cur, CAST([] AS VARCHAR[]) AS done FROM par WHERE length(t) > 400
        UNION ALL SELECT document_id, page, i + 1, ps, CASE WHEN length(cur) + 2 + length(ps[i + 1]) > 400 THEN ps[i + 1]
            ELSE cur || chr(10) || chr(10) || ps[i + 1] END, CASE WHEN length(cur) + 2 + length(ps[i + 1]) > 400 THEN list_append(done, cur) ELSE done END
        FROM fold WHERE i < len(ps)),
    pieces AS (SELECT document_id, page, list_append(done, cur) AS out FROM fold WHERE i = len(ps)
        UNION ALL SELECT document_id, page, [t] FROM ps WHERE t <> '' AND length(t) <= 400),
    ex AS (SELECT document_id, page, unnest(out) AS text, generate_subscripts(out, 1) AS k FROM pieces)"""


@query(f"""WITH RECURSIVE {_PACK} SELECT document_id, page, text,
    CAST(row_number() OVER (PARTITION BY document_id ORDER BY page, k) - 1 AS INTEGER) AS ord FROM ex""")
def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.chunk_pages(corpus.pages(spark, sf_dir), limit=400).select(
        "document_id", F.col("structural_context.page").alias("page"), "text", F.col("order").alias("ord")
    )


@query("""SELECT document_id, md5(string_agg(text, chr(10) ORDER BY ord)) AS digest, CAST(length(string_agg(text, chr(10) ORDER BY ord)) AS BIGINT) AS chars
    FROM ch GROUP BY document_id""")
def full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = seg.full_text(corpus.stored(spark, sf_dir, "chunks"))
    return out.select("document_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("chars"))


@query(f"WITH {_SAMPLE} SELECT * FROM smp")
def language_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.language_sample(corpus.stored(spark, sf_dir, "chunks"))


@query("""WITH pre AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS before FROM ch) SELECT document_id, string_agg(substr(text, 1, CAST(2000 - before AS BIGINT)), chr(10) ORDER BY ord) AS sample FROM pre WHERE before < 2000 GROUP BY document_id""")
def type_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.type_sample(corpus.stored(spark, sf_dir, "chunks"))


@query("""WITH RECURSIVE tot AS (SELECT doc_id, sum(length(text)) + count(*) - 1 AS t FROM ch GROUP BY doc_id),
    walk AS (SELECT doc_id, ord, length(text) AS size, 0 AS seg FROM ch WHERE ord = 0
        UNION ALL SELECT c.doc_id, c.ord, CASE WHEN w.size > 0 AND w.size + length(c.text) > 3000 THEN length(c.text) ELSE w.size + length(c.text) END,
            CASE WHEN w.size > 0 AND w.size + length(c.text) > 3000 THEN w.seg + 1 ELSE w.seg END
        FROM walk w JOIN ch c ON c.doc_id = w.doc_id AND c.ord = w.ord + 1)
    SELECT CAST(doc_id AS VARCHAR) AS document_id, ord, CAST(CASE WHEN t > 3000 THEN seg ELSE 0 END AS INTEGER) AS segment FROM walk JOIN tot USING (doc_id)""")
def segment_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = seg.segment_chunks(corpus.stored(spark, sf_dir, "chunks"), limit=3000)
    return out.select("document_id", F.col("order").alias("ord"), "segment")


@query("SELECT document_id, string_agg(chunk_id || '=' || section, '|' ORDER BY ord) AS contexts FROM ch GROUP BY document_id")
def structural_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = seg.structural_contexts(corpus.stored(spark, sf_dir, "chunks"))
    joined = F.array_join(F.transform("contexts", lambda c: F.concat(c.chunk_id, F.lit("="), c.section)), "|")
    return out.select("document_id", joined.alias("contexts"))


@query(f"WITH raw AS (SELECT document_id, text AS sample FROM d), {language_sql('raw')} SELECT document_id, language FROM lang")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.raw_documents(spark, sf_dir).select("document_id", tx.detect_language("text").alias("language"))


@query(r"""SELECT document_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM d""")
def normalize_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.raw_documents(spark, sf_dir).select("document_id", F.md5(tx.normalize_ws("text")).alias("digest"))


@query(r"""SELECT page_id, CASE WHEN s = '' THEN 'unnamed_file' ELSE s END AS safe FROM (SELECT page_id, trim(regexp_replace(regexp_replace(
    regexp_replace(replace(regexp_extract(url, '[^/]*$'), chr(92), '_'), '\.{2,}', '.', 'g'), '[^\p{L}\p{N}_.\-]', '_', 'g'), '_+', '_', 'g'), '_.') AS s FROM pages)""")
def sanitize_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "pages").select("page_id", tx.sanitize_filename("url").alias("safe"))


@query("""SELECT document_id, pos, CASE WHEN length(content) > 40 THEN substr(content, 1, 40) || '…' ELSE content END AS preview,
    CAST(floor((pos % 8) / 8.0 * 100 + 0.5) AS INTEGER) AS percent, CASE WHEN verified THEN content ELSE '[UNVERIFIED] ' || content END AS marked,
    CAST(greatest(1, floor(length(id || ' ' || type || ' ' || name || ' ' || content || ' ' || evidence) / 4)) AS BIGINT) AS tokens,
    CAST(greatest(0, least(10, pos - 3)) AS INTEGER) AS clamped, substr(content, 1, 30) AS short FROM el""")
def element_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.stored(spark, sf_dir, "flagged_elements").select(
        "document_id",
        "pos",
        tx.evidence_preview("content", 40).alias("preview"),
        tx.rate_percent((F.col("pos") % 8) / F.lit(8.0)).alias("percent"),
        tx.annotate_unverified("content", "verified").alias("marked"),
        tx.element_tokens(F.col("id"), F.col("type"), F.col("name"), F.col("content"), F.col("source_ref.evidence")).alias("tokens"),
        tx.clamp_score(F.col("pos") - 3).alias("clamped"),
        tx.truncate("content", 30).alias("short"),
    )


@query("""SELECT document_id, ord, '[chunk_id=' || chunk_id || ']' AS by_id, '[chunk_id=' || chunk_id || ', section=' || section || ']' AS by_fields,
    '[chunk:' || chunk_id || '] [section:' || section || ']' AS by_tags FROM ch""")
def chunk_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = F.col("structural_context")
    return corpus.stored(spark, sf_dir, "chunks").select(
        "document_id",
        F.col("order").alias("ord"),
        *[tx.chunk_label(s, "chunk_id", ctx.page, ctx.section).alias(f"by_{s}") for s in ("id", "fields", "tags")],
    )


@query("""SELECT document_id, count(*) AS chunk_count, doc_id % 5 <> 0 AS sequential, doc_id % 7 <> 0 OR count(*) < 2 AS unique_ids
    FROM ch GROUP BY document_id, doc_id""")
def check_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("document_id").cast("long")
    defective = corpus.stored(spark, sf_dir, "chunks").withColumns(
        {
            "order": F.when(doc % 5 == 0, F.col("order") + 1).otherwise(F.col("order")),
            "chunk_id": F.when((doc % 7 == 0) & (F.col("order") == 1), "chunk-000").otherwise(F.col("chunk_id")),
        }
    )
    return ing.check_chunks(defective)


@query(f"""WITH per AS (SELECT document_id, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS pages FROM pg GROUP BY document_id)
    SELECT document_id, pages, chars, chars < 50 AS scanned FROM per""")
def scanned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.scanned_documents(corpus.pages(spark, sf_dir), SCANNED_BELOW_CHARS)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document table with all three states: by id failed, processing or ready."""
    doc = F.col("doc_id")
    return corpus.raw_documents(spark, sf_dir).select(
        "document_id",
        F.concat(F.lit("doc-"), "document_id", F.lit(".md")).alias("original_filename"),
        F.lit("markdown").alias("format"),
        F.col("n_chars").alias("size_bytes"),
        F.lit("unknown").alias("language"),
        F.lit(NOW).cast("timestamp").alias("upload_timestamp"),
        F.array().cast("array<string>").alias("warnings"),
        F.when(doc % 9 == 0, "failed").when(doc % 8 == 0, "processing").otherwise("ready").alias("status"),
        F.when(doc % 9 == 0, "Extraction failed: unreadable").alias("error_message"),
        F.timestamp_seconds(F.unix_timestamp(F.lit(NOW).cast("timestamp")) + doc % 40 * 86400).alias("expires_at"),
    )


_STATUS = "CASE WHEN doc_id % 9 = 0 THEN 'failed' WHEN doc_id % 8 = 0 THEN 'processing' ELSE 'ready' END"


@query(f"""WITH n AS (SELECT document_id, count(*) AS c FROM ch GROUP BY document_id) SELECT d.document_id, {_STATUS} AS status,
    'doc-' || d.document_id || '.md' AS filename, CASE WHEN {_STATUS} = 'ready' THEN coalesce(c, 0) END AS chunk_count FROM d LEFT JOIN n USING (document_id)""")
def document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ing.document_status(_records(spark, sf_dir), corpus.stored(spark, sf_dir, "chunks"))
    return out.select("document_id", "status", "filename", "chunk_count")


@query("""SELECT d.document_id, (SELECT count(*) FROM ch WHERE ch.document_id = d.document_id) AS chunks_left FROM d
    WHERE NOT (TIMESTAMP '2024-05-01 00:00:00' + to_days(CAST(doc_id % 40 AS INTEGER)) < TIMESTAMP '2024-06-01 00:00:00')""")
def purge_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = ing.purge_expired(
        _records(spark, sf_dir), F.lit(corpus.AS_OF).cast("timestamp"), chunks=corpus.stored(spark, sf_dir, "chunks")
    )
    counts = ing.chunk_counts(left.dependents["chunks"])
    return left.documents.join(counts, "document_id", "left").select(
        "document_id", F.coalesce("chunk_count", F.lit(0)).alias("chunks_left")
    )


_IR = f"""SELECT d.document_id, coalesce(n, 0) AS chunk_count, coalesce(dg, '') AS digest FROM d LEFT JOIN (SELECT document_id, count(*) AS n,
    md5(string_agg(chunk_id || text, '|' ORDER BY ord)) AS dg FROM ch GROUP BY document_id) USING (document_id) WHERE {_STATUS} = 'ready'"""


def _ir_digest(ir: DataFrame) -> DataFrame:
    joined = F.array_join(F.transform("chunks", lambda c: F.concat(c.chunk_id, c.text)), "|")
    return ir.select(
        "document_id",
        F.size("chunks").cast("long").alias("chunk_count"),
        F.when(F.size("chunks") > 0, F.md5(joined)).otherwise("").alias("digest"),
    )


@query(_IR)
def ir_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ir_digest(ing.ir_view(_records(spark, sf_dir), corpus.stored(spark, sf_dir, "chunks")))


@query(_IR)
def ir_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to a store and read back."""
    path = f"{shared_dir(spark)}/ir-{uuid.uuid4().hex}"
    tables.write_ir(_records(spark, sf_dir), corpus.stored(spark, sf_dir, "chunks"), path)
    return _ir_digest(tables.read_ir(spark, path))


@query(f"""WITH {_SAMPLE}, {language_sql('smp')}, n AS (SELECT document_id, count(*) AS c FROM ch GROUP BY document_id)
    SELECT document_id, coalesce(language, 'unknown') AS language, coalesce(c, 0) AS chunk_count, 'ready' AS status
    FROM d LEFT JOIN lang USING (document_id) LEFT JOIN n USING (document_id)""")
def ingest_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain on the corpus as markdown files of their true size."""
    files = corpus.markdown_documents(spark, sf_dir).select(
        "document_id",
        F.concat(F.lit("doc-"), "document_id", F.lit(".md")).alias("filename"),
        F.octet_length("text").cast("long").alias("length"),
        F.col("text").cast("binary").alias("content"),
    )
    done = ing.ingest(files, F.lit(NOW).cast("timestamp"))
    counts = ing.chunk_counts(done.chunks)
    return done.documents.join(counts, "document_id", "left").select(
        "document_id", "language", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "status"
    )


@query("""SELECT format, status, count(*) AS documents FROM (SELECT CASE doc_id % 5 WHEN 0 THEN 'markdown' WHEN 1 THEN 'plain_text' WHEN 2 THEN 'pdf' END AS format,
    CASE WHEN doc_id % 5 > 2 THEN 'rejected' WHEN doc_id % 5 = 2 AND coalesce((SELECT sum(length(text)) FROM pg WHERE pg.document_id = fl.document_id), 0) < 50
    THEN 'failed' ELSE 'ready' END AS status FROM fl) GROUP BY format, status""")
def ingest_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All formats at once, page text standing in for paged files."""
    files = corpus.files(spark, sf_dir).withColumn("length", F.octet_length("content").cast("long"))
    pages = corpus.pages(spark, sf_dir)
    done = ing.ingest(files, F.lit(NOW).cast("timestamp"), pages=pages)
    rejected = done.rejected.select(F.lit(None).cast("string").alias("format"), F.lit("rejected").alias("status"))
    return (
        done.documents.select("format", "status")
        .unionByName(rejected)
        .groupBy("format", "status")
        .agg(F.count("*").alias("documents"))
    )


def _new_store(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"""WITH v AS (SELECT doc_id, document_id, 'doc-' || document_id || CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '.md' END AS original_filename,
    CASE WHEN doc_id % 2 = 0 THEN 'ready' ELSE {_STATUS} END AS status FROM d),
    c AS (SELECT document_id, chunk_id, ord, text FROM ch WHERE doc_id % 2 <> 0
        UNION ALL SELECT document_id, 'chunk-000', 0, 'again: ' || text FROM d WHERE doc_id % 6 IN (2, 4)),
    n AS (SELECT document_id, count(*) AS n, md5(string_agg(chunk_id || text, '|' ORDER BY ord)) AS dg FROM c GROUP BY document_id)
    SELECT document_id, original_filename, coalesce(n, 0) AS chunk_count, coalesce(dg, '') AS digest FROM v LEFT JOIN n USING (document_id)
    WHERE status = 'ready'""")
def write_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything written, then every other document once more: under a new name, as one chunk or none."""
    path = _new_store(spark, "twice")
    records = _records(spark, sf_dir)
    tables.write_ir(records, corpus.stored(spark, sf_dir, "chunks"), path, buckets=16)
    even = F.col("document_id").cast("long") % 2 == 0
    again = records.where(even).withColumns(
        {"original_filename": F.concat(F.lit("doc-"), "document_id", F.lit(".txt")), "status": F.lit("ready")}
    )
    whole = corpus.raw_documents(spark, sf_dir).where((F.col("doc_id") % 6).isin(2, 4)).select(
        "document_id",
        F.lit("chunk-000").alias("chunk_id"),
        F.concat(F.lit("again: "), "text").alias("text"),
        F.struct(F.lit(None).cast("int").alias("page"), F.lit("(document)").alias("section")).alias("structural_context"),
        F.lit(0).alias("order"),
    )
    tables.write_ir(again, whole, path)
    ir = tables.read_ir(spark, path)
    return _ir_digest(ir).join(ir.select("document_id", "original_filename"), "document_id")


@query("""WITH x AS (SELECT document_id, TIMESTAMP '2024-05-01 00:00:00' + to_days(CAST(doc_id % 40 AS INTEGER)) < TIMESTAMP '2024-06-01 00:00:00' AS deleted FROM d)
    SELECT document_id, deleted, CASE WHEN deleted THEN 0 ELSE (SELECT count(*) FROM ch WHERE ch.document_id = x.document_id) END AS chunks_left,
    CASE WHEN deleted THEN 0 ELSE (SELECT count(*) FROM se WHERE se.document_id = x.document_id) END AS events_left FROM x""")
def purge_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expired documents deleted from stored tables, their chunks and session events with them."""
    path = _new_store(spark, "purged")
    tables.write_ir(_records(spark, sf_dir), corpus.stored(spark, sf_dir, "chunks"), path, buckets=16)
    tables.add_session_events(corpus.session_events(spark, sf_dir), path)
    gone = tables.purge_stored(spark, path, F.lit(corpus.AS_OF).cast("timestamp")).select("document_id", F.lit(True).alias("deleted"))
    every = store.read(spark, path, "documents").select("document_id", F.lit(False).alias("deleted")).unionByName(gone)
    for name, out in (("chunks", "chunks_left"), ("session_events", "events_left")):
        left = store.read(spark, path, name).groupBy("document_id").agg(F.count("*").alias(out))
        every = every.join(left, "document_id", "left")
    return every.na.fill(0, ["chunks_left", "events_left"])


@query("""SELECT document_id, CASE doc_id % 5 WHEN 1 THEN 'invalid_encoding' WHEN 2 THEN 'invalid_encoding' WHEN 3 THEN 'invalid_encoding' END AS error_code FROM d""")
def check_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stray byte, a cut sequence, a surrogate, and good text with letters of several bytes."""
    doc = F.col("doc_id")
    tail = F.when(doc % 5 == 1, "FF").when(doc % 5 == 2, "C3").when(doc % 5 == 3, "EDA080").when(doc % 5 == 4, "C3A9E282AC").otherwise("")
    files = corpus.raw_documents(spark, sf_dir).select(
        "document_id",
        F.concat(F.lit("doc-"), "document_id", F.lit(".txt")).alias("filename"),
        F.lit(100).cast("long").alias("length"),
        F.concat(F.col("text").cast("binary"), F.unhex(tail)).alias("content"),
    )
    checked = ing.validate_files(files)
    accepted = checked.accepted.select("document_id", F.lit(None).cast("string").alias("error_code"))
    return accepted.unionByName(checked.rejected.select("document_id", "error_code"))
