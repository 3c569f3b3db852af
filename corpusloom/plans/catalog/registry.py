"""Query registry, and the SQL twins of the derived tables."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.session import REPLY_SETTINGS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

# Derived tables as common table expressions, in dependency order; `with_views` picks those a query names.
VIEWS = {
    "d": "SELECT doc_id, CAST(doc_id AS VARCHAR) AS document_id, text, source, n_chars FROM documents",
    "md": """SELECT doc_id, document_id, source, array_to_string(list_transform(string_split(text, chr(10)),
        lambda x, i: CASE WHEN (i - 1) % 4 = 1 AND trim(x) <> '' THEN '## ' || x ELSE x END), chr(10)) AS text FROM d""",
    "ln": """SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS i FROM md""",
    "ls": r"""SELECT *, sum(CASE WHEN regexp_matches(line, '^#{1,2}\s+.') THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM ln""",
    "st": f"""SELECT doc_id, sec, trim(string_agg(line, chr(10) ORDER BY i), {_WS}) AS text,
        CASE WHEN sec = 0 THEN '(preamble)' ELSE first(line ORDER BY i) END AS section FROM ls GROUP BY doc_id, sec""",
    "ch": """SELECT doc_id, CAST(doc_id AS VARCHAR) AS document_id, text, section,
        CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS INTEGER) AS ord,
        printf('chunk-%03d', row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1) AS chunk_id
        FROM st WHERE text <> ''""",
    "el0": """SELECT document_id, doc_id, CAST(ord AS BIGINT) AS pos, printf('elem-%03d', ord + 1) AS id,
        ['proposito', 'concepto', 'actor', 'regla', 'proceso', 'restriccion'][ord % 6 + 1] AS type,
        substr(text, 1, 24) AS name, substr(text, 1, 200) AS content,
        printf('chunk-%03d', CASE WHEN (doc_id + ord) % 11 = 0 THEN ord + 1 ELSE ord END) AS chunk_id,
        substr(text, 5, 60) AS q, (doc_id + ord) AS k FROM ch""",
    "el": """SELECT document_id, doc_id, pos, id, type, name, content, chunk_id, CASE WHEN k % 13 = 0 THEN ''
        WHEN k % 7 = 0 THEN reverse(q) WHEN k % 5 = 0 THEN substr(q, 1, 30) || '#' || substr(q, 32, 60) ELSE q END AS evidence,
        (doc_id + pos) % 3 <> 0 AS verified FROM el0""",
    "re": """SELECT document_id, doc_id, pos AS element_pos, 0 AS pos, id AS source_id, printf('elem-%03d', pos + 2) AS target_id,
            ['contradicts', 'depends_on', 'constrains'][pos % 3 + 1] AS type,
            CASE WHEN pos % 2 = 0 THEN 'edge of ' || id END AS description FROM el
        UNION ALL SELECT document_id, doc_id, pos, 1, id, CASE WHEN doc_id % 4 = 0 THEN 'elem-999999' ELSE 'elem-001' END,
            'participates_in', NULL FROM el WHERE pos % 2 = 1
        UNION ALL SELECT document_id, doc_id, pos, 2, id, printf('elem-%03d', pos), 'contradicts', NULL FROM el WHERE pos % 6 = 1""",
    "rk": """SELECT r.* FROM re r JOIN el e ON r.document_id = e.document_id AND r.target_id = e.id""",
    "ty": "SELECT document_id, ['prd', 'technical_spec', 'policy_process', 'generic'][doc_id % 4 + 1] AS document_type FROM d",
    "qu": """SELECT conv_id || '-' || turn AS question_id,
        CAST(conv_id % (SELECT count(*) FROM documents) AS VARCHAR) AS document_id, text AS question, conv_id, turn
        FROM conversations WHERE role = 'user'""",
    "sr": """SELECT q.question_id, q.document_id, e.id, e.pos, CAST((e.doc_id * 7 + e.pos * 3 + q.conv_id + q.turn) % 11 AS INTEGER)
        AS score FROM qu q JOIN el e ON q.document_id = e.document_id""",
    "fl": """SELECT document_id, doc_id, 'doc-' || document_id || ['.md', '.txt', '.pdf', '.docx', ''][doc_id % 5 + 1] AS filename,
        CAST(n_chars * CASE WHEN doc_id % 10 = 0 THEN 2000 ELSE 1 END AS BIGINT) AS length, text FROM d""",
    "pg": """SELECT document_id, CAST(p + 1 AS INTEGER) AS page, array_to_string(lines[p * 3 + 1 : p * 3 + 3], chr(10) || chr(10)) AS text
        FROM (SELECT document_id, string_split(text, chr(10)) AS lines,
            unnest(range(CAST(ceil(len(string_split(text, chr(10))) / 3.0) AS BIGINT))) AS p FROM d)""",
    "se": """SELECT CAST(user_id AS VARCHAR) AS document_id, CASE WHEN event_type = 'error' THEN 'quality' ELSE 'analysis' END AS track,
        event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'inferring_type' WHEN 'view' THEN 'awaiting_confirmation'
        WHEN 'click' THEN 'extracting' WHEN 'purchase' THEN 'completed'
        ELSE ['analyzing', 'analyzing_contradictions', 'completed', 'failed'][event_id % 4 + 1] END AS status, props AS payload FROM events""",
    "cu": """SELECT document_id, max_by(status, seq) FILTER (track = 'analysis') AS status,
        max_by(payload, seq) FILTER (track = 'analysis') AS payload, max_by(status, seq) FILTER (track = 'quality') AS quality_status,
        max_by(payload, seq) FILTER (track = 'quality') AS quality_payload FROM se GROUP BY document_id""",
    "fi": """SELECT document_id, 'contra-struct-' || substr(sha256(document_id || chr(31) || source_id || chr(31) || target_id), 1, 16) AS finding_id,
        element_pos, pos, source_id, target_id, 'contradiction' AS type, description, s_name, t_name, s_verified, t_verified,
        s_chunk, t_chunk, s_evidence, t_evidence FROM (
        SELECT r.*, row_number() OVER (PARTITION BY r.document_id, least(source_id, target_id), greatest(source_id, target_id)
            ORDER BY element_pos, r.pos, target_id) AS n, s.name AS s_name, t.name AS t_name, s.verified AS s_verified,
            t.verified AS t_verified, s.chunk_id AS s_chunk, t.chunk_id AS t_chunk, s.evidence AS s_evidence, t.evidence AS t_evidence
        FROM re r JOIN el s ON s.document_id = r.document_id AND s.id = source_id
        LEFT JOIN el t ON t.document_id = r.document_id AND t.id = target_id WHERE r.type = 'contradicts') WHERE n = 1 AND t_name IS NOT NULL""",
}


def with_views(body: str) -> str:
    """Prefix `body` with the derived tables it uses."""
    needed: set[str] = set()
    pending = [body]
    while pending:
        text = pending.pop()
        for name in VIEWS:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                pending.append(VIEWS[name])
    views = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in VIEWS if n in needed)
    if not views:
        return body
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body)
    if own is None:
        return f"WITH {views}\n{body}"
    return f"WITH {own.group(1) or ''}{views},\n{body[own.end():]}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name.

    A registered query is a whole job: it makes the settings that replies are read with on the session it is given.
    """

    def register(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            for name, value in REPLY_SETTINGS.items():
                spark.conf.set(name, value)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = with_views(sql)
        return fn

    return register
