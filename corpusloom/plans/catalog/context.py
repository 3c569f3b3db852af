"""Queries that choose what a question gets to see."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import context as cx
from corpusloom.plans import corpus
from corpusloom.plans.catalog.graph import els, rels
from corpusloom.plans.catalog.registry import query

WINDOW = 1_000  # small, so that the budget of 600 tokens binds
BUDGET = int(WINDOW * 0.6)


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return corpus.stored(spark, sf_dir, "questions"), els(spark, sf_dir), corpus.stored(spark, sf_dir, "scores")


# Ranked elements, one hop, and the three budget prefixes, as the sequential rule states them.
_STEPS = """rel AS (SELECT s.question_id, s.score, e.*, row_number() OVER (PARTITION BY question_id, e.document_id
        ORDER BY score DESC, verified DESC, e.pos) AS rank FROM sr s JOIN el e ON e.document_id = s.document_id AND e.id = s.id WHERE score > 0),
    top AS (SELECT *, greatest(1, length(id || ' ' || type || ' ' || name || ' ' || CASE WHEN verified THEN '' ELSE '[UNVERIFIED] ' END || content
        || ' ' || evidence) // 4) AS tokens FROM rel WHERE rank <= 20),
    dir AS (SELECT * FROM (SELECT *, sum(tokens) OVER (PARTITION BY question_id ORDER BY rank) AS cum FROM top) WHERE cum <= 600),
    hop AS (SELECT DISTINCT t.question_id, e.* FROM top t JOIN re r ON r.document_id = t.document_id AND r.source_id = t.id
        JOIN el e ON e.document_id = r.document_id AND e.id = r.target_id
        WHERE NOT EXISTS (SELECT 1 FROM top x WHERE x.question_id = t.question_id AND x.id = e.id)),
    ht AS (SELECT *, greatest(1, length(id || ' ' || type || ' ' || name || ' ' || CASE WHEN verified THEN '' ELSE '[UNVERIFIED] ' END || content
        || ' ' || evidence) // 4) AS tokens FROM hop),
    du AS (SELECT question_id, sum(tokens) AS used FROM dir GROUP BY question_id),
    hf AS (SELECT * FROM (SELECT ht.*, coalesce(used, 0) + sum(tokens) OVER (PARTITION BY ht.question_id ORDER BY verified DESC, name, id
        ROWS UNBOUNDED PRECEDING) AS cum FROM ht LEFT JOIN du USING (question_id)) WHERE cum <= 600),
    inc AS (SELECT question_id, document_id, id, tokens, verified, 'direct' AS role FROM dir UNION ALL
        SELECT question_id, document_id, id, tokens, verified, 'related' FROM hf),
    ed AS (SELECT * FROM (SELECT d.question_id, d.document_id, d.rank, r.source_id, r.target_id, r.type, r.description, r.element_pos, r.pos,
        row_number() OVER (PARTITION BY d.question_id, r.source_id, r.target_id, r.type ORDER BY r.pos) AS n,
        greatest(1, length(source_id || ' ' || target_id || ' ' || r.type || ' ' || coalesce(description, '')) // 4) AS tokens
        FROM dir d JOIN re r ON r.document_id = d.document_id AND r.source_id = d.id
        JOIN inc i ON i.question_id = d.question_id AND i.id = r.target_id) WHERE n = 1),
    iu AS (SELECT question_id, sum(tokens) AS used FROM inc GROUP BY question_id),
    ef AS (SELECT * FROM (SELECT ed.*, used + sum(tokens) OVER (PARTITION BY ed.question_id ORDER BY rank, pos, target_id
        ROWS UNBOUNDED PRECEDING) AS cum FROM ed JOIN iu USING (question_id)) WHERE cum <= 600)"""


@query("""SELECT q.question_id, e.document_id, e.id, CASE WHEN q.conv_id % 7 = 0 THEN 1 WHEN e.pos % 4 = 3 THEN 0 ELSE s.score END AS score
    FROM qu q JOIN el e ON e.document_id = q.document_id JOIN sr s ON s.question_id = q.question_id AND s.id = e.id""")
def attach_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth score missing; the questions of every seventh conversation not scored at all."""
    q, e, s = _inputs(spark, sf_dir)
    out = cx.attach_scores(q, e, s.where(F.col("pos") % 4 != 3), unscored=q.where(F.col("conv_id") % 7 == 0))
    return out.select("question_id", "document_id", "id", "score")


@query(f"WITH {_STEPS} SELECT question_id, document_id, id, CAST(rank AS INTEGER) AS rank, score FROM rel WHERE rank <= 20")
def rank_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cx.rank_relevant(cx.relevant_elements(*_inputs(spark, sf_dir)))
    return out.select("question_id", "document_id", "id", "rank", "score")


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cx.with_tokens(cx.rank_relevant(cx.relevant_elements(*_inputs(spark, sf_dir))))


@query(f"WITH {_STEPS} SELECT question_id, document_id, id FROM hop")
def one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cx.one_hop(_ranked(spark, sf_dir), rels(spark, sf_dir), els(spark, sf_dir))
    return out.select("question_id", "document_id", "id")


@query(f"WITH {_STEPS} SELECT question_id, document_id, id, CAST(tokens AS BIGINT) AS tokens FROM dir")
def budget_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cx.budget_direct(_ranked(spark, sf_dir), BUDGET).select("question_id", "document_id", "id", "tokens")


def _context(spark: SparkSession, sf_dir: str) -> cx.Context:
    q, e, s = _inputs(spark, sf_dir)
    return cx.build_context(q, e, rels(spark, sf_dir), s, window_tokens=WINDOW)


@query(f"WITH {_STEPS} SELECT question_id, document_id, id, role, CAST(tokens AS BIGINT) AS tokens FROM inc")
def context_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(spark, sf_dir).elements.select("question_id", "document_id", "id", "role", "tokens")


@query(f"WITH {_STEPS} SELECT question_id, document_id, source_id, target_id, type, description, CAST(tokens AS BIGINT) AS tokens FROM ef")
def context_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(spark, sf_dir).relations.select(
        "question_id", "document_id", "source_id", "target_id", "type", "description", "tokens"
    )


@query(f"""WITH {_STEPS} SELECT question_id, document_id, CAST(coalesce((SELECT sum(tokens) FROM inc WHERE inc.question_id = t.question_id), 0)
    + coalesce((SELECT sum(tokens) FROM ef WHERE ef.question_id = t.question_id), 0) AS BIGINT) AS total_tokens,
    (SELECT count(*) FROM inc WHERE inc.question_id = t.question_id) AS element_count,
    coalesce((SELECT bool_or(NOT verified) FROM inc WHERE inc.question_id = t.question_id), false) AS has_unverified_elements
    FROM (SELECT DISTINCT question_id, document_id FROM top) t""")
def build_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(spark, sf_dir).summary


@query("""SELECT question_id, document_id, false AS answerable, 'none' AS model_id, CAST(0.1 AS DOUBLE) AS temperature, 'query-answering-v1' AS prompt_version FROM qu
    WHERE NOT EXISTS (SELECT 1 FROM sr WHERE sr.question_id = qu.question_id AND score > 8)""")
def cannot_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only scores above 8 kept, so that many questions have no context."""
    q, e, s = _inputs(spark, sf_dir)
    chosen = cx.build_context(q, e, rels(spark, sf_dir), s.where(F.col("score") > 8))
    out = cx.cannot_answer(q, chosen.summary, F.lit(corpus.AS_OF).cast("timestamp"))
    return out.select("question_id", "document_id", "answerable", "model_id", "temperature", "prompt_version")
