"""Queries over findings, gaps and suggestions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import owner_key
from corpusloom.model import EXPECTED_ELEMENTS, type_schema
from corpusloom.operators import graph as g
from corpusloom.operators import quality as ql
from corpusloom.operators.constraints import check_constraints as check
from corpusloom.plans import corpus
from corpusloom.plans.catalog.graph import docs, els, rels
from corpusloom.plans.catalog.registry import query
from corpusloom.session import materialize, shared_dir
from corpusloom.sources import tables

_CATALOGUE = ", ".join(
    f"('{kind}', {i}, '{name}', '{text}', '{weight}')"
    for kind, entries in EXPECTED_ELEMENTS.items()
    for i, (name, text, weight) in enumerate(entries)
)
_CAT = f"cat(document_type, schema_pos, name, expected, importance) AS (VALUES {_CATALOGUE})"
# Element names replaced by words that meet some expectations; every eleventh document keeps no elements.
_NAMES = ["alcance", "Usuarios/Actores y más", "regla", "interfaces", "x y z", "DECISIONES tomadas", "éxito"]
_NM = f"""nm AS (SELECT document_id, doc_id, pos, id, type, content, verified,
    [{', '.join(f"'{n}'" for n in _NAMES)}][(doc_id + pos) % {len(_NAMES)} + 1] AS name FROM el WHERE doc_id % 11 <> 0)"""
_HIT = """hit AS (SELECT nm.document_id, ty.document_type, schema_pos, cat.name AS expected_element, pos, id FROM nm JOIN ty USING (document_id)
    JOIN cat ON cat.document_type = ty.document_type AND (contains(lower(nm.name), cat.name) OR contains(nm.type, cat.name)
    OR contains(cat.name, lower(nm.name)) OR contains(cat.name, nm.type)))"""
_GAP = """gap AS (SELECT ty.document_id, cat.schema_pos, cat.document_type, cat.name, cat.expected, importance,
    'miss-' || substr(sha256(ty.document_id || chr(31) || cat.document_type || chr(31) || cat.schema_pos), 1, 16) AS finding_id,
    'Expected element ''' || cat.name || ''' (' || cat.expected || ') is not present in the document.' AS description
    FROM ty JOIN cat USING (document_type) WHERE document_id IN (SELECT document_id FROM nm) AND NOT EXISTS (SELECT 1 FROM hit
    WHERE hit.document_id = ty.document_id AND hit.schema_pos = cat.schema_pos))"""
# Findings: explicit contradictions (as in the twins of the graph queries) and one ambiguity per fourth chunk.
_FND = """amb AS (SELECT document_id, 'amb-' || pos AS finding_id, pos, 'unclear: ' || name AS description,
        ['high', 'medium', 'low'][pos % 3 + 1] AS severity, id AS affected FROM el WHERE pos % 4 = 0),
    fnd AS (SELECT document_id, finding_id, 'contradiction' AS type, substr(coalesce(description, 'Element ''' || s_name || ''' contradicts element '''
        || t_name || '''.'), 1, 500) AS description, 'high' AS severity, [source_id, target_id] AS affected FROM fi
        UNION ALL SELECT document_id, finding_id, 'ambiguity', description, severity, [affected] FROM amb)"""
_SUG = """sug AS (SELECT document_id, 'sug-' || pos AS suggestion_id, pos, 'look at ' || name AS description, 'clarity' AS category,
        ['low', 'medium', 'high'][pos % 3 + 1] AS priority, 'amb-' || pos AS related FROM el WHERE pos % 2 = 0 OR doc_id % 3 = 0),
    hi AS (SELECT document_id, finding_id, description, CASE type WHEN 'contradiction' THEN 'consistency' ELSE 'clarity' END AS category FROM fnd
        WHERE severity = 'high' UNION ALL SELECT document_id, finding_id, description, 'completeness' FROM gap WHERE importance = 'high'),
    un AS (SELECT * FROM hi WHERE NOT EXISTS (SELECT 1 FROM sug WHERE sug.document_id = hi.document_id AND related = finding_id)),
    cov AS (SELECT document_id, suggestion_id, pos, description, category, priority, related FROM sug UNION ALL
        SELECT document_id, 'sug-' || substr(sha256(document_id || chr(31) || finding_id), 1, 16), 1099511627776,
        substr('Address: ' || description, 1, 300), category, 'high', finding_id FROM un),
    nb AS (SELECT *, count(*) OVER (PARTITION BY document_id) AS total, row_number() OVER (PARTITION BY document_id ORDER BY
        CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, pos, suggestion_id) AS by_priority,
        row_number() OVER (PARTITION BY document_id ORDER BY pos, suggestion_id) AS in_order FROM cov),
    top AS (SELECT *, CASE WHEN total > 20 THEN by_priority ELSE in_order END AS place FROM nb WHERE by_priority <= 20)"""
_ALL = f"{_CAT}, {_NM}, {_HIT}, {_GAP}, {_FND}, {_SUG}"


def named_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("document_id").cast("long")
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), ((doc + F.col("pos")) % len(_NAMES)).cast("int") + 1)
    return els(spark, sf_dir).where(doc % 11 != 0).withColumn("name", name)


def ambiguities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = els(spark, sf_dir).where(F.col("pos") % 4 == 0)
    severity = F.when(F.col("pos") % 3 == 0, "high").when(F.col("pos") % 3 == 1, "medium").otherwise("low")
    return e.select(
        "document_id",
        F.concat(F.lit("amb-"), F.col("pos").cast("string")).alias("finding_id"),
        owner_key("ambiguity", "pos").alias("owner"),
        F.array(F.lit(2).cast("long"), "pos").alias("ord"),
        F.lit("ambiguity").alias("type"),
        F.concat(F.lit("unclear: "), "name").alias("description"),
        severity.alias("severity"),
        F.array("id").alias("affected_element_ids"),
        F.lit(False).alias("involves_unverified_elements"),
        F.lit(False).alias("all_evidence_unverified"),
        F.lit(False).alias("from_explicit_relationship"),
    )


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = g.structural_contradictions(els(spark, sf_dir), rels(spark, sf_dir))
    return ql.all_inconsistencies(found, ambiguities(spark, sf_dir))


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.missing_elements(docs(spark, sf_dir), named_elements(spark, sf_dir), type_schema(spark))


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos, doc = F.col("pos"), F.col("document_id").cast("long")
    e = els(spark, sf_dir).where((pos % 2 == 0) | (doc % 3 == 0))
    return e.select(
        "document_id",
        F.concat(F.lit("sug-"), pos.cast("string")).alias("suggestion_id"),
        owner_key("suggestion", pos).alias("owner"),
        "pos",
        F.concat(F.lit("look at "), "name").alias("description"),
        F.lit("clarity").alias("category"),
        F.when(pos % 3 == 0, "low").when(pos % 3 == 1, "medium").otherwise("high").alias("priority"),
        F.array(F.concat(F.lit("amb-"), pos.cast("string"))).alias("related_finding_ids"),
        F.lit(False).alias("all_evidence_unverified"),
    )


def suggestion_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other suggestion brings a reference."""
    e = els(spark, sf_dir).where(F.col("pos") % 4 == 0)
    return e.select(
        "document_id",
        owner_key("suggestion", "pos").alias("owner"),
        F.concat(F.lit("sug-"), F.col("pos").cast("string")).alias("owner_id"),
        F.lit(0).alias("ref_pos"),
        "source_ref.*",
        F.lit(False).alias("evidence_verified"),
    )


@query(f"""WITH {_FND} SELECT document_id, finding_id, EXISTS (SELECT 1 FROM el WHERE el.document_id = fnd.document_id AND NOT verified
    AND list_contains(affected, el.id)) AS involves_unverified_elements FROM fnd""")
def flag_unverified(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = findings(spark, sf_dir).withColumn("involves_unverified_elements", F.lit(False))
    return ql.flag_unverified(plain, els(spark, sf_dir)).select("document_id", "finding_id", "involves_unverified_elements")


@query(f"WITH {_ALL} SELECT document_id, document_type, CAST(schema_pos AS INTEGER) AS schema_pos, expected_element, pos, id FROM hit")
def schema_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ql.schema_matches(docs(spark, sf_dir), named_elements(spark, sf_dir), type_schema(spark))
    return out.select("document_id", "document_type", "schema_pos", "expected_element", "pos", "id")


@query(f"""WITH {_ALL} SELECT ty.document_id, CAST(cat.schema_pos AS INTEGER) AS schema_pos, cat.name AS expected_element,
    EXISTS (SELECT 1 FROM hit WHERE hit.document_id = ty.document_id AND hit.schema_pos = cat.schema_pos) AS present FROM ty JOIN cat USING (document_type)""")
def match_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ql.match_schema(docs(spark, sf_dir), named_elements(spark, sf_dir), type_schema(spark))
    return out.select("document_id", "schema_pos", "expected_element", "present")


@query(f"""WITH {_ALL} SELECT document_id, finding_id, 'missing' AS classification, name AS expected_element, description, importance AS severity,
    document_type AS schema_reference FROM gap""")
def missing_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps(spark, sf_dir).drop("ord", "owner")


@query("""SELECT document_id, CASE WHEN doc_id % 11 = 0 THEN 'Completeness cannot be assessed: Knowledge Model contains zero elements.'
    ELSE 'Document type schema not found for type ''technical_spec''. Completeness evaluation cannot proceed without a valid schema.' END AS error_message
    FROM d WHERE doc_id % 4 <> 3 AND (doc_id % 11 = 0 OR doc_id % 4 = 1)""")
def completeness_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a catalogue of one's own that leaves one type out."""
    own = type_schema(spark, {k: v for k, v in EXPECTED_ELEMENTS.items() if k != "technical_spec"})
    return ql.completeness_errors(docs(spark, sf_dir), named_elements(spark, sf_dir), own)


@query(f"WITH {_FND} SELECT document_id, finding_id, type, severity FROM fnd")
def all_inconsistencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).select("document_id", "finding_id", "type", "severity")


@query(f"""WITH {_ALL} SELECT document_id, (SELECT count(*) FROM fnd WHERE fnd.document_id = d.document_id AND type = 'contradiction') AS contradictions,
    (SELECT count(*) FROM fnd WHERE fnd.document_id = d.document_id AND type = 'ambiguity') AS ambiguities,
    (SELECT count(*) FROM gap WHERE gap.document_id = d.document_id) AS missing_elements,
    (SELECT count(*) FROM sug WHERE sug.document_id = d.document_id) AS suggestions FROM d""")
def finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.finding_counts(docs(spark, sf_dir), findings(spark, sf_dir), gaps(spark, sf_dir), suggestions(spark, sf_dir))


@query(f"WITH {_ALL} SELECT document_id, finding_id, description, category FROM un")
def uncovered_high_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.uncovered_high_findings(findings(spark, sf_dir), gaps(spark, sf_dir), suggestions(spark, sf_dir)).drop("owner")


@query(f"WITH {_ALL} SELECT document_id, suggestion_id, pos, description, category, priority, related FROM cov")
def cover_high_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ql.cover_high_findings(suggestions(spark, sf_dir), findings(spark, sf_dir), gaps(spark, sf_dir))
    return out.select(
        "document_id", "suggestion_id", "pos", "description", "category", "priority", F.array_join("related_finding_ids", ",").alias("related")
    )


@query(f"WITH {_ALL} SELECT document_id, suggestion_id, priority, CAST(place AS INTEGER) AS place FROM top")
def top_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    covered = ql.cover_high_findings(suggestions(spark, sf_dir), findings(spark, sf_dir), gaps(spark, sf_dir))
    return ql.top_suggestions(covered).select("document_id", "suggestion_id", "priority", "place")


@query("""SELECT document_id, 'sug-' || pos AS owner_id, CASE WHEN pos % 4 = 0 THEN chunk_id ELSE 'chunk-000' END AS chunk_id,
    CASE WHEN pos % 4 = 0 THEN evidence ELSE (SELECT substr(c.text, 1, 500) FROM ch c WHERE c.document_id = el.document_id AND ord = 0) END AS evidence
    FROM el WHERE pos % 2 = 0 OR doc_id % 3 = 0 OR pos % 4 = 0""")
def default_suggestion_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ql.default_suggestion_refs(
        suggestions(spark, sf_dir), suggestion_refs(spark, sf_dir), corpus.stored(spark, sf_dir, "chunks")
    )
    return out.select("document_id", "owner_id", "chunk_id", "evidence")


@query(f"""WITH {_ALL} SELECT top.document_id, top.suggestion_id, CAST(place AS INTEGER) AS place,
    CASE WHEN e.pos IS NULL THEN 'chunk-000' ELSE e.chunk_id END AS chunk_id FROM top
    LEFT JOIN el e ON e.document_id = top.document_id AND 'sug-' || e.pos = top.suggestion_id AND e.pos % 4 = 0""")
def suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ql.suggest(
        suggestions(spark, sf_dir),
        suggestion_refs(spark, sf_dir),
        materialize(findings(spark, sf_dir), "findings"),
        materialize(gaps(spark, sf_dir), "gaps"),
        corpus.stored(spark, sf_dir, "chunks"),
        settle=lambda df: materialize(df, "suggested"),
    )
    refs = out.refs.select("document_id", "owner", "chunk_id")
    return out.suggestions.join(refs, ql.OWNER_KEY).select(
        "document_id", "suggestion_id", "place", "chunk_id"
    )


@query(f"""WITH {_FND} SELECT document_id, finding_id, CASE WHEN length(description) > 40 THEN 'description too long' ELSE '' END ||
    CASE WHEN severity = 'low' THEN CASE WHEN length(description) > 40 THEN '; ' ELSE '' END || 'severity not allowed' ELSE '' END AS reasons
    FROM fnd WHERE length(description) > 40 OR severity = 'low'""")
def check_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With tighter rules than the built-in ones, so that rows are refused."""
    rules = {"max_length": {"description": 40}, "domain": {"severity": ["high", "medium"]}}
    refused = check(findings(spark, sf_dir), rules).rejected
    return refused.select("document_id", "finding_id", F.array_join("reasons", "; ").alias("reasons"))


@query(f"""WITH {_ALL} SELECT document_id, (SELECT count(*) FROM fnd WHERE fnd.document_id = d.document_id AND (doc_id % 5 <> 0 OR type = 'contradiction')) AS findings,
    CASE WHEN doc_id % 5 = 0 THEN 0 ELSE (SELECT count(*) FROM sug WHERE sug.document_id = d.document_id) END AS suggestions,
    CASE WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN doc_id % 5 = 0 THEN 1000 END AS message_chars FROM d""")
def quality_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written with every fifth document failed, and read back: those keep explicit contradictions only."""
    path = f"{shared_dir(spark)}/quality-{uuid.uuid4().hex}"
    ids = docs(spark, sf_dir)
    failed = ids.where(F.col("document_id").cast("long") % 5 == 0).select(
        "document_id", F.lit("analyzing_ambiguities").alias("error_phase"), F.repeat(F.lit("x"), 1500).alias("error_message")
    )
    results = ids.select("document_id", F.lit("completed").alias("status"))
    tables.persist_quality(
        findings(spark, sf_dir),
        gaps(spark, sf_dir),
        suggestions(spark, sf_dir),
        suggestion_refs(spark, sf_dir),
        results,
        failed,
        path,
    )
    got = tables.read_quality_result(spark, path)
    count = lambda name: got[name].groupBy("document_id").agg(F.count("*").alias(name))
    return (
        got["quality_results"]
        .join(count("findings"), "document_id", "left")
        .join(count("suggestions"), "document_id", "left")
        .na.fill(0, ["findings", "suggestions"])
        .select("document_id", "findings", "suggestions", "status", F.length("error_message").alias("message_chars"))
    )


@query("""SELECT document_id, (SELECT count(*) FROM el WHERE el.document_id = d.document_id) AS elements,
    (SELECT count(*) FROM rk WHERE rk.document_id = d.document_id) AS relations FROM d JOIN cu USING (document_id) WHERE cu.status = 'completed'""")
def model_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models written and read back nested; only documents with a completed session have one."""
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    e = els(spark, sf_dir)
    r = g.drop_dangling(rels(spark, sf_dir), e)
    tables.persist_model(e, r, docs(spark, sf_dir), path)
    tables.add_session_events(corpus.session_events(spark, sf_dir), path)
    model = tables.read_knowledge_model(spark, path)
    edges = F.aggregate(
        "elements", F.lit(0), lambda acc, x: acc + F.coalesce(F.greatest(F.size(x.relations), F.lit(0)), F.lit(0))
    )
    return model.select(
        "document_id", F.size("elements").cast("long").alias("elements"), edges.cast("long").alias("relations")
    )
