"""Queries that read model replies, and the composed jobs on stored replies."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import replies as rp
from corpusloom.model import type_schema
from corpusloom.operators import context as cx
from corpusloom.operators import evidence as ev
from corpusloom.operators import quality as ql
from corpusloom.operators import replies as rs
from corpusloom.operators.constraints import check_constraints as check
from corpusloom.plans import analysis, completion, corpus, prompts
from corpusloom.plans.catalog.graph import docs, els, rels
from corpusloom.plans.catalog.quality import _CAT, findings, gaps
from corpusloom.plans.catalog.registry import query
from corpusloom.session import materialize, shared_dir
from corpusloom.sources import tables

_OK = "doc_id % 17 <> 5"
_SEV = "CASE pos % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE '{}' END"


def responses(spark: SparkSession, sf_dir: str, *steps: str) -> DataFrame:
    return corpus.responses(spark, sf_dir, steps)


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).withColumn("format", F.lit("markdown"))


@query("""SELECT ty.document_id, CASE WHEN d.doc_id % 17 <> 5 AND d.doc_id % 10 <> 7 AND document_type <> 'generic' THEN document_type END AS document_type,
    CASE WHEN d.doc_id % 17 <> 5 AND d.doc_id % 10 <> 7 THEN document_type ELSE 'generic' END AS suggested_type,
    CASE WHEN d.doc_id % 17 = 5 THEN 'Could not parse LLM response; defaulting to generic classification.' WHEN d.doc_id % 3 <> 0 THEN 'by its words'
    WHEN d.doc_id % 10 = 7 THEN 'Unrecognized document type; defaulting to generic.' ELSE '' END AS justification FROM ty JOIN d USING (document_id)""")
def parse_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.parse_types(responses(spark, sf_dir, "type")).rows


@query(f"SELECT document_id, pos, id, type, name, content, chunk_id, evidence FROM el WHERE pos % 10 <> 9 AND {_OK}")
def parse_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rs.parse_elements(responses(spark, sf_dir, "extraction")).elements
    return out.select("document_id", "pos", "id", "type", "name", "content", "source_ref.chunk_id", "source_ref.evidence")


@query(f"SELECT document_id, element_pos, pos, source_id, target_id, type, description FROM re WHERE element_pos % 10 <> 9 AND {_OK}")
def parse_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rs.parse_elements(responses(spark, sf_dir, "extraction")).relations
    return out.select("document_id", "element_pos", "pos", "source_id", "target_id", "type", "description")


@query("""SELECT document_id, 'Complete parse failure: reply is not a JSON object with a list of elements.' AS error_message
    FROM d WHERE doc_id % 17 = 5 AND document_id IN (SELECT document_id FROM el)""")
def extraction_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.parse_elements(responses(spark, sf_dir, "extraction")).failures


@query("""SELECT sr.question_id, sr.document_id, sr.id, CAST(greatest(0, least(10, score * 2 - 4)) AS INTEGER) AS score FROM sr
    JOIN qu USING (question_id) WHERE conv_id % 17 <> 5""")
def parse_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rs.parse_scores(responses(spark, sf_dir, "scoring")).scores
    return out.select("question_id", "document_id", "id", "score")


@query("SELECT question_id, document_id FROM qu WHERE conv_id % 17 = 5 OR document_id NOT IN (SELECT document_id FROM el)")
def unscored_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.parse_scores(responses(spark, sf_dir, "scoring"), corpus.stored(spark, sf_dir, "questions")).unscored


@query(f"""SELECT document_id, 'model: ' || name AS description, {_SEV.format('medium')} AS severity, id AS affected, 2 AS refs FROM el
    WHERE pos % 5 = 0 AND {_OK} AND doc_id % 13 <> 3""")
def parse_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rs.parse_contradictions(responses(spark, sf_dir, "contradiction"))
    refs = out.refs.groupBy(*ql.OWNER_KEY).agg(F.count("*").cast("int").alias("refs"))
    return out.findings.join(refs, ql.OWNER_KEY).select(
        "document_id", "description", "severity", F.array_join("affected_element_ids", ",").alias("affected"), "refs"
    )


@query(f"""SELECT el.document_id, 'amb-' || el.pos AS finding_id, 'unclear: ' || name AS description, {_SEV.format('low')} AS severity, chunk_id, evidence
    FROM el WHERE pos % 4 = 0 AND {_OK} AND doc_id % 13 <> 6""")
def parse_ambiguities(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rs.parse_ambiguities(responses(spark, sf_dir, "ambiguity"))
    return out.findings.join(out.refs, ql.OWNER_KEY).select(
        "document_id", "finding_id", "description", "severity", "chunk_id", "evidence"
    )


@query(f"""SELECT el.document_id, name AS expected_element, 'Element partially covers the expected content.' AS description, {_SEV.format('medium')} AS severity,
    document_type AS schema_reference FROM el JOIN ty USING (document_id) WHERE pos < 3 AND pos % 2 = 0 AND {_OK}""")
def parse_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rs.parse_partials(responses(spark, sf_dir, "completeness"), docs(spark, sf_dir)).rows
    return out.select("document_id", "expected_element", "description", "severity", "schema_reference")


@query(f"""SELECT document_id, 'sug-' || pos AS suggestion_id, pos // 2 AS pos, 'look at ' || name AS description, 'structure' AS category,
    CASE pos % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS priority, CASE WHEN pos % 4 = 0 THEN 1 ELSE 0 END AS refs
    FROM el WHERE pos % 2 = 0 AND {_OK}""")
def parse_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rs.parse_suggestions(responses(spark, sf_dir, "suggestion"))
    refs = out.refs.groupBy(*ql.OWNER_KEY).agg(F.count("*").cast("int").alias("refs"))
    return out.findings.join(refs, ql.OWNER_KEY, "left").select(
        "document_id", "suggestion_id", "pos", "description", "category", "priority", F.coalesce("refs", F.lit(0)).alias("refs")
    )


# Text around the object is cut off outside a fence only; inside one it makes the reply unreadable.
_ANS = """an AS (SELECT q.question_id, q.document_id, count(*) AS n, q.conv_id % 9 = 4 AND q.turn % 4 = 0 AS bad
    FROM qu q JOIN el USING (document_id) GROUP BY ALL)"""


@query(f"""WITH {_ANS} SELECT question_id, document_id, 'From ' || n || ' parts.' AS answer, true AS answerable, n AS refs FROM an WHERE n <= 10 AND NOT bad""")
def parse_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rs.parse_answers(responses(spark, sf_dir, "answer"))
    refs = out.refs.groupBy("question_id", "document_id").agg(F.count("*").alias("refs"))
    return out.answers.join(refs, ["question_id", "document_id"]).select(
        "question_id", "document_id", "answer", "answerable", "refs"
    )


@query(f"""WITH {_ANS} SELECT question_id, document_id, CASE WHEN bad THEN 'Reply is not a JSON object.'
    ELSE 'Reply does not conform to the answer schema.' END AS error_message FROM an WHERE n > 10 OR bad""")
def answer_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More references than an answer may carry, or text around the object inside a fence."""
    return rs.parse_answers(responses(spark, sf_dir, "answer")).failures.select("question_id", "document_id", "error_message")


@query("""SELECT document_id, CASE WHEN doc_id % 9 = 4 THEN 1 ELSE 0 END AS fenced FROM d WHERE doc_id % 17 <> 5 AND document_id IN (SELECT document_id FROM el)""")
def strip_code_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction replies that become one JSON value once their fence is off."""
    rows = rs.of_step(responses(spark, sf_dir, "extraction"), "extraction")
    bare = rp.strip_code_fence("content", "first_line")
    return rows.where(rp.strict_json(bare).isNotNull()).select(
        "document_id", F.startswith("content", F.lit("```")).cast("int").alias("fenced")
    )


@query(f"""WITH g AS (SELECT * FROM el WHERE pos % 10 <> 9 AND {_OK}), r AS (SELECT re.* FROM re JOIN g t ON t.document_id = re.document_id AND t.id = target_id
    WHERE element_pos % 10 <> 9 AND re.{_OK}), m AS (SELECT document_id, source_id, target_id FROM r WHERE type = 'contradicts'),
    added AS (SELECT document_id, target_id AS a, source_id AS b FROM m EXCEPT SELECT document_id, source_id, target_id FROM m)
    SELECT document_id, count(*) AS element_count, (SELECT count(*) FROM r WHERE r.document_id = g.document_id)
    + (SELECT count(*) FROM added WHERE added.document_id = g.document_id) AS relationship_count, NOT bool_or(type = 'proposito') AS lacks_purpose,
    'extraction-v1' AS prompt_version, 'model-a' AS model_id, epoch(TIMESTAMP '{corpus.AS_OF}')::BIGINT AS extracted_at FROM g GROUP BY document_id""")
def extract_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction replies to a clean graph: counts per document after all clean-up."""
    out = _extracted(spark, sf_dir)
    return out.summary.select(
        "document_id",
        "element_count",
        "relationship_count",
        "lacks_purpose",
        "prompt_version",
        "model_id",
        F.unix_seconds("extracted_at").alias("extracted_at"),
    )


@query(f"""SELECT el.document_id, el.id, trim(name, ' ' || chr(9) || chr(10) || chr(13)) AS name, section FROM el LEFT JOIN ch c
    ON c.document_id = el.document_id AND c.chunk_id = el.chunk_id WHERE pos % 10 <> 9 AND el.{_OK}""")
def extract_model_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _extracted(spark, sf_dir)
    return out.elements.select("document_id", "id", "name", "source_ref.section")


def _extracted(spark: SparkSession, sf_dir: str) -> analysis.Extracted:
    chunks = corpus.stored(spark, sf_dir, "chunks")
    return analysis.extract_model(
        responses(spark, sf_dir, "extraction"),
        chunks,
        _markdown(spark, sf_dir),
        settle=lambda df: materialize(df, "extracted"),
        extracted_at=F.lit(corpus.AS_OF).cast("timestamp"),
    )


STARTED = "2024-05-31 23:58:00"


def _assessed(spark: SparkSession, sf_dir: str, fuzzy: bool) -> analysis.Assessed:
    return analysis.assess_replies(
        docs(spark, sf_dir),
        els(spark, sf_dir),
        rels(spark, sf_dir),
        corpus.stored(spark, sf_dir, "chunks"),
        type_schema(spark),
        responses(spark, sf_dir, *ql.RUN_VERSIONS),
        fuzzy=fuzzy,
        settle=lambda df: materialize(df, "quality"),
        started_at=F.lit(STARTED).cast("timestamp"),
        completed_at=F.lit(corpus.AS_OF).cast("timestamp"),
    )


@query("""WITH f AS (SELECT document_id, 0 AS rank FROM d WHERE (doc_id % 17 = 5 OR doc_id % 13 = 3) AND document_id IN (SELECT document_id FROM el WHERE pos % 5 = 0)
    UNION ALL SELECT document_id, 1 FROM d WHERE (doc_id % 17 = 5 OR doc_id % 13 = 6) AND document_id IN (SELECT document_id FROM el WHERE pos % 4 = 0)
    UNION ALL SELECT document_id, 1 FROM d WHERE document_id NOT IN (SELECT document_id FROM el)
    UNION ALL SELECT document_id, 2 FROM ty WHERE document_type <> 'generic' AND document_id NOT IN (SELECT document_id FROM el)
    UNION ALL SELECT document_id, 3 FROM d WHERE doc_id % 17 = 5 AND document_id IN (SELECT document_id FROM el))
    SELECT document_id, ['analyzing_contradictions', 'analyzing_ambiguities', 'analyzing_completeness', 'generating_suggestions'][min(rank) + 1] AS error_phase
    FROM f GROUP BY document_id""")
def quality_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = responses(spark, sf_dir, *ql.RUN_VERSIONS)
    out = analysis.phase_failures(docs(spark, sf_dir), els(spark, sf_dir), type_schema(spark), replies)
    return out.select("document_id", "error_phase")


@query()
def assess_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole assessment with evidence checked by similarity too: counts per completed document."""
    out = _assessed(spark, sf_dir, fuzzy=True)
    flagged = out.findings.groupBy("document_id").agg(F.count_if("all_evidence_unverified").alias("unsupported"))
    return out.results.join(flagged, "document_id", "left").na.fill(0, ["unsupported"])


# Everything the stored replies and the derived graph hold, for documents none of whose phases failed.
_GOOD = """bad AS (SELECT document_id FROM d WHERE doc_id % 13 = 3 AND document_id IN (SELECT document_id FROM el WHERE pos % 5 = 0)
        OR doc_id % 13 = 6 AND document_id IN (SELECT document_id FROM el WHERE pos % 4 = 0)
        UNION SELECT document_id FROM d WHERE document_id NOT IN (SELECT document_id FROM el)
        UNION SELECT document_id FROM el WHERE doc_id % 17 = 5),
    hit AS (SELECT DISTINCT el.document_id, cat.schema_pos FROM el JOIN ty USING (document_id) JOIN cat ON cat.document_type = ty.document_type
        AND (contains(lower(el.name), cat.name) OR contains(el.type, cat.name) OR contains(cat.name, lower(el.name)) OR contains(cat.name, el.type))),
    gap AS (SELECT ty.document_id, importance FROM ty JOIN cat USING (document_type) WHERE document_id IN (SELECT document_id FROM el)
        AND NOT EXISTS (SELECT 1 FROM hit WHERE hit.document_id = ty.document_id AND hit.schema_pos = cat.schema_pos)),
    part AS (SELECT document_id, CASE pos % 3 WHEN 0 THEN 'high' ELSE 'medium' END AS importance FROM el WHERE pos < 3 AND pos % 2 = 0),
    miss AS (SELECT * FROM gap UNION ALL SELECT * FROM part),
    n AS (SELECT document_id, document_type, (SELECT count(*) FROM fi WHERE fi.document_id = ty.document_id) AS s,
        (SELECT count(*) FROM el WHERE el.document_id = ty.document_id AND pos % 5 = 0) AS m,
        (SELECT count(*) FROM el WHERE el.document_id = ty.document_id AND pos % 15 = 0) AS mh,
        (SELECT count(*) FROM el WHERE el.document_id = ty.document_id AND pos % 4 = 0) AS a,
        (SELECT count(*) FROM miss WHERE miss.document_id = ty.document_id) AS g,
        (SELECT count(*) FROM miss WHERE miss.document_id = ty.document_id AND importance = 'high') AS gh,
        (SELECT count(*) FROM el WHERE el.document_id = ty.document_id AND pos % 2 = 0) AS said FROM ty)"""


@query(f"""WITH {_CAT}, {_GOOD} SELECT document_id, document_type, s + m AS contradictions, a AS ambiguities, g AS missing_elements,
    least(20, said + s + mh + gh) AS suggestions, 'completed' AS status FROM n WHERE document_id NOT IN (SELECT document_id FROM bad)""")
def assess_quality_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assessment with evidence checked by the exact steps: counts per completed document."""
    return _assessed(spark, sf_dir, fuzzy=False).results.drop("metadata")


@query(f"""WITH {_CAT}, {_GOOD} SELECT d.document_id, CASE WHEN b.document_id IS NULL THEN 'completed' ELSE 'failed' END AS status,
    CASE WHEN b.document_id IS NULL THEN 'ambiguity-v1,completeness-v1,contradiction-v1,suggestion-v1' END AS versions,
    CASE WHEN b.document_id IS NULL THEN 'model-a' END AS model_id, CASE WHEN b.document_id IS NULL THEN n.document_type END AS document_type,
    CASE WHEN b.document_id IS NULL THEN 120 END AS seconds, CASE WHEN b.document_id IS NULL THEN CAST(s + m AS BIGINT) END AS contradictions,
    CASE WHEN b.document_id IS NULL THEN CAST(least(20, said + s + mh + gh) AS BIGINT) END AS suggestions,
    CASE WHEN b.document_id IS NULL THEN CAST(0.1 AS DOUBLE) END AS temperature
    FROM d JOIN n USING (document_id) LEFT JOIN bad b ON b.document_id = d.document_id""")
def quality_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stored results say about their run; failed ones say nothing."""
    path = f"{shared_dir(spark)}/quality-runs-{uuid.uuid4().hex}"
    out = _assessed(spark, sf_dir, fuzzy=False)
    tables.persist_quality(out.findings, out.missing, out.suggestions, out.refs, out.results, out.failures, path, buckets=16)
    got = tables.read_quality_result(spark, path)["quality_results"]
    m = F.col("metadata")
    return got.select(
        "document_id",
        "status",
        F.when(m.isNotNull(), F.array_join(F.array_sort(F.map_values(m["prompt_versions"])), ",")).alias("versions"),
        m["model_id"].alias("model_id"),
        m["document_type"].alias("document_type"),
        (F.unix_timestamp(m["completed_at"]) - F.unix_timestamp(m["started_at"])).cast("int").alias("seconds"),
        m["finding_counts"]["contradictions"].alias("contradictions"),
        m["finding_counts"]["suggestions"].alias("suggestions"),
        m["temperature"].alias("temperature"),
    )


_NORM = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


# The same id for every ambiguity and suggestion of a document: each is still judged by its own references.
@query(rf"""WITH e AS (SELECT el.document_id, doc_id, pos, {_NORM.format('el.evidence')} <> '' AND EXISTS (SELECT 1 FROM ch WHERE ch.document_id = el.document_id
        AND contains({_NORM.format('ch.text')}, {_NORM.format('el.evidence')})) AS ok FROM el)
    SELECT document_id, 'ambiguity' AS kind, pos // 4 AS place, NOT ok AS all_evidence_unverified FROM e WHERE pos % 4 = 0 AND {_OK} AND doc_id % 13 <> 6
    UNION ALL SELECT document_id, 'suggestion', pos // 2, pos % 4 = 0 AND NOT ok FROM e WHERE pos % 2 = 0 AND {_OK}""")
def assess_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies whose ids repeat across kinds and within one, their references checked by the exact steps."""
    same = responses(spark, sf_dir, "ambiguity", "suggestion").withColumn("content", F.regexp_replace("content", r'"id":"(amb|sug)-[0-9]+"', '"id":"same"'))
    same = materialize(rs.judge(same), "judged")
    chunks = corpus.stored(spark, sf_dir, "chunks")
    settle = lambda df: materialize(df, "checked")
    vague, said = rs.parse_ambiguities(same), rs.parse_suggestions(same)
    refs = vague.refs.unionByName(ql.default_suggestion_refs(said.findings, said.refs, chunks))
    checked = materialize(ev.verify_evidence(refs, chunks, fuzzy=False, settle=settle), "checked")
    key = [F.col("document_id"), F.substring_index("owner", ":", 1).alias("kind"), F.substring_index("owner", ":", -1).cast("long").alias("place")]
    out = [ev.all_evidence_unverified(owners, checked, ql.OWNER_KEY) for owners in (vague.findings, said.findings)]
    vague_, said_ = (df.select(*key, "all_evidence_unverified") for df in out)
    return vague_.unionByName(said_)



@query(rf"""WITH {_ANS}, hit AS (SELECT el.document_id, el.pos, {_NORM.format('el.evidence')} <> '' AND EXISTS (SELECT 1 FROM ch WHERE ch.document_id = el.document_id
    AND contains({_NORM.format('ch.text')}, {_NORM.format('el.evidence')})) AS ok FROM el)
    SELECT an.question_id, an.document_id, 'From ' || n || ' parts.' AS answer, NOT bool_or(ok) AS all_evidence_unverified FROM an
    JOIN hit ON hit.document_id = an.document_id WHERE n <= 10 AND NOT bad GROUP BY an.question_id, an.document_id, n""")
def finish_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of answers checked in the exact steps, and the flag drawn from it."""
    settle = lambda df: materialize(df, "answers")
    parsed = rs.parse_answers(settle(rs.judge(responses(spark, sf_dir, "answer"))))
    at = F.lit(corpus.AS_OF).cast("timestamp")
    out = analysis.finish_answers(parsed, corpus.stored(spark, sf_dir, "chunks"), at, fuzzy=False, settle=settle)
    return out.answers.select("question_id", "document_id", "answer", "all_evidence_unverified")


@query(f"""WITH {_ANS} SELECT question_id, document_id, n AS refs, n > 10 AS refused, CASE WHEN n > 10 THEN 'more than 10 source_refs' ELSE '' END AS reasons FROM an""")
def check_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that quote every element of their document: at most ten references are allowed."""
    quoted = corpus.stored(spark, sf_dir, "questions").join(els(spark, sf_dir), "document_id")
    refs = F.collect_list("source_ref").alias("source_refs")
    answers = quoted.groupBy("question_id", "document_id").agg(refs).withColumn("answer", F.lit("as quoted"))
    out = check(answers, "nested_answers")
    kept = out.accepted.withColumn("reasons", F.array().cast("array<string>"))
    return kept.unionByName(out.rejected).select(
        "question_id",
        "document_id",
        F.size("source_refs").cast("long").alias("refs"),
        (F.size("reasons") > 0).alias("refused"),
        F.array_join("reasons", "; ").alias("reasons"),
    )


def echo_model(model: str, prompt: str, temperature: float) -> str:
    """Stand-in for a model: refuses by prompt length, fails over, or answers with what it was asked."""
    if len(prompt) % 5 == 0 and model != "fallback":
        raise completion.TransientError("busy")
    if len(prompt) % 7 == 0:
        raise completion.AuthError("key")
    return f"{model}:{len(prompt)}"


_TYPE_PROMPT = """WITH pre AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS before FROM ch), smp AS (SELECT document_id, string_agg(substr(text, 1, CAST(2000 - before AS BIGINT)), chr(10) ORDER BY ord) AS sample FROM pre
    WHERE before < 2000 GROUP BY document_id), p AS (SELECT smp.document_id, 'Decide which kind of document this sample comes from: prd, technical_spec, policy_process, generic.'
    || chr(10) || 'Give {"document_type": ..., "justification": ...}. Reply with JSON only.' || chr(10) || chr(10) || 'Sample:' || chr(10) || sample AS prompt FROM smp)"""


@query(f"{_TYPE_PROMPT} SELECT document_id, 'light' AS tier, 'type-inference-v1' AS prompt_version, md5(prompt) AS digest FROM p")
def type_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prompts.type_prompts(corpus.stored(spark, sf_dir, "chunks"))
    return out.select("document_id", "tier", "prompt_version", F.md5("prompt").alias("digest"))


@query("""SELECT document_id, md5('[' || string_agg(to_json({'id': id, 'type': type, 'name': name, 'verified': verified}), ',' ORDER BY pos) || ']') AS digest
    FROM el GROUP BY document_id""")
def element_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON list of a document's elements as prompts carry it: the chosen fields in order, and nothing else."""
    listed = prompts.to_json_list(els(spark, sf_dir), ["document_id"], ["pos"], ["id", "type", "name", "verified"], "payload")
    return listed.select("document_id", F.md5("payload").alias("digest"))


@query("""WITH li AS (SELECT document_id, '[' || string_agg(to_json({'id': id, 'type': type, 'name': name, 'content_preview': substr(content, 1, 100)}), ',' ORDER BY pos)
    || ']' AS items FROM el GROUP BY document_id)
    SELECT question_id, q.document_id, 'light' AS tier, md5('Score from 0 to 10 how much each element helps to answer the question. Give [{"id", "score"}]. '
    || 'Reply with JSON only.' || chr(10) || chr(10) || 'Question:' || chr(10) || question || chr(10) || chr(10) || 'Elements:' || chr(10) || items) AS digest
    FROM qu q JOIN li ON li.document_id = q.document_id""")
def scoring_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prompts.scoring_prompts(corpus.stored(spark, sf_dir, "questions"), els(spark, sf_dir))
    return out.select("question_id", "document_id", "tier", F.md5("prompt").alias("digest"))


@query(f"""{_TYPE_PROMPT} SELECT document_id, CASE WHEN length(prompt) % 5 = 0 THEN 'fallback' ELSE 'light' END AS model_id,
    CASE WHEN length(prompt) % 7 <> 0 THEN CASE WHEN length(prompt) % 5 = 0 THEN 'fallback' ELSE 'light' END || ':' || length(prompt) END AS content,
    CASE WHEN length(prompt) % 7 = 0 THEN 'auth: key' END AS error FROM p""")
def complete_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary or light model, one other model on a passing error, none on refused credentials."""
    asked = prompts.type_prompts(corpus.stored(spark, sf_dir, "chunks"))
    return completion.complete(asked, echo_model).select("document_id", "model_id", "content", "error")


def _all_prompts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    chunks, e, r, d = corpus.stored(spark, sf_dir, "chunks"), els(spark, sf_dir), rels(spark, sf_dir), docs(spark, sf_dir)
    q, marks = corpus.stored(spark, sf_dir, "questions"), corpus.stored(spark, sf_dir, "scores")
    chosen = cx.build_context(q, e, r, marks)
    return [
        prompts.extraction_prompts(chunks, d),
        prompts.contradiction_prompts(e, r, chunks),
        prompts.ambiguity_prompts(d, e, chunks),
        prompts.completeness_prompts(ql.schema_matches(d, e, type_schema(spark)), type_schema(spark)),
        prompts.suggestion_prompts(d, findings(spark, sf_dir), gaps(spark, sf_dir), e, chunks),
        prompts.scoring_prompts(q, e),
        prompts.answer_prompts(q, chosen.elements, chosen.relations),
    ]


@query(f"""WITH {_CAT}, n AS (SELECT count(*) AS all_docs, (SELECT count(DISTINCT document_id) FROM el) AS with_elements,
    (SELECT count(*) FROM qu WHERE document_id IN (SELECT document_id FROM el)) AS with_question,
    (SELECT count(DISTINCT question_id) FROM sr WHERE score > 0) AS with_context FROM d),
    met AS (SELECT count(DISTINCT document_id) AS c FROM el JOIN ty USING (document_id) JOIN cat ON cat.document_type = ty.document_type
        AND (contains(lower(el.name), cat.name) OR contains(el.type, cat.name) OR contains(cat.name, lower(el.name)) OR contains(cat.name, el.type)))
    SELECT 'extraction' AS step, 'primary' AS tier, with_elements AS prompts FROM n UNION ALL SELECT 'contradiction', 'primary', with_elements FROM n
    UNION ALL SELECT 'ambiguity', 'primary', all_docs FROM n UNION ALL SELECT 'completeness', 'primary', c FROM met
    UNION ALL SELECT 'suggestion', 'primary', all_docs FROM n UNION ALL SELECT 'scoring', 'light', with_question FROM n
    UNION ALL SELECT 'answer', 'primary', with_context FROM n""")
def build_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt counts of the other seven steps."""
    parts = _all_prompts(spark, sf_dir)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("step", "tier").agg(F.count("*").alias("prompts"))


@query()
def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts themselves, as digests."""
    parts = _all_prompts(spark, sf_dir)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(
        "document_id", "step", "segment", "question_id", "prompt_version", F.md5("prompt").alias("digest"), F.length("prompt").alias("chars")
    )


def fixing_model(model: str, prompt: str, temperature: float) -> str:
    """Answers badly at first and well once it is shown the problem, unless the question starts with a vowel."""
    if "could not be used" not in prompt or prompt.partition("\n\nQuestion:\n")[2][0] in "AEIOU":
        return "no json"
    return '{"answer": "fixed", "answerable": true}'


@query("""SELECT question_id, document_id, CASE WHEN substr(question, 1, 1) IN ('A', 'E', 'I', 'O', 'U') THEN 'failed' ELSE 'repaired' END AS outcome
    FROM qu WHERE EXISTS (SELECT 1 FROM sr WHERE sr.question_id = qu.question_id AND score > 0)""")
def retry_unparsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One more attempt for unreadable answers: how many were repaired, how many failed twice."""
    q, marks = corpus.stored(spark, sf_dir, "questions"), corpus.stored(spark, sf_dir, "scores")
    chosen = cx.build_context(q, els(spark, sf_dir), rels(spark, sf_dir), marks)
    asked = materialize(prompts.answer_prompts(q, chosen.elements, chosen.relations), "asked")
    got = materialize(completion.complete(asked, fixing_model), "got")
    out = completion.retry_unparsed(asked, got, fixing_model, settle=lambda df: materialize(df, "again"))
    kept = out.answers.select("question_id", "document_id", F.lit("repaired").alias("outcome"))
    lost = out.failures.select("question_id", "document_id", F.lit("failed").alias("outcome"))
    return kept.unionByName(lost)


def quoting_model(model: str, prompt: str, temperature: float) -> str:
    """Scores nothing readable (all elements stay), and answers without references."""
    if "Score from 0 to 10" in prompt:
        return "all of them"
    return '{"answer": "as written", "answerable": true, "source_refs": []}'


@query("""SELECT question_id, document_id, CASE WHEN document_id IN (SELECT document_id FROM el) THEN 'as written' ELSE
    'The available knowledge does not contain information relevant to this question. The Knowledge Model does not have elements that match the question''s subject matter.'
    END AS answer, document_id IN (SELECT document_id FROM el) AS answerable, CASE WHEN document_id IN (SELECT document_id FROM el) THEN 'primary' ELSE 'none' END AS model_id FROM qu""")
def answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain with a stand-in model."""
    out = analysis.answer_questions(
        corpus.stored(spark, sf_dir, "questions"),
        els(spark, sf_dir),
        rels(spark, sf_dir),
        corpus.stored(spark, sf_dir, "chunks"),
        quoting_model,
        F.lit(corpus.AS_OF).cast("timestamp"),
    )
    return out.answers.select("question_id", "document_id", "answer", "answerable", "model_id")


