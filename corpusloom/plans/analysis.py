"""The composed jobs: extraction, quality assessment, answering.

`settle` stores an intermediate table (see `session.materialize`). Model replies and checked references are always
passed through it, since more than one later branch reads them.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.model import PROMPT_VERSIONS, SEGMENT_CHARS, TEMPERATURE
from corpusloom.operators import context as ctx
from corpusloom.operators import evidence, graph, quality, replies
from corpusloom.operators.segment import long_documents
from corpusloom.plans import completion, prompts
from corpusloom.session import materialize

Settle = Callable[[DataFrame], DataFrame]


def stored(df: DataFrame) -> DataFrame:
    return materialize(df, "step")


class Extracted(NamedTuple):
    elements: DataFrame
    relations: DataFrame
    summary: DataFrame
    failures: DataFrame


class Assessed(NamedTuple):
    findings: DataFrame
    missing: DataFrame
    suggestions: DataFrame
    refs: DataFrame
    results: DataFrame
    failures: DataFrame


class Answered(NamedTuple):
    answers: DataFrame
    refs: DataFrame
    failures: DataFrame


def merge_segments(
    elements: DataFrame, relations: DataFrame, chunks: DataFrame, limit: int = SEGMENT_CHARS
) -> graph.Graph:
    """Elements of all segments in order; documents over the segment size lose repeated (name, type).

    What counts is the joined text: the pieces of such a document may still fit one segment.
    """
    cut = long_documents(chunks, limit)
    whole = elements.join(cut, "document_id", "left_anti")
    parts = graph.dedupe_elements(elements.join(cut, "document_id", "left_semi"), relations)
    whole_edges = relations.join(cut, "document_id", "left_anti")
    return graph.Graph(whole.unionByName(parts.elements), whole_edges.unionByName(parts.relations))


def namespaced(elements: DataFrame, relations: DataFrame) -> graph.Graph:
    """Put the segment in front of ids, for models that number every segment from one."""
    seg = lambda pos: F.floor(F.col(pos) / replies.SEGMENT_STRIDE).cast("string")
    own = lambda pos, c: F.concat(F.lit("s"), seg(pos), F.lit(":"), F.col(c)).alias(c)
    e = elements.withColumn("id", own("pos", "id"))
    r = relations.withColumns({"source_id": own("element_pos", "source_id"), "target_id": own("element_pos", "target_id")})
    return graph.Graph(e, r)


def extract_model(
    responses: DataFrame,
    chunks: DataFrame,
    documents: DataFrame,
    namespace_ids: bool = False,
    settle: Settle | None = None,
    extracted_at: Column | None = None,
) -> Extracted:
    """Clean element graph from extraction replies: parse, merge segments, normalise, locate, drop dangling, mirror."""
    keep = (lambda df: df) if settle is None else settle
    judged = replies.judge(replies.of_step(responses, "extraction"))
    # what is parsed below are the items: neither the reply nor its whole value is written with them
    parsed = replies.parse_elements(keep(judged.drop("_v").withColumn("content", F.lit(""))))
    failures = keep(parsed.failures)
    ok = documents.select("document_id").join(failures.select("document_id"), "document_id", "left_anti")
    found, edges = keep(parsed.elements), keep(parsed.relations)
    if namespace_ids:
        found, edges = namespaced(found, edges)
    merged = merge_segments(found, edges, chunks)
    located = keep(graph.enrich_source_refs(graph.normalize_elements(merged.elements), chunks, documents))
    mirrored = graph.symmetrize_contradicts(located, graph.drop_dangling(merged.relations, located))
    clean = graph.Graph(
        *[keep(df.join(failures.select("document_id"), "document_id", "left_anti")) for df in mirrored]
    )
    asked = replies.of_step(responses, "extraction").groupBy("document_id").agg(
        F.max_by("model_id", "segment").alias("model_id")
    )
    summary = (
        graph.extraction_summary(ok.join(asked, "document_id", "left_semi"), clean.elements, clean.relations)
        .join(graph.lacks_purpose(ok, clean.elements), "document_id")
        .join(asked, "document_id")
        .withColumns(
            {
                "prompt_version": F.lit(PROMPT_VERSIONS["extraction"]),
                "temperature": F.lit(TEMPERATURE),
                "extracted_at": F.current_timestamp() if extracted_at is None else extracted_at,
            }
        )
    )
    return Extracted(clean.elements, clean.relations, summary, failures)


def infer_types(
    chunks: DataFrame,
    fn: completion.Model,
    tiers: completion.Tiers = completion.Tiers(),
    settle: Settle = stored,
    calls: completion.Calls = completion.Calls(),
) -> replies.ParsedRows:
    return replies.parse_types(settle(completion.complete(prompts.type_prompts(chunks), fn, tiers, calls)))


def analyse(
    documents: DataFrame,
    chunks: DataFrame,
    types: DataFrame,
    fn: completion.Model,
    tiers: completion.Tiers = completion.Tiers(),
    settle: Settle = stored,
    calls: completion.Calls = completion.Calls(),
) -> Extracted:
    """Extraction with confirmed types, evidence checked."""
    answers = settle(completion.complete(prompts.extraction_prompts(chunks, types), fn, tiers, calls))
    out = extract_model(answers, chunks, documents, settle=settle)
    elements = settle(evidence.verify_elements(out.elements, chunks, settle=settle))
    rates = evidence.verification_summary(out.summary, elements).select("document_id", "verification_rate")
    lost = answers.where(F.col("content").isNull()).select("document_id", F.col("error").alias("error_message")).distinct()
    return Extracted(
        elements, out.relations, out.summary.join(rates, "document_id"), out.failures.unionByName(lost)
    )


def expected_calls(documents: DataFrame, elements: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(document_id, step) of calls whose reply a document needs.

    Without a contradiction reply a document goes on; completeness is asked about where some expectation is met.
    """
    judged = documents.where(F.col("document_type") != "generic")
    met = quality.schema_matches(judged, elements, catalogue).select("document_id").distinct()
    parts = [("ambiguity", documents.select("document_id")), ("completeness", met), ("suggestion", documents.select("document_id"))]
    out = [ids.withColumn("step", F.lit(step)) for step, ids in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def phase_failures(
    documents: DataFrame, elements: DataFrame, catalogue: DataFrame, responses: DataFrame
) -> DataFrame:
    """The first phase that fails each document, and why: a reply that cannot be read, a call that failed, or none at all."""
    lost = _no_reply(responses, expected_calls(documents, elements, catalogue))
    of = lambda step: lost.where(F.col("step") == step).select("document_id", "error_message")
    phases = [
        ("analyzing_contradictions", replies.parse_contradictions(responses).failures),
        ("analyzing_ambiguities", replies.parse_ambiguities(responses).failures.unionByName(of("ambiguity"))),
        (
            "analyzing_completeness",
            replies.parse_partials(responses, documents).failures.unionByName(of("completeness")).unionByName(
                quality.completeness_errors(documents, elements, catalogue)
            ),
        ),
        ("generating_suggestions", replies.parse_suggestions(responses).failures.unionByName(of("suggestion"))),
    ]
    failures = None
    for rank, (phase, rows) in enumerate(phases):
        rows = rows.select("document_id", F.struct(F.lit(rank), F.lit(phase), "error_message").alias("_f"))
        failures = rows if failures is None else failures.unionByName(rows)
    return failures.groupBy("document_id").agg(F.min("_f").alias("_f")).select(
        "document_id", F.col("_f.col2").alias("error_phase"), F.col("_f.error_message").alias("error_message")
    )


def assess_replies(
    documents: DataFrame,
    elements: DataFrame,
    relations: DataFrame,
    chunks: DataFrame,
    catalogue: DataFrame,
    responses: DataFrame,
    threshold: float = 0.8,
    fuzzy: bool = True,
    settle: Settle | None = None,
    started_at: Column | None = None,
    completed_at: Column | None = None,
) -> Assessed:
    """Quality results from stored replies of all four steps, with the times of the run (now, if not given).

    `documents(document_id, document_type)`. The first phase that fails a document names its failure; what it keeps then
    is decided when the results are written (`sources.tables.persist_quality`).
    """
    keep = (lambda df: df) if settle is None else settle
    responses = keep(replies.judge(responses.where(F.col("step").isin(list(quality.RUN_VERSIONS)))))
    struct, struct_refs = graph.structural_contradictions(elements, relations)
    semantic = replies.parse_contradictions(responses)
    vague = replies.parse_ambiguities(responses)
    partial = replies.parse_partials(responses, documents)
    said = replies.parse_suggestions(responses)
    findings = quality.all_inconsistencies(quality.contradictions(struct, semantic.findings), vague.findings)
    findings = keep(quality.flag_unverified(keep(findings), elements))
    missing = keep(quality.missing_elements(documents, elements, catalogue).unionByName(partial.rows))
    proposed = quality.suggest(said.findings, said.refs, findings, missing, chunks, settle=settle)
    refs = keep(struct_refs.unionByName(semantic.refs).unionByName(vague.refs).unionByName(proposed.refs))
    checked = keep(evidence.verify_evidence(refs, chunks, threshold, fuzzy, settle)).drop("match")
    findings = evidence.all_evidence_unverified(findings, checked, quality.OWNER_KEY)
    suggestions = evidence.all_evidence_unverified(proposed.suggestions, checked, quality.OWNER_KEY)
    failures = keep(phase_failures(documents, elements, catalogue, responses))
    good = documents.join(failures, "document_id", "left_anti")
    results = quality.finding_counts(good, findings, missing, suggestions).join(
        documents.select("document_id", "document_type"), "document_id"
    )
    steps = F.col("step").isin(list(quality.RUN_VERSIONS)) & F.col("content").isNotNull()
    models = responses.where(steps).groupBy("document_id").agg(F.max_by("model_id", "step").alias("model_id"))
    now = F.current_timestamp()
    results = quality.run_metadata(
        results, models, now if started_at is None else started_at, now if completed_at is None else completed_at
    )
    return Assessed(findings, missing, suggestions, checked, results.withColumn("status", F.lit("completed")), failures)


def _no_reply(responses: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected calls that failed, or of which there is no trace."""
    call = ["document_id", "step"]
    came = responses.groupBy(*call).agg(F.max(F.col("content").isNotNull()).alias("_ok"), F.max("error").alias("_error"))
    return expected.join(came, call, "left").where(~F.coalesce("_ok", F.lit(False))).select(
        *call, F.coalesce("_error", F.lit("no reply")).alias("error_message")
    )


def assess_quality(
    documents: DataFrame,
    elements: DataFrame,
    relations: DataFrame,
    chunks: DataFrame,
    catalogue: DataFrame,
    fn: completion.Model,
    tiers: completion.Tiers = completion.Tiers(),
    settle: Settle = stored,
    calls: completion.Calls = completion.Calls(),
) -> Assessed:
    """Quality results with a live model; suggestions are asked for with the findings of the first three steps."""

    def ask(rows: DataFrame) -> DataFrame:
        return settle(completion.complete(rows, fn, tiers, calls))

    started = F.lit(datetime.now(timezone.utc))
    matches = quality.schema_matches(documents.where(F.col("document_type") != "generic"), elements, catalogue)
    got = ask(prompts.contradiction_prompts(elements, relations, chunks))
    got = got.unionByName(ask(prompts.ambiguity_prompts(documents, elements, chunks)))
    got = got.unionByName(ask(prompts.completeness_prompts(matches, catalogue)))
    early = assess_replies(documents, elements, relations, chunks, catalogue, got, fuzzy=False)
    got = got.unionByName(
        ask(prompts.suggestion_prompts(documents, early.findings, early.missing, elements, chunks))
    )
    return assess_replies(documents, elements, relations, chunks, catalogue, got, settle=settle, started_at=started)


def finish_answers(
    parsed: replies.ParsedAnswers, chunks: DataFrame, at: Column, fuzzy: bool = True, settle: Settle | None = None
) -> Answered:
    """Check the quoted evidence of parsed answers and attach what is recorded with them.

    With references the flag is computed, whatever the reply said; without, it is left as it came.
    """
    refs = evidence.verify_evidence(parsed.refs, chunks, fuzzy=fuzzy, settle=settle).drop("match")
    seen = refs.groupBy(*ctx.Q).agg(F.bool_or("evidence_verified").alias("_any"))
    answers = (
        parsed.answers.join(seen, ctx.Q, "left")
        .withColumn("all_evidence_unverified", F.coalesce(~F.col("_any"), "all_evidence_unverified"))
        .select(
            *ctx.Q,
            "answer",
            "answerable",
            "all_evidence_unverified",
            F.lit(PROMPT_VERSIONS["answer"]).alias("prompt_version"),
            "model_id",
            F.lit(TEMPERATURE).alias("temperature"),
            at.alias("ts"),
        )
    )
    return Answered(answers, refs, parsed.failures)


def answer_questions(
    questions: DataFrame,
    elements: DataFrame,
    relations: DataFrame,
    chunks: DataFrame,
    fn: completion.Model,
    at: Column,
    tiers: completion.Tiers = completion.Tiers(),
    settle: Settle = stored,
    calls: completion.Calls = completion.Calls(),
) -> Answered:
    """Score, choose context, ask, read (with one retry), check the evidence; questions without context get a fixed answer."""
    scored = settle(completion.complete(prompts.scoring_prompts(questions, elements), fn, tiers, calls))
    with_elements = questions.join(elements.select("document_id").distinct(), "document_id", "left_semi")
    marks = replies.parse_scores(settle(replies.judge(scored)), with_elements)
    chosen = ctx.build_context(questions, elements, relations, marks.scores, marks.unscored, settle=settle)
    summary = chosen.summary
    asked = settle(prompts.answer_prompts(questions, chosen.elements, chosen.relations))
    got = settle(completion.complete(asked, fn, tiers, calls))
    parsed = completion.retry_unparsed(asked, settle(replies.judge(got)), fn, tiers, settle, calls)
    done = finish_answers(parsed, chunks, at, settle=settle)
    lost = got.where(F.col("content").isNull()).select(
        *ctx.Q, "attempt", "content", F.col("error").alias("error_message")
    )
    return Answered(
        done.answers.unionByName(ctx.cannot_answer(questions, summary, at)),
        done.refs,
        done.failures.unionByName(lost),
    )
