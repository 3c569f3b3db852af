"""Choosing what a question gets to see: ranking, one hop, token budget.

All operators work on many (question, document) pairs at once. Ranked prefixes are cut by `row_number() <= n`, which Spark
also applies before the shuffle; a token costs at least one unit of budget, so no more than `budget` rows can fit and the
running sums see bounded groups.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import annotate_unverified, element_tokens, relation_tokens
from corpusloom.model import CANNOT_ANSWER, CONTEXT_RATIO, CONTEXT_WINDOW_TOKENS, MAX_DIRECT_ELEMENTS, PROMPT_VERSIONS, TEMPERATURE
from corpusloom.operators.graph import EDGE_ORDER

Q = ["question_id", "document_id"]


class Context(NamedTuple):
    elements: DataFrame
    relations: DataFrame
    summary: DataFrame


def _last_scores(scores: DataFrame) -> DataFrame:
    return scores.groupBy(*Q, "id").agg(F.max_by("score", "pos").alias("score"))


def attach_scores(
    questions: DataFrame, elements: DataFrame, scores: DataFrame, unscored: DataFrame | None = None
) -> DataFrame:
    """All elements of each question's document with their score: missing is 0, of a repeated id the last entry counts.

    `scores(question_id, document_id, pos, id, score)`; questions in `unscored` (their scoring call or reply failed) give
    every element 1.
    """
    pairs = questions.select(*Q).join(elements, "document_id")
    scored = pairs.join(_last_scores(scores), [*Q, "id"], "left").withColumn("score", F.coalesce("score", F.lit(0)))
    if unscored is None:
        return scored
    flat = unscored.select(*Q).distinct().withColumn("_flat", F.lit(1))
    return scored.join(flat, Q, "left").withColumn("score", F.coalesce("_flat", "score")).drop("_flat")


def relevant_elements(
    questions: DataFrame, elements: DataFrame, scores: DataFrame, unscored: DataFrame | None = None
) -> DataFrame:
    """The rows of `attach_scores` with a positive score, found from the score side: no question meets its whole document."""
    asked = scores.join(questions.select(*Q), Q, "left_semi")
    if unscored is not None:
        asked = asked.join(unscored, Q, "left_anti")
    # grouped by the question first, so that the joins' shuffle serves the aggregate too
    positive = _last_scores(asked).where(F.col("score") > 0)
    rows = positive.join(elements, ["document_id", "id"])
    if unscored is None:
        return rows
    flat = questions.select(*Q).join(unscored.select(*Q).distinct(), Q, "left_semi").join(elements, "document_id")
    return rows.unionByName(flat.withColumn("score", F.lit(1)))


def rank_relevant(scored: DataFrame, limit: int = MAX_DIRECT_ELEMENTS) -> DataFrame:
    """The `limit` best elements per question: score, then verified, then document order."""
    order = Window.partitionBy(*Q).orderBy(F.desc("score"), F.desc("verified"), "pos")
    return scored.where(F.col("score") > 0).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def one_hop(direct: DataFrame, relations: DataFrame, elements: DataFrame) -> DataFrame:
    """Elements one outgoing edge away from a direct element that are not direct themselves."""
    out = (
        direct.select(*Q, F.col("id").alias("source_id"))
        .join(relations.select("document_id", "source_id", "target_id"), ["document_id", "source_id"])
        .select(*Q, F.col("target_id").alias("id"))
        .distinct()
    )
    fresh = out.join(direct.select(*Q, "id"), [*Q, "id"], "left_anti")
    return fresh.join(elements, ["document_id", "id"])


def with_tokens(elements: DataFrame) -> DataFrame:
    """Context form of elements: content marked when unverified, and the token estimate."""
    marked = elements.withColumn("content", annotate_unverified("content", "verified"))
    return marked.withColumn(
        "tokens", element_tokens(F.col("id"), F.col("type"), F.col("name"), F.col("content"), F.col("source_ref.evidence"))
    )


def _fit(rows: DataFrame, order: list[Column | str], budget: Column | int, at_most: int) -> DataFrame:
    """Longest prefix per question whose tokens stay within the budget (stop at the first row that does not fit)."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    by = Window.partitionBy(*Q).orderBy(*order)
    ranked = rows.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= at_most)
    running = F.sum("tokens").over(Window.partitionBy(*Q).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("_sum", running).where(F.col("_sum") <= budget).drop("_n", "_sum")


def budget_direct(direct: DataFrame, budget: int) -> DataFrame:
    """The ranked elements that fit; how many may be ranked is the caller's choice, and each costs a token at least."""
    return _fit(direct, ["rank"], budget, budget)


def _used(*parts: DataFrame) -> DataFrame:
    rows = parts[0].select(*Q, "tokens")
    for part in parts[1:]:
        rows = rows.unionByName(part.select(*Q, "tokens"))
    return rows.groupBy(*Q).agg(F.sum("tokens").alias("_used"))


def budget_relational(related: DataFrame, direct: DataFrame, budget: int) -> DataFrame:
    """One-hop elements that still fit: verified first, then by name (id breaks ties)."""
    rows = related.join(_used(direct), Q, "left")
    room = F.lit(budget) - F.coalesce("_used", F.lit(0))
    return _fit(rows, [F.desc("verified"), "name", "id"], room, budget).drop("_used")


def context_relations(direct: DataFrame, relations: DataFrame, included: DataFrame) -> DataFrame:
    """Edges from included direct elements to included elements, first of each (source, target, type)."""
    sources = direct.select(*Q, "rank", F.col("id").alias("source_id"))
    targets = included.select(*Q, F.col("id").alias("target_id"))
    edges = sources.join(relations, ["document_id", "source_id"]).join(targets, [*Q, "target_id"], "left_semi")
    return (
        edges.groupBy(*Q, "source_id", "target_id", "type")
        .agg(F.min_by(F.struct("rank", "description", *EDGE_ORDER[:2]), F.struct("rank", *EDGE_ORDER)).alias("e"))
        .select(*Q, "source_id", "target_id", "type", "e.*")
        .withColumn(
            "tokens", relation_tokens(F.col("source_id"), F.col("target_id"), F.col("type"), F.col("description"))
        )
    )


def budget_relations(edges: DataFrame, included: DataFrame, budget: int) -> DataFrame:
    """All edges if they fit, else the leading ones that do."""
    rows = edges.join(_used(included), Q, "left")
    room = F.lit(budget) - F.coalesce("_used", F.lit(0))
    return _fit(rows, ["rank", *EDGE_ORDER], room, budget).drop("_used")


NODE = ["id", "type", "name", "content", "source_ref", "verified", "tokens"]


def _tagged(ranked: DataFrame, relations: DataFrame, elements: DataFrame) -> DataFrame:
    """All rows a question's context is chosen from: its ranked elements, and their edges (`edge`) with the target element."""
    both = F.explode(F.array(F.lit(False), F.lit(True))).alias("edge")
    own = ranked.select(*Q, "rank", F.col("id").alias("source_id"), F.struct(*NODE).alias("_own"), both)
    edges = relations.select(
        "document_id", "source_id", "target_id", F.struct("type", "description", *EDGE_ORDER[:2]).alias("rel")
    )
    targets = with_tokens(elements).select("document_id", F.col("id").alias("target_id"), F.struct(*NODE).alias("_target"))
    out = own.alias("o").join(
        edges.alias("e"),
        (F.col("o.document_id") == F.col("e.document_id")) & (F.col("o.source_id") == F.col("e.source_id")) & F.col("edge"),
        "left",
    )
    out = out.select("o.*", "e.target_id", "e.rel").where("NOT edge OR target_id IS NOT NULL")
    out = out.join(targets, ["document_id", "target_id"], "left").where("NOT edge OR _target IS NOT NULL")
    tokens = relation_tokens(F.col("source_id"), F.col("target_id"), F.col("rel.type"), F.col("rel.description"))
    node = F.when(F.col("edge"), F.col("_target")).otherwise(F.col("_own"))
    return out.select(*Q, "rank", "edge", "source_id", "target_id", "rel", tokens.alias("rel_tokens"), node.alias("_n")).select(
        "*", "_n.*"
    ).drop("_n")


def _spend(rows: DataFrame, budget: int) -> DataFrame:
    """Spend a question's budget on ranked elements, then on their neighbours, then on edges between what is in.

    Each phase stops at its first row that does not fit. Adds `direct`, `related` and `linked`: the row is in as a ranked
    element, as a neighbour, as an edge. All windows lie within a question, so the rows are shuffled once.
    """
    line = lambda *order: Window.partitionBy(*Q).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole, node = Window.partitionBy(*Q), Window.partitionBy(*Q, "id")
    zero = F.lit(0).cast("long")
    edge_order = ["rel.element_pos", "rel.pos", "target_id"]

    out = rows.withColumn("_sum", F.sum(F.when(~F.col("edge"), F.col("tokens"))).over(line("edge", "rank")))
    out = out.withColumn("direct", ~F.col("edge") & (F.col("_sum") <= budget))
    out = out.withColumn("_used", F.coalesce(F.max(F.when(F.col("direct"), F.col("_sum"))).over(whole), zero))
    out = out.withColumn("_ranks", F.coalesce(F.max(F.when(F.col("direct"), F.col("rank"))).over(whole), F.lit(0)))

    out = out.withColumn("_ranked", F.max(~F.col("edge")).over(node))
    first = F.row_number().over(node.orderBy("edge", "rank", *edge_order)) == 1
    out = out.withColumn("_hop", first & ~F.col("_ranked"))
    hops = line(F.desc("_hop"), F.desc("verified"), "name", "id")
    out = out.withColumn("_sum", F.col("_used") + F.sum(F.when(F.col("_hop"), F.col("tokens"))).over(hops))
    out = out.withColumn("related", F.col("_hop") & (F.col("_sum") <= budget))
    out = out.withColumn("_used", F.coalesce(F.max(F.when(F.col("related"), F.col("_sum"))).over(whole), "_used"))

    inside = F.max(F.col("direct") | F.col("related")).over(node)
    out = out.withColumn("_open", F.col("edge") & (F.col("rank") <= F.col("_ranks")) & inside)
    repeats = Window.partitionBy(*Q, "_open", "source_id", "target_id", "rel.type").orderBy("rank", *edge_order)
    out = out.withColumn("_open", F.col("_open") & (F.row_number().over(repeats) == 1))
    edges = line(F.desc("_open"), "rank", *edge_order)
    out = out.withColumn("_sum", F.col("_used") + F.sum(F.when(F.col("_open"), F.col("rel_tokens"))).over(edges))
    out = out.withColumn("linked", F.col("_open") & (F.col("_sum") <= budget))
    return out.drop("_sum", "_used", "_ranks", "_ranked", "_hop", "_open")


def build_context(
    questions: DataFrame,
    elements: DataFrame,
    relations: DataFrame,
    scores: DataFrame,
    unscored: DataFrame | None = None,
    window_tokens: int = CONTEXT_WINDOW_TOKENS,
    limit: int = MAX_DIRECT_ELEMENTS,
    settle: Callable[[DataFrame], DataFrame] | None = None,
) -> Context:
    """Context elements, relations and totals per question. Questions without a relevant element have no summary row.

    `settle` may store the chosen rows, from which all three are read.
    """
    keep = (lambda df: df) if settle is None else settle
    budget = int(window_tokens * CONTEXT_RATIO)
    ranked = with_tokens(rank_relevant(relevant_elements(questions, elements, scores, unscored), limit))
    spent = _spend(_tagged(ranked, relations, elements), budget)
    chosen = keep(spent.where("NOT edge OR related OR linked"))
    included = chosen.where("direct OR related").select(
        *Q,
        *NODE,
        F.when(F.col("direct"), "direct").otherwise("related").alias("role"),
        F.when(F.col("direct"), F.col("rank").cast("long")).alias("place"),
    )
    edges = chosen.where("linked").select(
        *Q, "source_id", "target_id", "rel.type", "rank", "rel.description", *[f"rel.{c}" for c in EDGE_ORDER[:2]],
        F.col("rel_tokens").alias("tokens"),
    )
    is_in = F.col("direct") | F.col("related")
    total = F.sum(F.when(is_in, F.col("tokens")).otherwise(0) + F.when(F.col("linked"), F.col("rel_tokens")).otherwise(0))
    summary = chosen.groupBy(*Q).agg(
        total.cast("long").alias("total_tokens"),
        F.count_if(is_in).alias("element_count"),
        F.bool_or(is_in & ~F.col("verified")).alias("has_unverified_elements"),
    )
    return Context(included, edges, summary)


def cannot_answer(questions: DataFrame, summary: DataFrame, at: Column) -> DataFrame:
    """Fixed answers for questions without context; no model is asked."""
    return questions.select(*Q).join(summary, Q, "left_anti").select(
        *Q,
        F.lit(CANNOT_ANSWER).alias("answer"),
        F.lit(False).alias("answerable"),
        F.lit(False).alias("all_evidence_unverified"),
        F.lit(PROMPT_VERSIONS["answer"]).alias("prompt_version"),
        F.lit("none").alias("model_id"),
        F.lit(TEMPERATURE).alias("temperature"),
        at.alias("ts"),
    )
