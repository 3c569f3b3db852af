"""The element/relation graph of each document: clean-up, contradictions, listings.

Edges are rows; their reading order is (element_pos, pos, target_id). De-duplication is aggregation (`min_by`/`max_by`),
so a pair repeated any number of times is combined before it is shuffled.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import normalize_ws, owner_key, stable_id, strip, truncate
from corpusloom.model import ELEMENT_TYPES, MAX_DESCRIPTION_CHARS, MAX_EVIDENCE_CHARS

EDGE_ORDER = ["element_pos", "pos", "target_id"]


class Graph(NamedTuple):
    elements: DataFrame
    relations: DataFrame


def _rest(df: DataFrame, *keys: str) -> Column:
    return F.struct(*[c for c in df.columns if c not in keys])


def _unpack(df: DataFrame, packed: str, like: DataFrame) -> DataFrame:
    inner = df.schema[packed].dataType.names
    return df.select(*[F.col(f"{packed}.{c}") if c in inner else F.col(c) for c in like.columns])


def normalize_elements(elements: DataFrame) -> DataFrame:
    """Strip names, contents and evidence; lower-case types."""
    ref = F.col("source_ref").withField("evidence", strip("source_ref.evidence"))
    return elements.withColumns(
        {"name": strip("name"), "content": strip("content"), "type": F.lower("type"), "source_ref": ref}
    )


def dedupe_elements(elements: DataFrame, relations: DataFrame) -> Graph:
    """Keep the first element per (lower-cased stripped name, type) of a document, and the edges it brought along."""
    key = F.lower(strip("name")).alias("_key")
    firsts = (
        elements.withColumn("_key", key)
        .groupBy("document_id", "type", "_key")
        .agg(F.min_by(_rest(elements, "document_id", "type"), "pos").alias("_row"))
    )
    kept = _unpack(firsts, "_row", elements)
    return Graph(kept, _edges_of(relations, kept))


def _edges_of(relations: DataFrame, elements: DataFrame) -> DataFrame:
    owners = elements.select("document_id", F.col("pos").alias("element_pos"))
    return relations.join(owners, ["document_id", "element_pos"], "left_semi")


def enrich_source_refs(elements: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Page (paged formats) or section (markdown) of the cited chunk; the element's own value where the chunk has none.

    0 and the empty string count as missing.
    """
    ctx = chunks.select(
        "document_id",
        F.col("chunk_id").alias("_chunk"),
        F.col("structural_context.page").alias("_page"),
        F.col("structural_context.section").alias("_section"),
    )
    formats = documents.select("document_id", F.col("format").alias("_format"))
    page = F.coalesce(F.nullif("_page", F.lit(0)), "source_ref.page")
    section = F.coalesce(F.nullif("_section", F.lit("")), "source_ref.section")
    ref = F.struct(
        F.col("source_ref.chunk_id").alias("chunk_id"),
        F.when(F.col("_format") == "pdf", page).otherwise(F.col("source_ref.page")).alias("page"),
        F.when(F.col("_format") == "markdown", section).otherwise(F.col("source_ref.section")).alias("section"),
        F.col("source_ref.evidence").alias("evidence"),
    )
    return (
        elements.withColumn("_chunk", F.col("source_ref.chunk_id"))
        .join(ctx, ["document_id", "_chunk"], "left")
        .join(formats, "document_id", "left")
        .withColumn("source_ref", ref)
        .select(*elements.columns)
    )


def drop_dangling(relations: DataFrame, elements: DataFrame) -> DataFrame:
    """Edges whose target is an element of the same document."""
    ids = elements.select("document_id", F.col("id").alias("target_id"))
    return relations.join(ids, ["document_id", "target_id"], "left_semi").select(*relations.columns)


def symmetrize_contradicts(elements: DataFrame, relations: DataFrame) -> Graph:
    """Make `contradicts` mutual.

    Elements sharing an id become one: the last one's content and edges at the first one's place. Missing reverse edges
    come after the element's own, without description.
    """
    merged = elements.groupBy("document_id", "id").agg(
        F.max_by(_rest(elements, "document_id", "id", "pos"), "pos").alias("_row"),
        F.min("pos").alias("pos"),
        F.max("pos").alias("_last"),
    )
    places = merged.select("document_id", F.col("id").alias("source_id"), "pos", "_last")
    own = (
        relations.withColumnRenamed("pos", "_rel")
        .join(places, ["document_id", "source_id"])
        .where(F.col("element_pos") == F.col("_last"))
        .select(
            "document_id",
            F.col("pos").alias("element_pos"),
            F.col("_rel").alias("pos"),
            "source_id",
            "target_id",
            "type",
            "description",
        )
    )
    stated = own.where(F.col("type") == "contradicts").select("document_id", "source_id", "target_id")
    mirrored = (
        relations.where(F.col("type") == "contradicts")
        .select("document_id", F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
        .distinct()
    )
    added = (
        mirrored.join(stated, ["document_id", "source_id", "target_id"], "left_anti")
        .join(places, ["document_id", "source_id"])
        .select(
            "document_id",
            F.col("pos").alias("element_pos"),
            F.lit(2**31 - 1).alias("pos"),
            "source_id",
            "target_id",
            F.lit("contradicts").alias("type"),
            F.lit(None).cast("string").alias("description"),
        )
    )
    return Graph(_unpack(merged, "_row", elements), own.unionByName(added))


def _ends(elements: DataFrame, prefix: str) -> DataFrame:
    return elements.select(
        "document_id",
        F.col("id").alias(f"{prefix}_id"),
        F.struct("name", "type", "source_ref", "verified").alias(prefix),
    )


def structural_contradictions(elements: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, references) from `contradicts` edges: one finding per unordered pair, the first edge met decides."""
    pair = [F.least("source_id", "target_id").alias("_a"), F.greatest("source_id", "target_id").alias("_b")]
    first = (
        relations.where(F.col("type") == "contradicts")
        .groupBy("document_id", *pair)
        .agg(F.min_by(F.struct("source_id", "target_id", "description", *EDGE_ORDER[:2]), F.struct(*EDGE_ORDER)).alias("e"))
        .select("document_id", "e.*")
    )
    joined = first.join(_ends(elements, "source"), ["document_id", "source_id"]).join(
        _ends(elements, "target"), ["document_id", "target_id"]
    )
    text = F.concat(
        F.lit("Element '"), F.col("source.name"), F.lit("' contradicts element '"), F.col("target.name"), F.lit("'.")
    )
    described = F.when(F.coalesce("description", F.lit("")) != "", F.col("description")).otherwise(text)
    base = joined.select(
        "document_id",
        stable_id("contra-struct-", "document_id", "source_id", "target_id").alias("finding_id"),
        owner_key("edge", "element_pos", "pos").alias("owner"),
        F.array(F.lit(0), F.col("element_pos"), F.col("pos").cast("long")).alias("ord"),
        F.lit("contradiction").alias("type"),
        truncate(described, MAX_DESCRIPTION_CHARS).alias("description"),
        F.lit("high").alias("severity"),
        F.array("source_id", "target_id").alias("affected_element_ids"),
        (~F.col("source.verified") | ~F.col("target.verified")).alias("involves_unverified_elements"),
        F.lit(False).alias("all_evidence_unverified"),
        F.lit(True).alias("from_explicit_relationship"),
        F.array("source.source_ref", "target.source_ref").alias("_refs"),
    )
    refs = base.select(
        "document_id",
        "owner",
        F.col("finding_id").alias("owner_id"),
        F.posexplode("_refs").alias("ref_pos", "r"),
    ).select(
        "document_id",
        "owner",
        "owner_id",
        "ref_pos",
        "r.chunk_id",
        "r.page",
        "r.section",
        truncate("r.evidence", MAX_EVIDENCE_CHARS).alias("evidence"),
        F.lit(False).alias("evidence_verified"),
    )
    return base.drop("_refs"), refs


def extraction_summary(documents: DataFrame, elements: DataFrame, relations: DataFrame) -> DataFrame:
    """Element and relation counts per document."""
    e = elements.groupBy("document_id").agg(F.count("*").alias("element_count"))
    r = relations.groupBy("document_id").agg(F.count("*").alias("relationship_count"))
    return (
        documents.select("document_id")
        .join(e, "document_id", "left")
        .join(r, "document_id", "left")
        .na.fill(0, ["element_count", "relationship_count"])
    )


def lacks_purpose(documents: DataFrame, elements: DataFrame) -> DataFrame:
    """Does the document miss an element of the purpose type?"""
    has = elements.groupBy("document_id").agg(F.bool_or(F.col("type") == "proposito").alias("_has"))
    return (
        documents.select("document_id")
        .join(has, "document_id", "left")
        .select("document_id", (~F.coalesce("_has", F.lit(False))).alias("lacks_purpose"))
    )


def elements_by_type(documents: DataFrame, elements: DataFrame) -> DataFrame:
    """Element count for each of the six types in taxonomy order, empty groups included, other types left out."""
    counts = elements.groupBy("document_id").agg(
        *[F.count_if(F.col("type") == t).alias(f"_{t}") for t in ELEMENT_TYPES]
    )
    groups = F.array(
        *[
            F.struct(
                F.lit(i).alias("type_pos"), F.lit(t).alias("type"), F.coalesce(f"_{t}", F.lit(0)).alias("element_count")
            )
            for i, t in enumerate(ELEMENT_TYPES)
        ]
    )
    return (
        documents.select("document_id")
        .join(counts, "document_id", "left")
        .select("document_id", F.inline(groups))
    )


def related_elements(relations: DataFrame, elements: DataFrame) -> DataFrame:
    """Outgoing edges with the target's name and type; an unknown target shows its id and no type."""
    targets = elements.select(
        "document_id", F.col("id").alias("target_id"), F.col("name").alias("_name"), F.col("type").alias("target_type")
    )
    return relations.join(targets, ["document_id", "target_id"], "left").select(
        "document_id",
        "element_pos",
        "pos",
        "source_id",
        "target_id",
        "type",
        F.coalesce("_name", "target_id").alias("target_name"),
        "target_type",
    )


def relationship_list(elements: DataFrame, relations: DataFrame) -> DataFrame:
    """All edges as (source name, type, target name or id)."""
    sources = elements.select("document_id", F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return (
        related_elements(relations, elements)
        .join(sources, ["document_id", "source_id"])
        .select("document_id", "element_pos", "pos", "source_id", "source_name", "type", "target_name")
    )


def edge_set(relations: DataFrame) -> DataFrame:
    """Distinct (source, target, type), contradictions in both directions."""
    edges = relations.select("document_id", "source_id", "target_id", "type")
    back = edges.where(F.col("type") == "contradicts").select(
        "document_id", F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "type"
    )
    return edges.unionByName(back).distinct()


def orphan_elements(elements: DataFrame, relations: DataFrame) -> DataFrame:
    """Actors taking part in nothing, and rules tied to no concept."""
    taking_part = relations.where(F.col("type") == "participates_in").select(
        "document_id", F.col("source_id").alias("id")
    )
    concepts = elements.where(F.col("type") == "concepto").select("document_id", F.col("id").alias("_concept"))
    touching = relations.select("document_id", F.col("source_id").alias("id"), F.col("target_id").alias("_concept"))
    touching = touching.unionByName(touching.select("document_id", F.col("_concept").alias("id"), F.col("id").alias("_concept")))
    tied = touching.join(concepts, ["document_id", "_concept"], "left_semi").select("document_id", "id")
    actors = elements.where(F.col("type") == "actor").join(taking_part, ["document_id", "id"], "left_anti")
    rules = elements.where(F.col("type") == "regla").join(tied, ["document_id", "id"], "left_anti")
    return actors.unionByName(rules).select("document_id", "pos", "id", "type", "name")


def compare_runs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Shared and differing elements of two runs per document, by (type, normalised name), with their Jaccard index."""

    def keys(df: DataFrame, flag: str) -> DataFrame:
        return df.select("document_id", "type", F.lower(normalize_ws("name")).alias("name")).distinct().withColumn(
            flag, F.lit(1)
        )

    both = keys(first, "_a").join(keys(second, "_b"), ["document_id", "type", "name"], "full_outer")
    a, b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return (
        both.groupBy("document_id")
        .agg(
            F.count_if(a & b).alias("shared"), F.count_if(a & ~b).alias("only_first"), F.count_if(b & ~a).alias("only_second")
        )
        .withColumn(
            "jaccard", F.col("shared") / (F.col("shared") + F.col("only_first") + F.col("only_second"))
        )
    )
