"""Queries over elements and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import graph as g
from corpusloom.plans import analysis, corpus
from corpusloom.plans.catalog.registry import query


def els(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.stored(spark, sf_dir, "flagged_elements")


def rels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.stored(spark, sf_dir, "relations")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.document_types(spark, sf_dir)


@query("""SELECT document_id, pos, trim(name, ' ' || chr(9) || chr(10) || chr(13)) AS name, trim(content, ' ' || chr(9) || chr(10) || chr(13)) AS content,
    type, trim(evidence, ' ' || chr(9) || chr(10) || chr(13)) AS evidence FROM el""")
def normalize_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = els(spark, sf_dir).withColumns(
        {"name": F.concat(F.lit("  \n"), "name"), "content": F.concat("content", F.lit("\t ")), "type": F.upper("type")}
    )
    return g.normalize_elements(padded).select("document_id", "pos", "name", "content", "type", "source_ref.evidence")


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY document_id, lower(substr(name, 1, 4)), type ORDER BY pos) AS n FROM el)
    SELECT k.document_id, k.pos, k.id, (SELECT count(*) FROM re WHERE re.document_id = k.document_id AND re.element_pos = k.pos) AS edges
    FROM k WHERE n = 1""")
def dedupe_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names cut to four letters, so that there are repeats."""
    short = els(spark, sf_dir).withColumn("name", F.substring("name", 1, 4))
    out = g.dedupe_elements(short, rels(spark, sf_dir))
    edges = out.relations.groupBy("document_id", F.col("element_pos").alias("pos")).agg(F.count("*").alias("edges"))
    return out.elements.join(edges, ["document_id", "pos"], "left").select(
        "document_id", "pos", "id", F.coalesce("edges", F.lit(0)).alias("edges")
    )


_FMT = "CASE el.doc_id % 3 WHEN 0 THEN 'markdown' WHEN 1 THEN 'pdf' ELSE 'plain_text' END"


@query(f"""SELECT el.document_id, pos, CASE WHEN {_FMT} = 'pdf' AND c.ord IS NOT NULL AND c.ord % 4 <> 0 THEN c.ord % 4 ELSE 99 END AS page,
    CASE WHEN {_FMT} = 'markdown' AND c.ord IS NOT NULL THEN c.section ELSE 'own' END AS section
    FROM el LEFT JOIN ch c ON c.document_id = el.document_id AND c.chunk_id = el.chunk_id""")
def enrich_source_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.col("source_ref").withField("page", F.lit(99)).withField("section", F.lit("own"))
    chunks = corpus.stored(spark, sf_dir, "chunks").withColumn(
        "structural_context", F.col("structural_context").withField("page", F.col("order") % 4)
    )
    kind = F.col("doc_id") % 3
    formats = corpus.raw_documents(spark, sf_dir).select(
        "document_id", F.when(kind == 0, "markdown").when(kind == 1, "pdf").otherwise("plain_text").alias("format")
    )
    out = g.enrich_source_refs(els(spark, sf_dir).withColumn("source_ref", ref), chunks, formats)
    return out.select("document_id", "pos", "source_ref.page", "source_ref.section")


@query("SELECT document_id, element_pos, pos, source_id, target_id, type FROM rk")
def drop_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = g.drop_dangling(rels(spark, sf_dir), els(spark, sf_dir))
    return out.select("document_id", "element_pos", "pos", "source_id", "target_id", "type")


@query("""SELECT document_id, source_id, target_id, type, count(*) AS copies FROM (SELECT document_id, source_id, target_id, type FROM rk
    UNION ALL (SELECT document_id, target_id, source_id, type FROM rk WHERE type = 'contradicts'
    EXCEPT SELECT document_id, source_id, target_id, type FROM rk WHERE type = 'contradicts')) GROUP BY ALL""")
def symmetrize_contradicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = els(spark, sf_dir)
    out = g.symmetrize_contradicts(e, g.drop_dangling(rels(spark, sf_dir), e))
    return out.relations.groupBy("document_id", "source_id", "target_id", "type").agg(F.count("*").alias("copies"))


@query("""WITH m AS (SELECT *, 'elem-' || (pos // 2) AS mid FROM el), e2 AS (SELECT document_id, mid AS id, max_by(name, pos) AS name, min(pos) AS pos,
    max(pos) AS last FROM m GROUP BY document_id, mid) SELECT document_id, id, name, pos,
    (SELECT count(*) FROM re WHERE re.document_id = e2.document_id AND re.element_pos = e2.last) AS edges FROM e2""")
def merge_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements sharing an id in pairs: the later one's content at the earlier one's place."""
    same = F.concat(F.lit("elem-"), F.floor(F.col("pos") / 2).cast("string"))
    e = els(spark, sf_dir).withColumn("id", same)
    source = F.concat(F.lit("elem-"), F.floor(F.col("element_pos") / 2).cast("string"))
    r = rels(spark, sf_dir).withColumns({"source_id": source, "type": F.lit("depends_on")})
    out = g.symmetrize_contradicts(e, r)
    edges = out.relations.groupBy("document_id", F.col("source_id").alias("id")).agg(F.count("*").alias("edges"))
    return out.elements.join(edges, ["document_id", "id"], "left").select(
        "document_id", "id", "name", "pos", F.coalesce("edges", F.lit(0)).alias("edges")
    )


@query("""SELECT document_id, finding_id, element_pos AS at, source_id || ',' || target_id AS affected, 'high' AS severity,
    substr(coalesce(description, 'Element ''' || s_name || ''' contradicts element ''' || t_name || '''.'), 1, 500) AS description,
    NOT s_verified OR NOT t_verified AS involves_unverified_elements FROM fi""")
def structural_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = g.structural_contradictions(els(spark, sf_dir), rels(spark, sf_dir))
    return found.select(
        "document_id",
        "finding_id",
        F.element_at("ord", 2).alias("at"),
        F.array_join("affected_element_ids", ",").alias("affected"),
        "severity",
        "description",
        "involves_unverified_elements",
    )


@query("""SELECT document_id, finding_id AS owner_id, 0 AS ref_pos, s_chunk AS chunk_id, s_evidence AS evidence FROM fi
    UNION ALL SELECT document_id, finding_id, 1, t_chunk, t_evidence FROM fi""")
def contradiction_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, refs = g.structural_contradictions(els(spark, sf_dir), rels(spark, sf_dir))
    return refs.select("document_id", "owner_id", "ref_pos", "chunk_id", "evidence")


@query("""SELECT document_id, (SELECT count(*) FROM el WHERE el.document_id = d.document_id) AS element_count,
    (SELECT count(*) FROM re WHERE re.document_id = d.document_id) AS relationship_count FROM d""")
def extraction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.extraction_summary(docs(spark, sf_dir), els(spark, sf_dir), rels(spark, sf_dir))


@query("""SELECT document_id, NOT EXISTS (SELECT 1 FROM el WHERE el.document_id = d.document_id AND type = 'proposito' AND pos > 0) AS lacks_purpose FROM d""")
def lacks_purpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.lacks_purpose(docs(spark, sf_dir), els(spark, sf_dir).where(F.col("pos") > 0))


@query("""WITH t AS (SELECT unnest(['proposito', 'concepto', 'actor', 'regla', 'proceso', 'restriccion']) AS type, unnest([0, 1, 2, 3, 4, 5]) AS type_pos)
    SELECT d.document_id, type_pos, type, (SELECT count(*) FROM el WHERE el.document_id = d.document_id AND el.type = t.type) AS element_count FROM d, t""")
def elements_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.elements_by_type(docs(spark, sf_dir), els(spark, sf_dir))


@query("""SELECT r.document_id, element_pos, r.pos, source_id, target_id, r.type, coalesce(t.name, target_id) AS target_name, t.type AS target_type
    FROM re r LEFT JOIN el t ON t.document_id = r.document_id AND t.id = target_id""")
def related_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.related_elements(rels(spark, sf_dir), els(spark, sf_dir))


@query("""SELECT r.document_id, element_pos, r.pos, source_id, s.name AS source_name, r.type, coalesce(t.name, target_id) AS target_name
    FROM re r JOIN el s ON s.document_id = r.document_id AND s.id = source_id LEFT JOIN el t ON t.document_id = r.document_id AND t.id = target_id""")
def relationship_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.relationship_list(els(spark, sf_dir), rels(spark, sf_dir))


@query("""SELECT document_id, source_id, target_id, type FROM re UNION SELECT document_id, target_id, source_id, type FROM re WHERE type = 'contradicts'""")
def edge_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.edge_set(rels(spark, sf_dir))


@query("""WITH t AS (SELECT document_id, source_id AS a, target_id AS b FROM re UNION ALL SELECT document_id, target_id, source_id FROM re),
    tied AS (SELECT t.document_id, a FROM t JOIN el c ON c.document_id = t.document_id AND c.id = b AND c.type = 'concepto')
    SELECT document_id, pos, id, type, name FROM el WHERE type = 'actor' AND NOT EXISTS (SELECT 1 FROM re WHERE re.document_id = el.document_id
    AND source_id = el.id AND re.type = 'participates_in') OR type = 'regla' AND NOT EXISTS (SELECT 1 FROM tied WHERE tied.document_id = el.document_id AND a = el.id)""")
def orphan_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.orphan_elements(els(spark, sf_dir), rels(spark, sf_dir))


@query(r"""WITH a AS (SELECT DISTINCT document_id, type, lower(trim(regexp_replace(name, '\s+', ' ', 'g'))) AS name FROM el WHERE pos % 5 <> 1),
    b AS (SELECT DISTINCT document_id, type, lower(trim(regexp_replace(name, '\s+', ' ', 'g'))) AS name FROM el WHERE pos % 4 <> 2),
    f AS (SELECT coalesce(a.document_id, b.document_id) AS document_id, a.name IS NOT NULL AS ia, b.name IS NOT NULL AS ib FROM a FULL JOIN b
        ON a.document_id = b.document_id AND a.type = b.type AND a.name = b.name)
    SELECT document_id, count(*) FILTER (ia AND ib) AS shared, count(*) FILTER (ia AND NOT ib) AS only_first, count(*) FILTER (ib AND NOT ia) AS only_second,
    count(*) FILTER (ia AND ib) / count(*) AS jaccard FROM f GROUP BY document_id""")
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = els(spark, sf_dir)
    return g.compare_runs(e.where(F.col("pos") % 5 != 1), e.where(F.col("pos") % 4 != 2))


@query("""WITH RECURSIVE tot AS (SELECT doc_id, sum(length(text)) + count(*) - 1 AS t FROM ch GROUP BY doc_id),
    e AS (SELECT *, row_number() OVER (PARTITION BY document_id, lower(name), type ORDER BY pos) AS n FROM el)
    SELECT e.document_id, e.pos, e.id FROM e JOIN tot USING (doc_id) WHERE t <= 100000 OR n = 1""")
def merge_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analysis.merge_segments(els(spark, sf_dir), rels(spark, sf_dir), corpus.stored(spark, sf_dir, "chunks"))
    return out.elements.select("document_id", "pos", "id")

