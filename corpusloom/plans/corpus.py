"""The library's tables derived from raw text tables, so that every operator can run on a plain corpus.

Headings are inserted at fixed lines, one element per chunk is quoted from the text with planted defects, edges link
neighbouring elements, and replies, sessions and questions are assembled from those. All derivations are whole-table
expressions.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.model import DOCUMENT_TYPES, ELEMENT_TYPES
from corpusloom.operators.segment import chunk_markdown
from corpusloom.session import materialize

AS_OF = "2024-06-01 00:00:00"


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("document_id", F.col("doc_id").cast("string"))


def markdown_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`## ` in front of every non-blank line whose index is 1 modulo 4."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.when((i % 4 == 1) & (F.trim(line) != ""), F.concat(F.lit("## "), line)).otherwise(line),
    )
    return raw_documents(spark, sf_dir).select(
        "document_id", "doc_id", "source", F.array_join(lines, "\n").alias("text")
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_markdown(markdown_documents(spark, sf_dir))


def _keyed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = markdown_documents(spark, sf_dir)
    last = chunk_markdown(docs, keep=("doc_id",))
    return last.withColumn("ord", F.col("order").cast("long"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One element per chunk; evidence is exact, misplaced, garbled, reversed or empty by position."""
    ord_, doc = F.col("ord"), F.col("doc_id")
    quote = F.substring("text", 5, 60)
    evidence = (
        F.when((doc + ord_) % 13 == 0, "")
        .when((doc + ord_) % 7 == 0, F.reverse(quote))
        .when(
            (doc + ord_) % 5 == 0,
            F.concat(F.substring(quote, 1, 30), F.lit("#"), F.substring(quote, 32, 60)),
        )
        .otherwise(quote)
    )
    cited = F.format_string("chunk-%03d", F.when((doc + ord_) % 11 == 0, ord_ + 1).otherwise(ord_).cast("int"))
    return _keyed_chunks(spark, sf_dir).select(
        "document_id",
        F.col("ord").alias("pos"),
        element_id(ord_).alias("id"),
        _pick(ELEMENT_TYPES, ord_ % 6).alias("type"),
        F.substring("text", 1, 24).alias("name"),
        F.substring("text", 1, 200).alias("content"),
        F.struct(
            cited.alias("chunk_id"),
            F.lit(None).cast("int").alias("page"),
            F.lit(None).cast("string").alias("section"),
            evidence.alias("evidence"),
        ).alias("source_ref"),
        F.lit(False).alias("verified"),
    )


def element_id(ord_: Column) -> Column:
    return F.format_string("elem-%03d", (ord_ + 1).cast("int"))


def flagged_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements whose `verified` follows position instead of a check: false at every third."""
    return stored(spark, sf_dir, "elements").withColumn("verified", (F.col("document_id").cast("long") + F.col("pos")) % 3 != 0)


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges to the next element (the last one dangles), to the first one or a missing one, and some back again."""
    ord_, doc = F.col("pos"), F.col("document_id").cast("long")
    edge = lambda pos, target, kind, text: F.struct(
        F.lit(pos).alias("pos"), target.alias("target_id"), kind.alias("type"), text.alias("description")
    )
    none = F.lit(None).cast("string")
    onward = edge(
        0,
        element_id(ord_ + 1),
        _pick(["contradicts", "depends_on", "constrains"], ord_ % 3),
        F.when(ord_ % 2 == 0, F.concat(F.lit("edge of "), F.col("id"))),
    )
    home = edge(1, F.when(doc % 4 == 0, "elem-999999").otherwise("elem-001"), F.lit("participates_in"), none)
    back = edge(2, element_id(ord_ - 1), F.lit("contradicts"), none)
    edges = F.concat(
        F.array(onward),
        F.when(ord_ % 2 == 1, F.array(home)).otherwise(F.array().cast(_EDGES)),
        F.when(ord_ % 6 == 1, F.array(back)).otherwise(F.array().cast(_EDGES)),
    )
    return (
        stored(spark, sf_dir, "elements")
        .select("document_id", "pos", "id", F.explode(edges).alias("edge"))
        .select(
            "document_id",
            F.col("pos").alias("element_pos"),
            "edge.pos",
            F.col("id").alias("source_id"),
            "edge.target_id",
            "edge.type",
            "edge.description",
        )
    )


_EDGES = "array<struct<pos:int,target_id:string,type:string,description:string>>"


def document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_documents(spark, sf_dir).select(
        "document_id", _pick(DOCUMENT_TYPES, F.col("doc_id") % 4).alias("document_type")
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns, each put to one document (ids run from 0)."""
    total = table(spark, sf_dir, "documents").agg(F.count("*").alias("_docs"))
    turns = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return turns.join(F.broadcast(total)).select(
        F.concat_ws("-", "conv_id", "turn").alias("question_id"),
        (F.col("conv_id") % F.col("_docs")).cast("string").alias("document_id"),
        F.col("text").alias("question"),
        F.col("conv_id"),
        F.col("turn"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score per (question, element of its document), with zeros and ties."""
    q = questions(spark, sf_dir)
    e = stored(spark, sf_dir, "elements").select("document_id", "id", "pos")
    value = (F.col("document_id").cast("long") * 7 + F.col("pos") * 3 + F.col("conv_id") + F.col("turn")) % 11
    return q.join(e, "document_id").select("question_id", "document_id", "pos", "id", value.cast("int").alias("score"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as named files; some too long, some of a rejected kind, some without suffix."""
    docs = raw_documents(spark, sf_dir)
    ending = _pick([".md", ".txt", ".pdf", ".docx", ""], F.col("doc_id") % 5)
    return docs.select(
        "document_id",
        F.concat(F.lit("doc-"), "document_id", ending).alias("filename"),
        (F.col("n_chars") * F.when(F.col("doc_id") % 10 == 0, 2000).otherwise(1)).cast("long").alias("length"),
        F.col("text").cast("binary").alias("content"),
        "doc_id",
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text as pages: three lines to a page, blank lines between the lines."""
    lines = F.split("text", "\n")
    count = F.ceil(F.size(lines) / 3).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice(lines, i * 3 + 1, 3), "\n\n")
    )
    return raw_documents(spark, sf_dir).select("document_id", F.posexplode(cut).alias("_p", "text")).select(
        "document_id", (F.col("_p") + 1).alias("page"), "text"
    )


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click events read as session events: the user is the document, the event kind the status."""
    return as_session_events(table(spark, sf_dir, "events"))


def as_session_events(events: DataFrame) -> DataFrame:
    kinds = {
        "signup": ("analysis", "inferring_type"),
        "view": ("analysis", "awaiting_confirmation"),
        "click": ("analysis", "extracting"),
        "purchase": ("analysis", "completed"),
        "error": ("quality", "analyzing"),
    }
    track, status = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, (t, s) in kinds.items():
        track = F.when(F.col("event_type") == kind, t).otherwise(track)
        status = F.when(F.col("event_type") == kind, s).otherwise(status)
    quality = F.col("event_type") == "error"
    later = _pick(["analyzing", "analyzing_contradictions", "completed", "failed"], F.col("event_id") % 4)
    return events.select(
        F.col("user_id").cast("string").alias("document_id"),
        track.alias("track"),
        F.col("event_id").alias("seq"),
        "ts",
        F.when(quality, later).otherwise(status).alias("status"),
        F.col("props").alias("payload"),
    )


def _reply(rows: DataFrame, step: str, body: Column, broken: Column, fenced: Column | None = None, question: str | None = None) -> DataFrame:
    text = body if fenced is None else F.when(fenced, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return rows.select(
        "document_id",
        F.lit(step).alias("step"),
        F.lit(0).alias("segment"),
        (F.lit(None) if question is None else F.col(question)).cast("string").alias("question_id"),
        F.lit(1).alias("attempt"),
        F.lit("v1").alias("prompt_version"),
        F.when(broken, F.concat(text, F.lit(" and more"))).otherwise(text).alias("content"),
        F.lit("model-a").alias("model_id"),
        F.lit(None).cast("string").alias("error"),
    )


def _gathered(rows: DataFrame, keys: list[str], item: Column) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("item")))), lambda r: r["item"])
    return rows.groupBy(*keys).agg(listed.alias("items"))


def _ref() -> Column:
    return F.struct("source_ref.chunk_id", "source_ref.evidence")


def _extraction_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    els = stored(spark, sf_dir, "elements")
    edges = stored(spark, sf_dir, "relations").groupBy("document_id", F.col("element_pos").alias("pos")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col("pos").alias("n"), "target_id", "type", "description"))),
            lambda r: F.struct(r["target_id"], r["type"], r["description"]),
        ).alias("relations")
    )
    full = F.struct(
        "id",
        F.when(F.col("pos") % 10 == 9, "mystery").otherwise(F.col("type")).alias("type"),
        "name",
        "content",
        _ref().alias("source_ref"),
        "relations",
    )
    rows = _gathered(els.join(edges, ["document_id", "pos"], "left"), ["document_id"], full)
    return _reply(rows, "extraction", _wrap("elements"), _odd(17, 5), _odd(9, 4))


def _contradiction_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    clash = F.struct(
        F.lit("contradiction").alias("type"),
        F.when(_odd(13, 3), F.repeat(F.lit("x"), 501)).otherwise(F.concat(F.lit("model: "), "name")).alias("description"),
        _severity().otherwise("odd").alias("severity"),
        F.array("id").alias("affected_element_ids"),
        F.array(_ref(), _ref()).alias("source_refs"),
    )
    els = stored(spark, sf_dir, "elements").where(F.col("pos") % 5 == 0)
    return _reply(_gathered(els, ["document_id"], clash), "contradiction", _wrap("findings"), _odd(17, 5))


def _ambiguity_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    vague = F.struct(
        F.concat(F.lit("amb-"), F.col("pos").cast("string")).alias("id"),
        F.lit("vague").alias("category"),
        F.concat(F.lit("unclear: "), "name").alias("description"),
        F.when(_odd(13, 6), "odd").otherwise(_severity().otherwise("low")).alias("severity"),
        F.array("id").alias("affected_element_ids"),
        _ref().alias("source_ref"),
    )
    els = stored(spark, sf_dir, "elements").where(F.col("pos") % 4 == 0)
    return _reply(_gathered(els, ["document_id"], vague), "ambiguity", _wrap("ambiguities"), _odd(17, 5), _odd(9, 4))


def _completeness_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    partly = F.struct(
        F.col("name").alias("expected_element_name"),
        F.when(F.col("pos") % 2 == 0, "Partial").otherwise("complete").alias("classification"),
        _severity().otherwise("odd").alias("severity"),
    )
    els = stored(spark, sf_dir, "elements").where(F.col("pos") < 3)
    return _reply(_gathered(els, ["document_id"], partly), "completeness", _wrap("assessments"), _odd(17, 5))


def _suggestion_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.col("pos")
    advice = F.struct(
        F.concat(F.lit("sug-"), pos.cast("string")).alias("id"),
        F.concat(F.lit("look at "), "name").alias("description"),
        F.when(pos % 3 == 0, "high").when(pos % 3 == 1, "low").alias("priority"),
        F.array(F.concat(F.lit("amb-"), pos.cast("string"))).alias("related_finding_ids"),
        F.when(pos % 4 == 0, F.array(_ref())).alias("source_refs"),
    )
    els = stored(spark, sf_dir, "elements").where(pos % 2 == 0)
    return _reply(_gathered(els, ["document_id"], advice), "suggestion", _wrap("suggestions"), _odd(17, 5), _odd(9, 4))


def _type_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.to_json(
        F.struct(
            F.when(_odd(10, 7), "memo").otherwise(F.col("document_type")).alias("document_type"),
            F.when(F.col("document_id").cast("long") % 3 != 0, "by its words").alias("justification"),
        )
    )
    return _reply(document_types(spark, sf_dir), "type", kind, _odd(17, 5))


def _scoring_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = stored(spark, sf_dir, "questions").select("question_id", "document_id", "conv_id", "turn")
    marks = stored(spark, sf_dir, "scores").withColumn("score", F.col("score") * 2 - 4)
    marks = _gathered(marks, ["question_id", "document_id"], F.struct("id", "score")).join(q, ["question_id", "document_id"])
    broken, fenced = F.col("conv_id") % 17 == 5, F.col("conv_id") % 9 == 4
    return _reply(marks, "scoring", F.to_json("items"), broken, fenced, "question_id")


def _answer_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    els = stored(spark, sf_dir, "elements")
    q = stored(spark, sf_dir, "questions").select("question_id", "document_id", "conv_id", "turn")
    quoted = _gathered(q.join(els, "document_id"), ["question_id", "document_id", "conv_id", "turn"], _ref())
    said = F.to_json(
        F.struct(
            F.concat(F.lit("From "), F.size("items").cast("string"), F.lit(" parts.")).alias("answer"),
            F.lit(True).alias("answerable"),
            F.col("items").alias("source_refs"),
        )
    )
    spoken = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("Here: "), said, F.lit(" Done."))).otherwise(said)
    return _reply(quoted, "answer", spoken, F.lit(False), F.col("conv_id") % 9 == 4, "question_id")


def _odd(n: int, rest: int) -> Column:
    return F.col("document_id").cast("long") % n == rest


def _severity() -> Column:
    return F.when(F.col("pos") % 3 == 0, "high").when(F.col("pos") % 3 == 1, "medium")


def _wrap(name: str) -> Column:
    return F.to_json(F.struct(F.col("items").alias(name)))


REPLIES = {
    "type": _type_replies,
    "extraction": _extraction_replies,
    "contradiction": _contradiction_replies,
    "ambiguity": _ambiguity_replies,
    "completeness": _completeness_replies,
    "suggestion": _suggestion_replies,
    "scoring": _scoring_replies,
    "answer": _answer_replies,
}


def responses(spark: SparkSession, sf_dir: str, steps: Iterable[str] = tuple(REPLIES)) -> DataFrame:
    """Replies of the given steps, built from the derived elements; some fenced, some broken, some with bad items.

    Each step's replies are stored by themselves, so that a query that reads some steps does not build the others.
    """
    out = None
    for step in steps:
        part = stored(spark, sf_dir, f"replies-{step}")
        out = part if out is None else out.unionByName(part)
    return out


_stored: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, written once per session to the shared folder and laid out by document."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        step = name.removeprefix("replies-")
        built = (globals()[name] if step == name else REPLIES[step])(spark, sf_dir)
        _stored[key] = materialize(built.hint("rebalance", "document_id"), f"corpus-{name}", tidy=True)
    return _stored[key]
