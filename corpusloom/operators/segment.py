"""Cutting documents into ordered chunks, and views over the chunks of a document.

Markdown and plain text are cut inside the document's own row (array functions, then `posexplode`): no shuffle, and the
chunk number is the array position. Only paged input needs to number across rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import SPACE, chunk_id, strip, truncate
from corpusloom.model import LANGUAGE_SAMPLE_CHARS, MAX_PAGE_CHARS, SEGMENT_CHARS, TYPE_SAMPLE_CHARS
from corpusloom.operators.prefix import running_total

# Cut mark put into the text before splitting; holds a Unicode non-character, so it does not occur in text.
CUT = "\x00\ufffe\x00"

# --- Fixed values -------------------------------------------------------------------------------------------------

HEADING = rf"(?dmU)^(#{{1,2}}){SPACE}+(.+)$"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
UNDERLINE = rf"(?U)\A{SPACE}*(={{3,}}|-{{3,}}){SPACE}*\z"
PREAMBLE = "(preamble)"
WHOLE_DOCUMENT = "(document)"


def _chunk_rows(docs: DataFrame, pieces: Column, keep: tuple[str, ...]) -> DataFrame:
    """One row per STRUCT<text, section> piece; blank pieces take no number."""
    full = F.filter(pieces, lambda p: p.text != "")
    rows = docs.select("document_id", *keep, F.posexplode(full).alias("order", "piece"))
    return rows.select(
        "document_id",
        chunk_id("order").alias("chunk_id"),
        F.col("piece.text").alias("text"),
        F.struct(F.lit(None).cast("int").alias("page"), F.col("piece.section").alias("section")).alias(
            "structural_context"
        ),
        "order",
        *keep,
    )


def chunk_markdown(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cut `docs(document_id, text)` at first and second level headings."""
    marked = F.regexp_replace("text", F.lit(HEADING), F.lit(CUT + "$0"))
    pieces = F.transform(
        F.split(marked, CUT),
        lambda p, i: F.struct(
            strip(p).alias("text"),
            F.when(i == 0, PREAMBLE).otherwise(F.regexp_extract(p, HEADING, 0)).alias("section"),
        ),
    )
    return _chunk_rows(docs, pieces, keep)


def _all_caps(line: Column) -> Column:
    """At least two letters, none of them anything but upper case."""
    return line.rlike(r"\p{L}[^\p{L}]*\p{L}") & ~line.rlike(r"[\p{L}&&[^\p{IsUppercase}]]")


def chunk_plaintext(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cut `docs(document_id, text)` at underlined and all-capitals heading lines.

    Each line gets a letter: `u` could be an underlined heading, `c` all capitals, `t` other. Reading the letters from
    left to right, `u` consumes the line after it, so one pattern replacement settles runs of underlines.
    """
    lines = F.split(F.regexp_replace("text", F.lit(LINE_END), F.lit("$0" + CUT)), CUT)
    staged = docs.select("document_id", *keep, lines.alias("_lines"))
    underlined = F.transform("_lines", lambda line: line.rlike(UNDERLINE))
    staged = staged.withColumn("_under", underlined)
    letters = F.transform(
        "_lines",
        lambda line, i: F.when(
            (strip(line) != "") & F.coalesce(F.get("_under", i + 1), F.lit(False)), "u"
        )
        .when(_all_caps(line), "c")
        .otherwise("t"),
    )
    roles = F.split(F.regexp_replace(F.array_join(letters, ""), F.lit("u."), F.lit("hs")), "")
    parts = F.zip_with(
        "_lines",
        roles,
        lambda line, role: F.when(role.isin("h", "c"), F.concat(F.lit(CUT), line)).when(role == "s", "").otherwise(line),
    )
    pieces = F.transform(
        F.split(F.array_join(parts, ""), CUT),
        lambda p, i: F.struct(
            strip(p).alias("text"),
            F.when(i == 0, WHOLE_DOCUMENT)
            .otherwise(strip(F.element_at(F.split(p, LINE_END, 2), 1)))
            .alias("section"),
        ),
    )
    return _chunk_rows(staged, pieces, keep)


def pack_paragraphs(text: Column, limit: int = MAX_PAGE_CHARS) -> Column:
    """Blank-line separated paragraphs packed greedily while the joined length stays within `limit`."""
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, p: Column) -> Column:
        joined = F.when(acc.open == "", p).otherwise(F.concat(acc.open, F.lit("\n\n"), p))
        flush = (F.length(joined) > limit) & (acc.open != "")
        return F.struct(
            F.when(flush, F.concat(acc.done, F.array(acc.open))).otherwise(acc.done).alias("done"),
            F.when(flush, p).otherwise(joined).alias("open"),
        )

    return F.aggregate(
        paragraphs,
        start,
        step,
        lambda acc: F.when(acc.open == "", acc.done).otherwise(F.concat(acc.done, F.array(acc.open))),
    )


def chunk_pages(pages: DataFrame, limit: int = MAX_PAGE_CHARS) -> DataFrame:
    """Cut `pages(document_id, page, text)` (page from 1): one chunk per page, long pages packed by paragraph."""
    text = strip("text")
    pieces = (
        F.when(text == "", F.array().cast("array<string>"))
        .when(F.length(text) > limit, pack_paragraphs(text, limit))
        .otherwise(F.array(text))
    )
    counted = running_total(
        pages.select("document_id", "page", pieces.alias("_pieces")),
        ["document_id"],
        "page",
        F.size("_pieces"),
        "_before",
    )
    rows = counted.select("document_id", "page", "_before", F.posexplode("_pieces").alias("_i", "text"))
    order = (F.col("_before") + F.col("_i")).cast("int")
    return rows.select(
        "document_id",
        chunk_id(order).alias("chunk_id"),
        "text",
        F.struct("page", F.lit(None).cast("string").alias("section")).alias("structural_context"),
        order.alias("order"),
    )


def scanned_documents(pages: DataFrame, below: int) -> DataFrame:
    """Documents that have pages but fewer than `below` characters of page text in all."""
    return (
        pages.groupBy("document_id")
        .agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("pages"))
        .select("document_id", "pages", "chars", (F.col("chars") < below).alias("scanned"))
    )


def _ordered_texts(chunks: DataFrame, text: Column) -> Column:
    return F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("order"), text.alias("text")))), lambda c: c.text
    )


def full_text(chunks: DataFrame) -> DataFrame:
    """All chunk texts of a document in order, joined by newline (one document, at most the accepted file size)."""
    return chunks.groupBy("document_id").agg(F.array_join(_ordered_texts(chunks, F.col("text")), "\n").alias("text"))


def language_sample(chunks: DataFrame) -> DataFrame:
    """First 1000 characters of the chunk texts joined by a space.

    A chunk adds at least its separator, so chunks past that many can not matter and are left out before the shuffle.
    """
    n = LANGUAGE_SAMPLE_CHARS
    head = chunks.where(F.col("order") <= n).withColumn("text", truncate("text", n))
    joined = F.array_join(_ordered_texts(head, F.col("text")), " ")
    return head.groupBy("document_id").agg(truncate(joined, n).alias("sample"))


def type_sample(chunks: DataFrame) -> DataFrame:
    """Chunk texts in order until their pieces hold 2000 characters, joined by newline.

    Chunks are never blank, so only the first 2000 of a document can contribute.
    """
    n = TYPE_SAMPLE_CHARS
    head = chunks.where(F.col("order") < n).withColumn("text", truncate("text", n))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, t: Column) -> Column:
        piece = F.substring(t, F.lit(1), F.lit(n) - acc.used)
        return F.when(acc.used >= n, acc).otherwise(
            F.struct(
                (acc.used + F.length(piece)).alias("used"), F.concat(acc.parts, F.array(piece)).alias("parts")
            )
        )

    taken = F.aggregate(_ordered_texts(head, F.col("text")), start, step, lambda acc: F.array_join(acc.parts, "\n"))
    return head.groupBy("document_id").agg(taken.alias("sample"))


def long_documents(chunks: DataFrame, limit: int = SEGMENT_CHARS) -> DataFrame:
    """Ids of documents whose joined text is longer than `limit`, from chunk lengths only."""
    joined = F.sum(F.length("text")) + F.count("*") - 1
    return chunks.groupBy("document_id").agg(joined.alias("_total")).where(F.col("_total") > limit).select("document_id")


def segment_chunks(chunks: DataFrame, limit: int = SEGMENT_CHARS) -> DataFrame:
    """Add `segment`: 0 while the joined text fits `limit`, else whole chunks packed greedily in order.

    The packing runs on chunk lengths alone; texts are only touched by the join that hands the segment starts back.
    """
    sizes = chunks.select("document_id", "order", F.length("text").alias("len"))
    packed = (
        sizes.groupBy("document_id")
        .agg(
            (F.sum("len") + F.count("*") - 1).alias("_total"),
            F.array_sort(F.collect_list(F.struct("order", "len"))).alias("_sizes"),
        )
        .where(F.col("_total") > limit)
    )
    start = F.struct(F.lit(0).cast("long").alias("size"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, c: Column) -> Column:
        cut = (acc.size > 0) & (acc.size + c.len > limit)
        return F.struct(
            F.when(cut, c.len).otherwise(acc.size + c.len).cast("long").alias("size"),
            F.when(cut, F.concat(acc.starts, F.array(c.order))).otherwise(acc.starts).alias("starts"),
        )

    starts = packed.select("document_id", F.aggregate("_sizes", start, step, lambda acc: acc.starts).alias("_starts"))
    # dealt as prompts deal them, so that a plan with both shuffles the texts once
    return (
        chunks.repartition("document_id").join(starts, "document_id", "left")
        .withColumn(
            "segment",
            F.coalesce(F.size(F.filter("_starts", lambda s: s <= F.col("order"))), F.lit(0)),
        )
        .withColumn("segment", F.greatest(F.col("segment"), F.lit(0)))
        .drop("_starts")
    )


def context_list() -> Column:
    """Aggregate: ordered list of {chunk_id, page, section}."""
    entry = F.struct(
        F.col("order"),
        F.col("chunk_id"),
        F.col("structural_context.page").alias("page"),
        F.col("structural_context.section").alias("section"),
    )
    return F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e.chunk_id, e.page, e.section))


def structural_contexts(chunks: DataFrame, by: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """Ordered list of {chunk_id, page, section} per document."""
    return chunks.groupBy(*by).agg(context_list().alias("contexts"))
