"""Line dedup: windows of three lines that occur again anywhere in the corpus lose their later occurrences.

Only DataFrame functions. A window is three consecutive non-blank lines, compared without surrounding spaces by a
128-bit hash. Documents are ordered by id (null last), then by text digest; the first occurrence of a window stays and
every later one is covered. Covered windows of a document are merged into spans of lines, and the spans (blank lines
between them included) are cut out. A window that overlaps its own first occurrence only covers the lines behind it.

Scale: a window with one occurrence never leaves the counting shuffle; the table of repeated windows is written once and
joined as a plain equi-join, whose hot keys adaptive execution can split. A document's text moves once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import col, digest, nested, stored, unnested

RUN = 3


def _lines(text: Column) -> Column:
    """Non-blank lines with their index among all lines."""
    coded = F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(i.alias("at"), F.trim(line).alias("line")))
    return F.filter(coded, lambda x: x["line"] != "")


def _windows(docs: DataFrame, run: int) -> DataFrame:
    """One row per window: owner, order of the owner, hash, first and last line."""
    lines = docs.withColumn("lines", _lines(F.col("text"))).where(F.size("lines") >= run)

    def window(i: Column) -> Column:
        part = [F.col("lines")[i + k] for k in range(run)]
        texts = [p["line"] for p in part]
        return F.struct(
            F.xxhash64(*texts).alias("h1"),
            F.xxhash64(F.lit(run), *texts).alias("h2"),
            part[0]["at"].alias("first"),
            part[-1]["at"].alias("last"),
        )

    spots = F.transform(F.sequence(F.lit(0), F.size("lines") - run), window)
    return lines.select("late", "id", "key", F.inline(spots))


def covered_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", run: int = RUN) -> DataFrame:
    """(key, id, late, spans): the line spans to cut from each document that has any, ascending and disjoint."""
    source = docs.select(
        col(text).cast("string").alias("text"),
        col(doc_id).isNull().alias("late"),
        col(doc_id).alias("id"),
        digest(col(text)).alias("key"),
    )
    place = F.struct("late", "id", "key", "first", "last")
    repeated = (
        _windows(source, run)
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.min(place).alias("origin"))
        .where("n > 1")
        .select("h1", "h2", "origin")
    )
    repeated = stored(repeated, "windows")
    o = F.col("origin")
    same = o["id"].eqNullSafe(F.col("id")) & (o["key"] == F.col("key"))
    later = (
        _windows(source, run)
        .join(repeated, ["h1", "h2"])
        .select(
            "key",
            "id",
            "late",
            F.when(same, F.greatest(F.col("first"), o["last"] + 1)).otherwise(F.col("first")).alias("first"),
            "last",
            (same & (o["first"] == F.col("first"))).alias("is_origin"),
        )
        .where(~F.col("is_origin") & (F.col("first") <= F.col("last")))
    )
    owner = ["key", "id", "late"]
    before = Window.partitionBy(*owner).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*owner).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, 0)
    return (
        later.withColumn("reach", F.max("last").over(before))
        .withColumn("opens", F.when(F.col("first") <= F.col("reach") + 1, 0).otherwise(1))
        .withColumn("span", F.sum("opens").over(upto))
        .groupBy(*owner, "span")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .groupBy(*owner)
        .agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"))
    )


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", run: int = RUN) -> DataFrame:
    """Input rows as `row`, with `text` (what stays), `n_lines` and `n_removed`.

    A null text stays null with no lines; an empty text has one line. A document of fewer than three non-blank lines is
    left alone. Equal rows are one document: all keep what one of them keeps. A text whose lines all go is empty.
    """
    spans = covered_spans(docs, text, doc_id, run)
    base = nested(docs, key=digest(col(text)), id=col(doc_id), late=col(doc_id).isNull())
    filler = F.coalesce(F.col("id").cast("string"), F.lit(""))
    joined = base.withColumn("same_id", filler).join(
        spans.select(F.col("key"), F.col("late"), filler.alias("same_id"), "spans"), ["key", "late", "same_id"], "left"
    )
    lines = F.split(F.col("row").getField(text).cast("string"), "\n", -1)
    count = F.size("spans")

    def gap(j: Column) -> Column:
        start = F.when(j == 0, 0).otherwise(F.get("spans", j - 1)["last"] + 1)
        end = F.when(j == count, F.size("lines")).otherwise(F.get("spans", j)["first"])
        return F.slice("lines", start + 1, end - start)

    def span_lines(s: Column) -> Column:
        return s["last"] - s["first"] + 1

    removed = F.aggregate("spans", F.lit(0), lambda acc, s: acc + span_lines(s))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), count), gap))
    return joined.withColumn("lines", lines).select(
        "row",
        F.when(F.col("spans").isNull(), F.col("row").getField(text).cast("string"))
        .otherwise(F.array_join(kept, "\n"))
        .alias("text"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
    )


def drop_repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", chars: str = "n_chars") -> DataFrame:
    """The pipeline's form: the same columns with the shorter text and its length; documents emptied by it go."""
    done = line_dedup(docs, text, doc_id).where("n_removed = 0 OR length(trim(text)) > 0")
    changed = {text: "text"}
    if chars in docs.columns:
        kind = docs.schema[chars].dataType
        size = F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("row").getField(chars))
        done, changed = done.withColumn("size", size), changed | {chars: "size"}
    return unnested(done, docs.columns, **changed)
