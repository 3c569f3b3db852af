"""Files as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from corpusloom.model import MAX_PDF_BYTES


def with_names(files: DataFrame) -> DataFrame:
    """Add `filename` (last path part, `unnamed` when empty) and `document_id`, a full digest of path and content.

    Of a file whose content was left out for its size, length and time take the content's place.
    """
    name = F.regexp_extract("path", r"[^/]+\z", 0)
    named = files.withColumn("filename", F.when(name == "", "unnamed").otherwise(name))
    content_key = F.coalesce(F.sha2("content", 256), F.concat_ws("/", "length", F.unix_micros("modificationTime").cast("string")))
    return named.withColumn("document_id", F.concat(F.lit("doc-"), F.sha2(F.concat_ws("\x1f", "path", content_key), 256)))


def load_files(reader: DataFrameReader | DataStreamReader, path: str) -> DataFrame:
    """Files with their content; files over the largest accepted size are listed without it, so it is never read."""
    small = reader.load(path).where(F.col("length") <= MAX_PDF_BYTES)
    large = reader.load(path).where(F.col("length") > MAX_PDF_BYTES)
    bare = large.select("path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"))
    return small.select(*bare.columns).unionByName(bare)


def scan_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """All files under `path` (recursively), one row each."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return with_names(load_files(reader, path))
