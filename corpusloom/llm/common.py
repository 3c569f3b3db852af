"""Small helpers shared by the training-data operators.

Every operator nests the caller's row in one struct, so that columns of any name pass through without a clash, and
recognises a text by a 128-bit digest instead of its id: ids may be null or repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import materialize

# Rows that a task holds as Python objects at a time.
SLICE_ROWS = 256
SLICE_CHARS = 4_000_000


def col(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def nested(df: DataFrame, **keys: Column) -> DataFrame:
    """`row` holds the whole input row; `keys` are computed beside it."""
    row = F.struct(*[col(c) for c in df.columns]).alias("row")
    return df.select(row, *[value.alias(name) for name, value in keys.items()])


def unnested(df: DataFrame, columns: list[str], **changed: str) -> DataFrame:
    """The caller's columns again; `changed` maps a column name to the outer column that replaces it."""
    field = lambda c: F.col("row").getField(c)
    return df.select(*[(F.col(changed[c]) if c in changed else field(c)).alias(c) for c in columns])


def digest(text: Column) -> Column:
    """128 bits that stand for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the folder all executors share, and read back."""
    return materialize(df, f"llm-{name}")


def stored_tidily(df: DataFrame, name: str) -> DataFrame:
    """`stored`, where the job's shuffles are removed as it ends and not when the driver next collects garbage."""
    key, conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", df.sparkSession.conf
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return stored(df, name)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def discard(*tables: DataFrame | None) -> None:
    """Delete stored tables that nothing reads any more; what was made from them must be stored."""
    for table in tables:
        files = table.inputFiles() if table is not None else []
        if files:
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 5, is 0. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def total(spark: SparkSession, df: DataFrame, value: Column) -> int:
    """One number: the sum of `value` over all rows."""
    return int(df.select(F.sum(value).alias("n")).first()["n"] or 0)


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch so that the texts of one slice stay within a few megabytes (one longer text makes a slice)."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = pc.binary_length(column).fill_null(0).to_pylist()
    start = used = 0
    for i, size in enumerate(sizes):
        if i > start and (used + size > SLICE_CHARS or i - start >= SLICE_ROWS):
            yield batch.slice(start, i - start)
            start, used = i, 0
        used += size
    if start < len(sizes):
        yield batch.slice(start)


def map_slices(
    df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text"
) -> DataFrame:
    """Run `work` on every slice of a table inside the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                done = work(part)
                if done is not None and done.num_rows:
                    yield done

    return df.mapInArrow(run, schema)
