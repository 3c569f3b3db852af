"""Running values over an ordered key, in two levels.

A plain window over a key sends all rows of that key to one task. Here rows are first cut into blocks along the order; a
task sees one block of one key, and only one row per block takes part in the pass over the whole key.

`running_total` cuts blocks of an order that counts (pages, positions). `previous_value` takes any order, dense or not:
its blocks are ranges of equal size, which a sample of the rows decides. So these are written once, to be the same for
every reader.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.session import materialize

Settle = Callable[[DataFrame], DataFrame]

BLOCK = 4096


def _with_block(df: DataFrame, order: str, block: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(order) / F.lit(block)).cast("long"))


def running_total(df: DataFrame, keys: list[str], order: str, value: Column, out: str, block: int = BLOCK) -> DataFrame:
    """Add `out` = sum of `value` over earlier rows of the key (exclusive); `order` is an integer column."""
    rows = _with_block(df.withColumn("_value", value.cast("long")), order, block)
    blocks = rows.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(*keys, "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .join(offsets, [*keys, "_block"])
        .withColumn(out, F.col("_offset") + F.col("_inside"))
        .drop("_value", "_block", "_offset", "_inside")
    )


def ranged(df: DataFrame, keys: list[str], order: str, settle: Settle | None = None) -> DataFrame:
    """Rows with `_block`, the number of their range of (keys, order); ranges are of about equal size, whatever the keys."""
    cut = df.repartitionByRange(*keys, order).withColumn("_block", F.spark_partition_id())
    return materialize(cut, "ranges") if settle is None else settle(cut)


def previous_value(
    df: DataFrame, keys: list[str], order: str, value: str, out: str, settle: Settle | None = None
) -> DataFrame:
    """Add `out` = `value` of the preceding row of the key, null for the first."""
    rows = ranged(df, keys, order, settle)
    lasts = rows.groupBy(*keys, "_block").agg(F.max_by(value, order).alias("_last"))
    carried = lasts.select(
        *keys, "_block", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block")).alias("_carried")
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    return (
        rows.withColumn("_first", F.row_number().over(inside) == 1)
        .withColumn("_prev", F.lag(value).over(inside))
        .join(carried, [*keys, "_block"])
        .withColumn(out, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_prev")))
        .drop("_block", "_first", "_prev", "_carried")
    )
