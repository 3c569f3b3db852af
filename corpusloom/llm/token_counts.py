"""Token counts by the whole-token shortcut.

Which vocabulary strings are one token when they stand alone as a pre-token is proved once, by encoding each of them. A
pre-token among those counts one; only the others go through the merges of the tokenizer library, each distinct one once
per task as far as a bounded memory reaches. A text with characters for which the fast pre-token split is not proved goes
to the library whole. One pass, no shuffle.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import col, map_slices
from corpusloom.llm.tokens import Counter


def token_counts(docs: DataFrame, text: str = "text", **keep: Column) -> DataFrame:
    """`keep` columns with n_bytes (UTF-8) and n_tokens for every row; a null text counts as empty, with no tokens."""
    source = docs.select(*[v.alias(k) for k, v in keep.items()], col(text).cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "text")
    state: list[Counter] = []

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state.append(Counter())
        texts = part.column(part.num_columns - 1)
        sizes = pc.binary_length(texts).fill_null(0).cast(pa.int64())
        counts = pa.array(state[0].count(texts.to_pylist()), pa.int64())
        return pa.RecordBatch.from_arrays(
            [*part.columns[:-1], sizes, counts], names=[*part.schema.names[:-1], "n_bytes", "n_tokens"]
        )

    counted = map_slices(source, work, f"{schema}, n_bytes bigint, n_tokens bigint")
    return counted


def over_limit(limit: int) -> Column:
    return F.col("n_tokens") > limit
