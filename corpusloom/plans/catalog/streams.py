"""Streaming queries, run over the tables as a stream until all input is taken."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from corpusloom.plans import corpus
from corpusloom.plans.catalog.registry import query
from corpusloom.session import shared_dir
from corpusloom.streaming import arrivals, sessions


def _dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's file read as a stream."""
    schema = corpus.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run to the end of the input; updates are kept per batch in a folder that a replayed batch overwrites."""
    spark = stream.sparkSession
    out = _dir(spark, "updates")
    write = lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
    run = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", _dir(spark, "progress"))
    run.trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(out)


def _last(updates: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.as_session_events(table_stream(spark, sf_dir, "events"))


@query("""SELECT document_id, track, max(seq) AS seq, max_by(status, seq) AS status, count(*) AS events FROM se GROUP BY document_id, track""")
def stream_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _last(drain(sessions.state_stream(_events(spark, sf_dir)), "update"), ["document_id", "track"])


def _arrivals(spark: SparkSession, rows: DataFrame, part: Column, parts: int, run: Callable[[DataFrame], StreamingQuery]) -> None:
    """Rows written in `parts` goes, the stream run to its end after each: every go is a micro-batch of its own."""
    path = _dir(spark, "arrivals")
    for i in range(parts):
        rows.where(part == i).write.mode("append").parquet(path)
        run(spark.readStream.schema(rows.schema).parquet(path)).awaitTermination()


@query("""WITH p AS (SELECT *, lag(status) OVER (PARTITION BY document_id, track ORDER BY seq) AS prev FROM se),
    l AS (SELECT *, coalesce(CASE WHEN track = 'analysis' THEN CASE status WHEN 'inferring_type' THEN prev IS NULL
    WHEN 'awaiting_confirmation' THEN prev = 'inferring_type' WHEN 'extracting' THEN prev = 'awaiting_confirmation' WHEN 'completed' THEN prev = 'verifying' END
    ELSE CASE status WHEN 'analyzing' THEN prev IS NULL OR prev IN ('completed', 'failed') WHEN 'analyzing_contradictions' THEN prev = 'analyzing'
    WHEN 'completed' THEN prev = 'generating_suggestions' WHEN 'failed' THEN prev LIKE 'analyzing%' END END, false) AS legal FROM p)
    SELECT document_id, track, max(seq) AS seq, max_by(status, seq) AS status, count(*) AS events, count(*) FILTER (NOT legal) AS illegal,
    CAST(0 AS BIGINT) AS late FROM l GROUP BY document_id, track""")
def stream_checked_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events out of order within and across four micro-batches; each waits ten days, so none is late."""
    rows = corpus.session_events(spark, sf_dir).select("document_id", "track", "seq", F.col("ts").cast("timestamp").alias("ts"), "status")
    top = rows.agg(F.max("seq")).first()[0] or 0
    shifted = F.col("seq") + F.col("seq") * 37 % 300
    out, progress = _dir(spark, "moves"), _dir(spark, "progress")
    part = F.floor(shifted * 4 / (top + 300)).cast("int")
    _arrivals(spark, rows, part, 4, lambda s: sessions.checked_state_stream(s, out, progress, "10 days", buckets=8))
    sessions.release_waiting(spark, out)
    return sessions.checked_states(spark, out)


@query("""WITH x AS (SELECT CAST(event_id AS VARCHAR) AS document_id, date_trunc('second', ts) + INTERVAL 1 DAY AS expires_at FROM events)
    SELECT document_id, expires_at FROM x WHERE expires_at < (SELECT max(ts) FROM events)""")
def stream_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an upload that expires a day later. They come in three micro-batches, so that two thirds are late."""
    uploads = corpus.table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("document_id"),
        F.col("ts").cast("timestamp").alias("upload_timestamp"),
        (F.date_trunc("second", F.col("ts").cast("timestamp")) + F.expr("INTERVAL 1 DAY")).alias("expires_at"),
    )
    out, progress = _dir(spark, "expiry"), _dir(spark, "progress")
    part = F.pmod(F.col("document_id").cast("long") * 7919, F.lit(3))
    _arrivals(spark, uploads, part, 3, lambda s: sessions.expiry_stream(s, out, progress))
    return sessions.told(spark, out).drop("batch")


@query()
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus written out as text files and taken in as they arrive."""
    texts, out = _dir(spark, "texts"), _dir(spark, "taken")
    plain = corpus.raw_documents(spark, sf_dir).select(F.col("text").alias("value"))
    plain.write.option("maxRecordsPerFile", 50).text(texts)
    arrivals.ingest_stream(spark, texts, out, _dir(spark, "progress")).awaitTermination()
    return spark.read.parquet(f"{out}/documents").select(
        "document_id", "original_filename", "format", "language", "status", "size_bytes"
    )
