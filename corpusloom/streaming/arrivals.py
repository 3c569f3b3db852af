"""Files arriving in a folder, validated and cut as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.model import DEFAULT_RETENTION_SECONDS, FILES
from corpusloom.operators.ingest import ingest
from corpusloom.sources.files import load_files, with_names
from corpusloom.sources.store import bucket


def file_stream(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true")
    if per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return with_names(load_files(reader, path))


def ingest_stream(
    spark: SparkSession,
    path: str,
    out: str,
    checkpoint: str,
    retention: int = DEFAULT_RETENTION_SECONDS,
    per_trigger: int | None = None,
    available_now: bool = True,
    pages: DataFrame | None = None,
) -> StreamingQuery:
    """Ingest arriving files into tables under `out`.

    Each micro-batch replaces its own `batch` partition, so that a batch replayed after a failure leaves no copies. The file
    time stands for the upload time. `pages(document_id, page, text)` is a stored table, read anew with each batch; a paged
    file without rows there is marked failed.
    """

    def store(df: DataFrame, name: str, batch: int) -> DataFrame:
        target = f"{out}/{name}/batch={batch}"
        rows = df.withColumn("bucket", bucket("document_id")).hint("rebalance", "bucket")
        rows.write.mode("overwrite").parquet(target)
        return df.sparkSession.read.schema(df.schema).parquet(target)

    def write(files: DataFrame, batch: int) -> None:
        now = F.lit(None).cast("timestamp")
        done = ingest(files, now, pages, retention, settle=lambda chunks: store(chunks, "chunks", batch))
        times = files.select("document_id", F.col("modificationTime").alias("upload_timestamp"))
        records = done.documents.drop("upload_timestamp", "expires_at").join(times, "document_id")
        expiry = F.col("upload_timestamp") + F.make_interval(secs=F.lit(retention))
        store(done.rejected, "rejected", batch)
        store(records.withColumn("expires_at", expiry), "documents", batch)

    writer = file_stream(spark, path, per_trigger).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
