"""Session events as a stream: current states, moves checked in order, and expiry.

The last two keep their state in tables that every micro-batch reads and writes, not behind a watermark, so that no row is
dropped for coming late. All work on a batch is joins, windows and aggregates; a batch replayed after a failure changes
nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.prefix import previous_value
from corpusloom.operators.sessions import move_allowed
from corpusloom.sources import store

TRACK = ["document_id", "track"]
EARLY = "document_id STRING, track STRING, seq LONG, ts TIMESTAMP, status STRING"
STATES = "document_id STRING, track STRING, status STRING, seq LONG, events LONG, illegal LONG, late LONG"
TOLD = "document_id STRING, expires_at TIMESTAMP"
UPLOADS = "document_id STRING, upload_timestamp TIMESTAMP, expires_at TIMESTAMP"


def state_stream(events: DataFrame) -> DataFrame:
    """Latest status per document and track (update mode): an aggregate, so busy documents are combined before the shuffle."""
    return events.groupBy("document_id", "track").agg(
        F.max("seq").alias("seq"), F.max_by("status", "seq").alias("status"), F.count("*").alias("events")
    )


def _start(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _put(df: DataFrame, path: str) -> DataFrame:
    """Write a batch's own folder, anew if the batch is replayed, and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What earlier batches wrote; nothing before the first."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


# --- Moves in order -----------------------------------------------------------------------------------------------


def checked_state_stream(
    events: DataFrame, out: str, checkpoint: str, delay: str = "1 hour", buckets: int = 64, available_now: bool = True
) -> StreamingQuery:
    """State per document and track with the number of illegal moves and of late events so far.

    `events(document_id, track, seq, ts, status)` may come out of order within and across micro-batches. An event waits
    until the stream's clock, the greatest `ts` seen, has passed its own by `delay`; then it is applied in the order of
    `seq`. One that is released behind a later one of its track, or repeats its `seq`, is counted as late and moves
    nothing. Changed states of each step are kept under `out/updates`, all states in the store `out/state`.
    """

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.select("document_id", "track", F.col("seq").cast("long").alias("seq"), "ts", "status")
        _advance(rows, out, 2 * number, delay, buckets)

    return _start(events, step, checkpoint, available_now)


def release_waiting(spark: SparkSession, out: str) -> None:
    """Apply the events that still wait, as when a stream has ended."""
    done = store.latest(spark, f"{out}/state")
    if done is not None:
        _advance(spark.createDataFrame([], EARLY), out, done.note["step"] + 1, "0 seconds", done.buckets)


def checked_states(spark: SparkSession, out: str) -> DataFrame:
    return store.read(spark, f"{out}/state", "current")


def _advance(rows: DataFrame, out: str, step: int, delay: str, buckets: int) -> None:
    spark, state = rows.sparkSession, f"{out}/state"
    done = store.latest(spark, state)
    if done is not None and done.note["step"] >= step:
        return  # a batch that had ended before the stream's own progress was noted
    arrived = _put(rows, f"{out}/arrived/step={step}")
    clock = arrived.select(F.unix_micros(F.max("ts"))).first()[0]
    clock = max((c for c in (clock, done and done.note["clock"]) if c is not None), default=None)
    old = store.read(spark, state, "current") if done else spark.createDataFrame([], STATES)
    early = store.read(spark, state, "early") if done else spark.createDataFrame([], EARLY)

    waiting = early.unionByName(arrived)
    passed = F.coalesce(F.col("ts") + F.expr(f"INTERVAL {delay}") <= F.timestamp_micros(F.lit(clock)), F.lit(True))
    # an event that came twice counts once; its copies are late
    ready = waiting.where(passed).groupBy(*TRACK, "seq").agg(F.min("status").alias("status"), F.count("*").alias("copies"))
    base = old.select(*TRACK, F.col("seq").alias("base_seq"), F.struct("status").alias("base"))
    judged = ready.join(base, TRACK, "left").withColumn("behind", F.coalesce(F.col("seq") <= F.col("base_seq"), F.lit(False)))
    late = judged.select(*TRACK, F.when(F.col("behind"), F.col("copies")).otherwise(F.col("copies") - 1).alias("late"))
    late = late.groupBy(*TRACK).agg(F.sum("late").alias("new_late"))
    line = judged.where("NOT behind").withColumn("own", F.struct("status"))
    line = previous_value(line, TRACK, "seq", "own", "earlier").withColumn("before", F.coalesce("earlier", "base"))
    legal = move_allowed(F.col("track"), F.col("before.status"), F.col("status"))
    moved = line.groupBy(*TRACK).agg(
        F.count("*").alias("new_events"),
        F.count_if(~legal).alias("new_illegal"),
        F.max("seq").alias("new_seq"),
        F.max_by("own", "seq").alias("last"),
    )
    total = lambda name: (F.coalesce(name, F.lit(0)) + F.coalesce(f"new_{name}", F.lit(0))).alias(name)
    changed = moved.join(late, TRACK, "full").join(old, TRACK, "left").select(
        *TRACK,
        F.when(F.col("last").isNotNull(), F.col("last.status")).otherwise(F.col("status")).alias("status"),
        F.coalesce("new_seq", "seq").alias("seq"),
        total("events"),
        total("illegal"),
        total("late"),
    )
    changed = _put(changed, f"{out}/updates/step={step}")
    ids = arrived.select("document_id").unionByName(changed.select("document_id")).distinct()
    same = old.join(ids, "document_id", "left_semi").join(changed, TRACK, "left_anti")
    left = waiting.where(~passed).join(ids, "document_id", "left_semi")
    note = {"step": step, "clock": clock}
    store.replace(state, ids, buckets, note, current=changed.unionByName(same), early=left)


# --- Expiry -------------------------------------------------------------------------------------------------------

SPAN = 6 * 3600


def _due(expires_at: str) -> Column:
    return F.floor(F.unix_timestamp(expires_at) / SPAN).cast("long")


def expiry_stream(
    documents: DataFrame,
    out: str,
    checkpoint: str,
    now: Callable[[], float] | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Documents whose `expires_at` has passed, each told once, in `out/told` (document_id, expires_at).

    The clock is `now()` in seconds (for instance `time.time`) when a micro-batch begins, or by default the greatest
    `upload_timestamp` seen. It decides what is due, never what is read: an upload that comes late is told in its own
    batch if it has expired by then. Of several uploads of a document that are still waiting, the one that expires last
    counts; one that comes after the document was told counts anew. A document without `expires_at` never expires.

    Uploads wait in folders by the quarter of a day in which they are due; a batch opens the folders of quarters that have
    come since the last one. Only what these hold is then looked for among later ones.
    """

    def step(batch: DataFrame, number: int) -> None:
        _tell(batch.select(*[c.split()[0] for c in UPLOADS.split(", ")]), out, number, now)

    return _start(documents, step, checkpoint, available_now)


def _tell(uploads: DataFrame, out: str, number: int, now: Callable[[], float] | None) -> None:
    spark = uploads.sparkSession
    rows = uploads.where("expires_at IS NOT NULL").withColumn("due", _due("expires_at"))
    rows.hint("rebalance", "due").write.mode("overwrite").partitionBy("due").parquet(f"{out}/waiting/batch={number}")
    waiting = _read(spark, f"{out}/waiting", f"{UPLOADS}, batch LONG, due LONG").where(F.col("batch") <= number)
    clocks = _read(spark, f"{out}/clock", "clock LONG, batch LONG").where(F.col("batch") < number)
    before = clocks.agg(F.max("clock")).first()[0] or 0
    seen = uploads.select(F.max(F.unix_micros("upload_timestamp"))).first()[0] if now is None else int(now() * 1_000_000)
    clock = max(before, seen or 0)
    began, at = before // (SPAN * 1_000_000), F.timestamp_micros(F.lit(clock))
    earlier = _read(spark, f"{out}/told", f"{TOLD}, batch LONG, due LONG").where(F.col("batch") < number)
    earlier = earlier.select("document_id", "expires_at", "due")
    once = ["document_id", "expires_at", "due"]
    fresh = (F.col("due") >= began) | (F.col("batch") == number)
    hit = waiting.where((F.col("due") <= clock // (SPAN * 1_000_000)) & fresh & (F.col("expires_at") < at))
    last = hit.groupBy("document_id").agg(F.max("expires_at").alias("expires_at")).withColumn("due", _due("expires_at"))
    last = last.join(earlier, once, "left_anti")
    open_ = waiting.where(F.col("due") >= began).select(*once).join(earlier, once, "left_anti")
    later = open_.select("document_id", F.col("expires_at").alias("_later"))
    still = last.join(later, "document_id").where("_later > expires_at").select("document_id").distinct()
    new = last.join(still, "document_id", "left_anti")
    new.write.mode("overwrite").partitionBy("due").parquet(f"{out}/told/batch={number}")
    _put(spark.createDataFrame([(clock,)], "clock LONG"), f"{out}/clock/batch={number}")


def told(spark: SparkSession, out: str) -> DataFrame:
    return _read(spark, f"{out}/told", f"{TOLD}, batch LONG, due LONG").select("document_id", "expires_at", "batch")
