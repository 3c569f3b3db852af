"""Running prompts through a model function supplied by the user.

Calls are slow and cost money, so they can be recorded in a ledger: a folder that every task adds its replies to when it
ends, while the job still runs. A job that is run again, whatever ended the first run, asks only what the ledger does not
hold; a prompt that several rows share is asked once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.model import RESPONSES, TEMPERATURE
from corpusloom.operators.replies import ParsedAnswers, judge, parse_answers

# Called as complete(model, prompt, temperature) -> reply text, inside the tasks.
Model = Callable[[str, str, float], str]


class TransientError(Exception):
    """Raise from a model function when another model may be tried (rate limit, time-out, unavailable)."""


class AuthError(Exception):
    """Raise from a model function when credentials are refused; no other model is tried."""


@dataclass(frozen=True)
class Tiers:
    primary: str = "primary"
    light: str = "light"
    fallback: str = "fallback"

    def of(self, tier: str) -> str:
        return self.light if tier == "light" else self.primary


@dataclass(frozen=True)
class Calls:
    """How a job makes its calls: over how many tasks, how many at a time in each, and the folder of the ledger, if any."""

    partitions: int | None = None
    concurrency: int = 1
    ledger: str | None = None


LEDGER = "digest STRING, content STRING, model_id STRING, error STRING"
KEYS = ["document_id", "step", "segment", "question_id", "attempt", "prompt_version"]
# A task's replies are recorded together, when it ends.
CALLS_PER_TASK = 16


def _call(fn: Model, tiers: Tiers, tier: str, prompt: str) -> tuple[str | None, str, str | None]:
    """(reply, model that answered last, error)."""
    model = tiers.of(tier)
    try:
        try:
            return fn(model, prompt, TEMPERATURE), model, None
        except TransientError:
            model = tiers.fallback
            return fn(model, prompt, TEMPERATURE), model, None
    except AuthError as e:
        return None, model, f"auth: {e}"
    except TransientError as e:
        return None, model, f"transient: {e}"
    except Exception as e:  # the model function is foreign code: its failure is a row, not a lost job
        return None, model, f"{type(e).__name__}: {e}"


def complete(prompts: DataFrame, fn: Model, tiers: Tiers = Tiers(), calls: Calls = Calls()) -> DataFrame:
    """Responses table for a prompt table.

    Without a ledger, store it (`session.materialize`) before using it twice. `calls.partitions` deals the prompts out by
    key, so that a small table of slow calls does not end up in one task; `calls.concurrency` calls run at a time in a
    task, for which `fn` must be safe to call from threads.
    """
    if calls.ledger is not None:
        return _recorded(prompts, fn, tiers, calls)
    dealt = prompts if calls.partitions is None else prompts.repartition(calls.partitions, *KEYS)
    return dealt.mapInPandas(_caller(fn, tiers, calls.concurrency, KEYS), RESPONSES)


def _caller(fn: Model, tiers: Tiers, concurrency: int, keys: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                replies = list(pool.map(lambda tier, prompt: _call(fn, tiers, tier, prompt), batch["tier"], batch["prompt"]))
                yield batch[keys].assign(
                    content=[r[0] for r in replies], model_id=[r[1] for r in replies], error=[r[2] for r in replies]
                )

    return run


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Recorded calls: `digest` of what was asked, the reply or the error. Calls that failed are asked again."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def _recorded(prompts: DataFrame, fn: Model, tiers: Tiers, calls: Calls) -> DataFrame:
    spark = prompts.sparkSession
    models = F.lit("\x1f".join((tiers.primary, tiers.light, tiers.fallback, str(TEMPERATURE))))
    digest = F.sha2(F.concat_ws("\x1f", models, "tier", "prompt"), 256)
    asked = prompts.withColumn("digest", digest)
    known = ledger(spark, calls.ledger).where("content IS NOT NULL").select("digest")
    new = asked.select("digest", "tier", "prompt").dropDuplicates(["digest"]).join(known, "digest", "left_anti")
    tasks = calls.partitions
    if tasks is None:
        open_ = asked.select("digest").distinct().join(known, "digest", "left_anti").count()
        tasks = max(spark.sparkContext.defaultParallelism, -(-open_ // CALLS_PER_TASK))
    made = new.repartition(tasks, "digest").mapInPandas(_caller(fn, tiers, calls.concurrency, ["digest"]), LEDGER)
    # The second commit algorithm puts a task's file in place when the task ends, not when the job does.
    made.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(calls.ledger)
    best = F.max_by(F.struct("content", "model_id", "error"), F.col("content").isNotNull()).alias("r")
    replies = ledger(spark, calls.ledger).groupBy("digest").agg(best)
    return asked.join(replies, "digest").select(*KEYS, "r.content", "r.model_id", "r.error")


def corrective_prompts(prompts: DataFrame, failures: DataFrame) -> DataFrame:
    """Second attempt for answers that could not be read: the prompt, the reply and what was wrong with it."""
    bad = failures.where(F.col("attempt") == 1).select("question_id", "document_id", "content", "error_message")
    text = F.concat(
        F.col("prompt"),
        F.lit("\n\n---\nThe reply below could not be used.\n\nReply:\n```\n"),
        F.col("content"),
        F.lit("\n```\n\nProblem: "),
        F.col("error_message"),
        F.lit("\n\nReply again with the JSON object only."),
    )
    return (
        prompts.join(bad, ["question_id", "document_id"])
        .withColumns({"prompt": text, "attempt": F.lit(2)})
        .select(*prompts.columns)
    )


def retry_unparsed(
    prompts: DataFrame,
    responses: DataFrame,
    fn: Model,
    tiers: Tiers = Tiers(),
    settle: Callable[[DataFrame], DataFrame] | None = None,
    calls: Calls = Calls(),
) -> ParsedAnswers:
    """Answers after at most one more attempt; the recorded model is that of the first call."""
    first = parse_answers(responses)
    again = complete(corrective_prompts(prompts, first.failures), fn, tiers, calls)
    again = judge(again) if settle is None else settle(judge(again))
    second = parse_answers(again)
    asked = responses.where(F.col("step") == "answer").select(
        "question_id", "document_id", F.col("model_id").alias("_model")
    )
    renamed = (
        second.answers.join(asked, ["question_id", "document_id"])
        .withColumn("model_id", F.col("_model"))
        .select(*first.answers.columns)
    )
    lost = again.where(F.col("content").isNull()).select(
        "question_id", "document_id", "attempt", "content", F.concat(F.lit("Retry failed: "), "error").alias("error_message")
    )
    return ParsedAnswers(
        first.answers.unionByName(renamed),
        first.refs.unionByName(second.refs),
        second.failures.unionByName(lost),
    )
