"""Model calls that are recorded: nothing that was answered is asked again."""

import os
import time
from collections import Counter

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from corpusloom.plans import completion

PROMPTS = "document_id string, step string, segment int, question_id string, attempt int, tier string, prompt_version string, prompt string"


def prompts(spark, n, same=0):
    rows = [(f"d{i}", "type", 0, None, 1, "light", "v", f"prompt {i}" if i >= same else "shared") for i in range(n)]
    return spark.createDataFrame(rows, PROMPTS)


def counting(folder, crash=None, refuse=()):
    """A model whose calls are counted in files, one for each, and that may take its worker down once."""

    def model(name, prompt, temperature):
        if prompt == crash:
            time.sleep(4)  # the other calls are done by now
            os._exit(1)
        with open(f"{folder}/{time.time_ns()}-{os.getpid()}-{prompt.replace(' ', '_')}", "w"):
            pass
        if prompt in refuse:
            raise completion.AuthError("key")
        return f"{name}: {prompt}"

    return model


def counted(folder):
    return Counter(name.split("-", 2)[2] for name in os.listdir(folder))


def test_a_job_that_died_and_ran_again_asks_each_prompt_once(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    calls = completion.Calls(partitions=40, ledger=str(tmp_path / "ledger"))
    asked = prompts(spark, 20)
    with pytest.raises(Exception, match="(?s)."):
        completion.complete(asked, counting(tmp_path / "calls", crash="prompt 7"), calls=calls).count()
    before = counted(tmp_path / "calls")
    assert len(before) == 19 and completion.ledger(spark, calls.ledger).count() == 19
    done = completion.complete(asked, counting(tmp_path / "calls"), calls=calls)
    got = {r.document_id: (r.content, r.model_id, r.error) for r in done.collect()}
    assert got == {f"d{i}": (f"light: prompt {i}", "light", None) for i in range(20)}
    assert set(counted(tmp_path / "calls").values()) == {1} and len(counted(tmp_path / "calls")) == 20
    # a third run asks nothing
    assert completion.complete(asked, counting(tmp_path / "calls"), calls=calls).count() == 20
    assert sum(counted(tmp_path / "calls").values()) == 20


def test_equal_prompts_are_asked_once_and_failures_again(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    calls = completion.Calls(concurrency=3, ledger=str(tmp_path / "ledger"))
    asked = prompts(spark, 12, same=6)
    first = completion.complete(asked, counting(tmp_path / "calls", refuse=("prompt 9",)), calls=calls)
    assert first.where("error IS NOT NULL").select("document_id", "error").collect() == [("d9", "auth: key")]
    assert counted(tmp_path / "calls")["shared"] == 1
    again = completion.complete(asked, counting(tmp_path / "calls"), calls=calls)
    assert again.where("error IS NOT NULL").count() == 0 and again.count() == 12
    assert {k: n for k, n in counted(tmp_path / "calls").items() if n > 1} == {"prompt_9": 2}
    # another model or temperature is another call
    other = completion.complete(asked, counting(tmp_path / "calls"), completion.Tiers(light="small"), calls)
    assert {r.content for r in other.select(F.substring_index("content", ":", 1).alias("content")).collect()} == {"small"}


def test_a_thousand_prompts_spread_over_tasks(spark, tmp_path):
    where = lambda name, prompt, temperature: str(TaskContext.get().partitionId())
    done = completion.complete(prompts(spark, 1000), where, calls=completion.Calls(ledger=str(tmp_path / "ledger")))
    sizes = Counter(r.content for r in done.select("content").collect())
    assert len(sizes) >= 50 and max(sizes.values()) <= 40
