"""Streams whose rows come late and out of order, over several micro-batches."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from helpers import rows
from pyspark.sql import functions as F

from corpusloom.model import ANALYSIS_MOVES, QUALITY_MOVES
from corpusloom.sources import store
from corpusloom.streaming import sessions

EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return None if seconds is None else EPOCH + timedelta(seconds=seconds)


class Folder:
    """A stream that is run to its end after each batch of rows."""

    def __init__(self, spark, tmp_path, schema):
        self.spark, self.path, self.schema = spark, str(tmp_path / "in"), schema

    def send(self, batch, run):
        self.spark.createDataFrame(batch, self.schema).coalesce(1).write.mode("append").parquet(self.path)
        run(self.spark.readStream.schema(self.schema).parquet(self.path)).awaitTermination()


def plain_states(batches, delay):
    state, waiting, clock = {}, [], None

    def advance(arrived, delay):
        nonlocal waiting, clock
        waiting += arrived
        clock = max([t for *_, t, _ in arrived if t is not None] + ([clock] if clock is not None else []), default=None)
        passed = lambda t: t is None or clock is None or t + delay <= clock
        ready, waiting = [e for e in waiting if passed(e[3])], [e for e in waiting if not passed(e[3])]
        events = {}
        for doc, track, seq, _, status in ready:
            events.setdefault((doc, track), {}).setdefault(seq, []).append(status)
        for key, found in events.items():
            status, base, seen, illegal, late = state.get(key, (None, None, 0, 0, 0))
            first, last = base, base
            for seq in sorted(found):
                if first is not None and seq <= first:
                    late += len(found[seq])
                    continue
                after = min(found[seq])
                moves = ANALYSIS_MOVES if key[1] == "analysis" else QUALITY_MOVES
                illegal += status not in moves.get(after, [])
                seen, late, status, last = seen + 1, late + len(found[seq]) - 1, after, seq
            state[key] = (status, last, seen, illegal, late)

    for batch in batches:
        advance(batch, delay)
    waited = len(waiting)
    advance([], 0)
    return sorted((d, t, *v) for (d, t), v in state.items()), waited


def some_events(seed, n, jitter):
    rng = random.Random(seed)
    events = []
    for seq in range(n):
        track = rng.choice(["analysis", "quality"])
        status = rng.choice(list(ANALYSIS_MOVES if track == "analysis" else QUALITY_MOVES))
        events.append((rng.choice("abc"), track, seq, seq * 10, status))
    events += [rng.choice(events) for _ in range(n // 20)]
    return sorted(events, key=lambda e: e[2] + rng.random() * jitter)


@pytest.mark.parametrize("jitter, delay", [(0, 0), (30, 100), (30, 400)])
def test_moves_out_of_order_over_several_batches(spark, tmp_path, jitter, delay):
    events = some_events(jitter + delay, 240, jitter)
    batches = [events[i : i + 60] for i in range(0, len(events), 60)]
    source = Folder(spark, tmp_path, sessions.EARLY)
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    for batch in batches:
        ready = [(d, t, s, at(x), v) for d, t, s, x, v in batch]
        source.send(ready, lambda s: sessions.checked_state_stream(s, out, progress, f"{delay} seconds", buckets=4))
    want, waited = plain_states(batches, delay)
    assert (waited > 0) == (delay > 0)
    assert store.read(spark, f"{out}/state", "early").count() == waited
    sessions.release_waiting(spark, out)
    got = rows(sessions.checked_states(spark, out), "document_id", "track", "status", "seq", "events", "illegal", "late")
    assert got == want
    # a delay of the whole jitter leaves nothing late but the copies
    late = sum(r[6] for r in got)
    assert late == 12 if delay == 400 or not jitter else late > 12


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    batch = spark.createDataFrame([("a", "analysis", 0, at(0), "inferring_type")], sessions.EARLY)
    sessions._advance(batch, out, 0, "0 seconds", 2)
    before = store.latest(spark, f"{out}/state")
    sessions._advance(batch, out, 0, "0 seconds", 2)
    assert store.latest(spark, f"{out}/state") == before
    assert rows(sessions.checked_states(spark, out), "events", "illegal", "late") == [(1, 0, 0)]


def expire(spark, tmp_path, batches, clocks=None):
    source = Folder(spark, tmp_path, sessions.UPLOADS)
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    for i, batch in enumerate(batches):
        now = None if clocks is None else (lambda: EPOCH.timestamp() + clocks[i])  # noqa: B023
        ready = [(d, at(u), at(e)) for d, u, e in batch]
        source.send(ready, lambda s: sessions.expiry_stream(s, out, progress, now))  # noqa: B023
    found = sessions.told(spark, out).select("batch", "document_id", F.unix_seconds("expires_at") - int(EPOCH.timestamp()))
    return rows(found)


def test_a_late_upload_in_a_later_batch_is_told(spark, tmp_path):
    day = 86_400
    first = [("a", 0, 100), ("b", 50, 2 * day), ("z", 3 * day, 9 * day)]
    second = [("late", 10, 200), ("later", 20, 2 * day + 5), ("never", 0, None)]
    assert expire(spark, tmp_path, [first, second]) == [(0, "a", 100), (0, "b", 2 * day), (1, "late", 200), (1, "later", 2 * day + 5)]


def test_processing_time_decides_what_is_due(spark, tmp_path):
    hour = 3600
    batches = [[("a", 0, hour), ("b", 0, hour + 1800)], [("c", 0, 5 * hour)], [("d", 0, 10)], [("e", 0, 99 * hour)]]
    clocks = [hour, hour + 60, hour + 1800, 5 * hour + 1]
    assert expire(spark, tmp_path, batches, clocks) == [(1, "a", hour), (2, "d", 10), (3, "b", hour + 1800), (3, "c", 5 * hour)]


def test_the_latest_upload_of_a_document_decides(spark, tmp_path):
    batches = [
        [("again", 0, 100), ("again", 5, 9000), ("twice", 0, 50), ("x", 200, 300)],
        [("twice", 0, 50), ("twice", 300, 400), ("x", 400, 401)],
        [("x", 20_000, 20_001)],
        [("x", 30_000, 30_001)],
        [("y", 40_000, 90_000)],
    ]
    told = expire(spark, tmp_path, batches)
    # `again` and `x` wait for their later uploads; `twice` came anew; an upload told once is not told again
    assert told == [(0, "twice", 50), (2, "again", 9000), (2, "twice", 400), (4, "x", 30_001)]
