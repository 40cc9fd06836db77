"""Keyed memory on streams: several batches, late outcomes, riders at rest."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from farelens.operators import memory
from farelens.streaming import decisions as streaming
from farelens.streaming import memory as stream_memory

ROWS = "rider_id long, offer_id long, event_time timestamp, purpose string, origin_zone long, surge double, action string, eta_min double, realized_fare double, realized_wait double"
DAY0 = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _run(spark, tmp_path, batches, **kw):
    """Each batch is a file and a trigger of its own."""
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, ROWS).coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    return streaming.drain(spark, stream_memory.remember(stream, **kw), f"{tmp_path}/check", f"{tmp_path}/out")


def _decision(rider, offer, day, rng, action=None, fare=None, wait=None):
    return (rider, offer, DAY0 + dt.timedelta(days=day, seconds=offer), rng.choice(["commute", "social"]), rng.randint(1, 2), rng.choice([1.0, 1.6, 2.1]), action or rng.choice(["accept", "reject"]), float(rng.randint(1, 9)), fare, wait)


def test_many_batches_equal_the_batch_operators(spark, tmp_path):
    rng = random.Random(3)
    rows = [_decision(k % 3, k, k / 10, rng, "accept" if k % 4 else "reject", 5.0 + k / 4 if k % 4 and k % 3 else None, float(k % 30) if k % 4 else None) for k in range(90)]
    out = _run(spark, tmp_path, [rows[:30], rows[30:60], rows[60:]], k=4).collect()
    log = spark.createDataFrame(rows, ROWS).selectExpr("*", "row_number() OVER (PARTITION BY rider_id ORDER BY event_time, offer_id) AS seq", "CAST(action = 'accept' AS LONG) AS accepted")
    running = {(r.rider_id, r.seq): (r.episodes_total, r.mean_fare_paid, r.accept_rate_high_surge, r.bad_wait_experiences) for r in memory.aggregates(log, running=True).collect()}
    assert {(r.rider_id, r.seq): (r.episodes_total, r.mean_fare_paid, r.accept_rate_high_surge, r.bad_wait_experiences) for r in out} == running and len(out) == 90
    recalled = {}
    for r in memory.recall(log, 4).orderBy("rank").collect():
        recalled.setdefault((r.rider_id, r.seq), []).append((r.similarity, r.episode_seq))
    assert {(r.rider_id, r.seq): [tuple(e) for e in r.recalled] for r in out if r.recalled} == recalled


def test_outcomes_that_come_later_count_from_then_on(spark, tmp_path):
    rng = random.Random(1)
    outcome = lambda rider, offer, day, fare, wait: (rider, offer, DAY0 + dt.timedelta(days=day), None, None, None, None, None, fare, wait)
    first = [_decision(1, 10, 0, rng, "accept"), _decision(1, 11, 1, rng, "reject"), _decision(2, 12, 1, rng, "accept", 3.0, 1.0)]
    second = [outcome(1, 10, 2, 8.5, 100.0), outcome(1, 10, 2.1, 9.5, 100.0), outcome(1, 99, 2, 1.0, 1.0), _decision(1, 13, 3, rng, "accept"), _decision(2, 14, 3, rng, "reject")]
    got = {r.offer_id: r for r in _run(spark, tmp_path, [first, second]).collect()}
    assert set(got) == {10, 11, 12, 13, 14}
    assert got[11].mean_fare_paid is None and got[11].bad_wait_experiences == 0
    assert (got[13].mean_fare_paid, got[13].bad_wait_experiences, got[13].episodes_total) == (8.5, 1, 2)  # an outcome is taken once
    assert (got[14].mean_fare_paid, got[14].bad_wait_experiences) == (3.0, 0)


def test_riders_at_rest_are_forgotten(spark, tmp_path):
    rng = random.Random(1)
    batches = [[_decision(1, 1, 0, rng), _decision(2, 2, 0, rng)], [_decision(2, 3, 20, rng)], [_decision(2, 4, 50, rng)], [_decision(2, 5, 60, rng)], [_decision(1, 6, 61, rng), _decision(2, 7, 61, rng)]]
    got = {r.offer_id: r.episodes_total for r in _run(spark, tmp_path, batches, rest_days=40).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 2, 5: 3, 6: 0, 7: 4}  # rider 1 was away for longer, rider 2 was not


def test_state_follows_traits_and_not_decisions(spark):
    import json

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, v):
            self.held = v

    class Handle:
        def listTimers(self):  # noqa: N802
            return []

        def registerTimer(self, at):  # noqa: N802
            pass

    import pandas as pd

    processor, rng, sizes = stream_memory.RiderMemory(k=5), random.Random(2), []
    processor.handle, processor.state = Handle(), Value()
    for start in range(0, 4000, 1000):
        rows = [{"offer_id": k, "at_ms": k, "purpose": rng.choice("ab"), "origin_zone": rng.randint(1, 3), "band": rng.choice([1.0, 1.5]), "high": False, "decision": True, "accepted": True, "eta_min": 1.0, "paid": 100, "realized_wait": 1.0} for k in range(start, start + 1000)]
        assert len(next(processor.handleInputRows((1,), iter([pd.DataFrame(rows)]), None))) == 1000
        sizes.append(len(json.loads(processor.state.held[0])["traits"]))
    assert sizes[-1] <= 12 and len(processor.state.held[0]) < 2000 and F is not None
