"""What the work of large tables rests on: shuffles that don't grow with replicates, batches instead of groups, nothing staged twice."""

import hashlib
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from farelens.functions.rand import numbered_hashes
from farelens.operators import boosting, decisions, features, logit, screening
from farelens.plans import registry
from farelens.plans.registry import Inputs


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbered_hashes_are_md5():
    tails = [b":control:r1t0v0", b"", b":" + b"x" * 60, ":price_é:r2".encode()]
    got = numbered_hashes("7:draw:", 120, tails)
    for row, tail in enumerate(tails):
        assert got[row].tolist() == [int(hashlib.md5(b"7:draw:" + str(n).encode() + tail).hexdigest()[:8], 16) for n in range(1, 121)]


def test_redraws_are_added_up_in_tasks(spark):
    rows = [(c, r, f"r{r}v{k}", "post" if k else "pre", ((r * 7 + k * 3) % 11) / 10, None if (r + k) % 13 == 0 else 5.0 + r + k) for c in ("control", "price_-20") for r in range(60) for k in range(1 + r % 4)]
    split = spark.createDataFrame(rows, "cell string, rider_id long, offer_id string, period string, p_accept double, quoted_fare double")
    got = {(r.cell, r.replicate): r for r in screening.redraw_totals(split, 25, 5).collect()}
    want = screening.bernoulli_redraws(split, 25, 5).groupBy("cell", "replicate").agg(*(F.sum(m).alias(m) for m in screening.METRICS)).collect()
    assert len(got) == len(want) == 50
    for r in want:
        assert all(getattr(got[r.cell, r.replicate], m) == pytest.approx(getattr(r, m), abs=1e-9) for m in screening.METRICS)
    assert "Generate" not in plan_of(screening.redraw_totals(split, 25, 5))


def test_logit_is_at_its_optimum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 5)) * (1, 0.5, 4, 8, 0.3)
    names = ("accept", "reject", "switch_mode", "wait_for_better")
    y = [int(np.argmax(v @ rng.normal(size=(5, 4)) * 0.2 + rng.gumbel(size=4))) for v in x]
    model = logit.fit(spark.createDataFrame([(names[k], *map(float, v)) for k, v in zip(y, x, strict=True)], "action string, " + ", ".join(f"{f} double" for f in logit.FEATURES)))
    assert model.actions == names and abs(sum(model.intercepts)) < 1e-9
    w = np.column_stack([model.intercepts, model.weights])
    s = np.column_stack([np.ones(600), x]) @ w.T
    p = np.exp(s - s.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(600), y] -= 1
    gradient = p.T @ np.column_stack([np.ones(600), x]) + np.column_stack([np.zeros(4), w[:, 1:]])
    assert np.abs(gradient).max() < 1e-6


def test_logit_reservation_fare_is_where_acceptance_is_one_half(spark, folder):
    i = Inputs(spark, folder)
    model = logit.LogitModel(("accept", "reject", "switch_mode", "wait_for_better"), (0.9, 1.4, 1.0, -3.0), ((-0.6, 0.3, -0.06, 0.09, 0.1), (1.0, -1.1, -0.06, 0.04, 0.2), (0.4, -2.9, 0.05, -0.3, -0.5), (-0.8, 1.0, 0.06, 0.18, 0.2)))
    got = logit.logit_decisions(i.known, None, model, 7)
    assert "ArrowEvalPython" in plan_of(got)  # a batch at a time, not a fold over every row's expression tree
    medians = {r.rider_id: r.median_fare_paid for r in i.personas.collect()}
    for r in got.where("action <> 'accept'").limit(200).collect():
        rest = (min(max(r.surge, 1.0), 3.0), round(r.eta_min * 10 + 1e-9) / 10, r.transit_alt_minutes, float(r.origin_zone in (1, 132, 138) or r.dest_zone in (1, 132, 138)))
        low, high = 0.0, max(r.quoted_fare * 10, 1.0)
        for _ in range(40):
            mid = (low + high) / 2
            s = [b + w[0] * mid / medians[r.rider_id] + sum(a * v for a, v in zip(w[1:], rest, strict=True)) for b, w in zip(model.intercepts, model.weights, strict=True)]
            low, high = (mid, high) if 1 / sum(math.exp(v - s[0]) for v in s) >= 0.5 else (low, mid)
        assert r.reservation_fare == pytest.approx(low, abs=0.011)


def test_slopes_of_many_riders_come_from_batches(spark):
    rng = np.random.default_rng(5)
    rows = [(r, float(s), int(rng.random() < 1 / (1 + math.exp(2 * math.log(s) - 0.5 - r % 3)))) for r in range(300) for s in np.round(rng.uniform(1, 4, 3 + r % 30), 2)] + [(7, None, 1), (8, 2.0, None)]
    slopes = features.surge_slopes(spark.createDataFrame(rows, "rider_id long, surge double, accepted long"))
    assert "MapInArrow" in plan_of(slopes) and "FlatMapGroups" not in plan_of(slopes)
    got = {r.rider_id: r.surge_elasticity for r in slopes.collect()}
    assert len(got) == 300
    for rider in range(300):
        mine = [(math.log(max(s, 1)), a) for r, s, a in rows if r == rider and s is not None and a is not None]
        x, k = np.array([m[0] for m in mine]), np.array([m[1] for m in mine], float)
        if len(x) < 4 or len(np.unique(np.round(x, 3))) < 2 or not 0 < k.sum() < len(k):
            assert got[rider] == 0
            continue
        b, m = np.zeros(2), np.stack([np.ones_like(x), x], axis=1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(m @ b, -30, 30)))
            step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + np.diag([1e-9, 1e-6]), m.T @ (k - p) - np.array([0, 1e-6]) * b)
            b += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        assert got[rider] == pytest.approx(b[1], rel=1e-5, abs=1e-6)


def test_runs_take_one_order_of_decisions(spark):
    rows = [(1, k, a) for k, a in enumerate((1, 1, 0, 1, 1, 1, 0, 0, 1, None, 1))] + [(2, 0, 0), (2, 1, 0), (3, 0, 1)]
    runs = features.run_lengths(spark.createDataFrame(rows, "rider_id long, seq long, accepted long"), ["seq"])
    assert plan_of(runs).count("Window ") == 1
    assert {r.rider_id: (r.run_accept_mean, r.run_accept_max) for r in runs.collect()} == {1: (1.75, 3.0), 2: (0.0, 0.0), 3: (1.0, 1.0)}


def test_models_of_a_million_riders_grow_in_their_tasks():
    assert boosting.BoosterRules().partition_rows >= 1_800_000  # all riders, real and simulated, of 60 times sf0.1


def test_offers_and_traces_are_not_staged(spark, folder):
    i = Inputs(spark, folder)
    assert i.full.count() == i.offers.count() and i.full.count() == decisions.rule_decisions(i.offers, i.personas).count()
    assert not {"offers", "trace"} & {key[3] for key in registry.staged.__globals__["_STAGED"]}
    assert "Exchange" not in plan_of(i.full) and "Join" not in plan_of(i.full)
    both = [df.select(sorted(df.columns)).orderBy("offer_id").collect() for df in (i.full, decisions.rule_decisions(i.offers, i.personas))]
    assert both[0] == both[1]


def test_a_staged_tables_scratch_and_shuffle_files_are_gone(spark, folder, tmp_path):
    from farelens.sources import staging

    def build():
        rest = staging.materialize(spark.range(100).repartition(3), "scratch")
        return rest.groupBy((F.col("id") % 7).alias("k")).count(), rest

    before = spark.conf.get(staging.SWEPT)
    assert staging.staged(spark, folder, f"t-{tmp_path.name}", build).count() == 7 and spark.conf.get(staging.SWEPT) == before
    own = staging._own_folder(spark).removeprefix("file://")
    assert not [d for d in os.listdir(own) if d.startswith("scratch-")]
