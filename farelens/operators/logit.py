"""Multinomial-logit baseline: training rows, fitting and scoring.

The model is fitted by Newton steps: a step is one pass in which tasks add up gradient and curvature of their rows, so a
few dozen numbers a task reach the driver, and a handful of passes find the optimum.

The reservation fare is where P(accept) falls to one half. Scores are linear in the fare, so the 40
bisection steps of all rows of a batch are a few numpy operations each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farelens.functions import exprs as X
from farelens.functions.rand import hash_uniform
from farelens.sources.staging import discard, materialize

FEATURES = ("fare_rel", "surge", "eta_min", "transit_min", "is_airport")


@dataclass(frozen=True)
class LogitModel:
    """Per action the intercept and the weights of FEATURES."""

    actions: tuple[str, ...]
    intercepts: tuple[float, ...]
    weights: tuple[tuple[float, ...], ...]


def _training_base(trips: DataFrame, seed: int) -> DataFrame:
    """Each trip's key and features, and whether it is of the half that stands for the other actions, too."""
    own = F.median("fare_paid").over(Window.partitionBy("rider_id"))
    narrow = trips.select("rider_id", "tk", "fare_paid", "surge_ratio", "wait_secs", "trip_miles", "pickup_zone", "dropoff_zone").where("rider_id IS NOT NULL")
    return narrow.withColumn("own_median", own).select(
        "tk", (F.col("fare_paid") / F.col("own_median")).alias("fare_rel"), X.clip("surge_ratio", 1.0, 3.0).alias("surge"), (F.col("wait_secs") / 60.0).alias("eta_min"),
        (F.col("trip_miles") / X.TRANSIT_MPH * 60.0).alias("transit_min"), (F.col("pickup_zone").isin(*X.AIRPORT_ZONES) | F.col("dropoff_zone").isin(*X.AIRPORT_ZONES)).cast("double").alias("is_airport"),
        (hash_uniform(f"{seed}:half", "tk") < 0.5).alias("half"),
    )


def _variants() -> Column:
    """The training rows of a trip: itself as an accept, and for one of the half three changed ones."""

    def variant(action: str, **changed: Column) -> Column:
        return F.struct(F.lit(action).alias("action"), *(changed.get(f, F.col(f)).alias(f) for f in FEATURES))

    more = F.array(
        variant("reject", fare_rel=F.col("fare_rel") * 1.8),
        variant("wait_for_better", surge=F.lit(2.5), fare_rel=F.col("fare_rel") * 1.3, eta_min=F.col("eta_min") * 1.5),
        variant("switch_mode", surge=F.lit(1.8), transit_min=F.col("eta_min") * 0.6),
    )
    return F.concat(F.array(variant("accept")), F.when(F.col("half"), more).otherwise(F.slice(more, 1, 0)))


def training_rows(trips: DataFrame, seed: int) -> DataFrame:
    """Every trip as an accept, and half of them (by hash) three times more, changed towards another action."""
    return _training_base(trips, seed).select("tk", F.explode(_variants()).alias("r")).select("tk", "r.*")


def fit_trips(trips: DataFrame, seed: int, c: float = 1.0) -> LogitModel:
    """The model of all trips' training rows. Trips' features are written once; each pass makes the rows of them anew."""
    base = materialize(_training_base(trips, seed).drop("tk"), "logit-features")
    model = _newton(base.select(F.explode(_variants()).alias("r")).select("r.*"), c)
    discard(base)
    return model


def fit(rows: DataFrame, c: float = 1.0) -> LogitModel:
    """L2-penalized multinomial regression; the penalty is 1 / (c * rows)."""
    rest = materialize(rows.select("action", *FEATURES), "logit-rows")
    model = _newton(rest, c)
    discard(rest)
    return model


#: Most Newton steps, and the largest change of a parameter that counts as none.
STEPS, STILL = 100, 1e-9


def _newton(rows: DataFrame, c: float) -> LogitModel:
    """Fits on rows that are cheap to read again. Intercepts are not penalized; their mean, which is free, is 0."""
    actions, d = tuple(sorted(X.ACTIONS)), len(FEATURES) + 1
    k = len(actions)
    numbered = rows.select((F.array_position(F.array(*(F.lit(a) for a in actions)), F.col("action")) - 1).cast("int").alias("y"), *(F.col(f).cast("double").alias(f) for f in FEATURES))
    w, n, last = np.zeros((k, d)), None, np.inf
    damped = 1.0
    for _ in range(STEPS):
        loss, grad, curve, n = _pass(numbered, w, k, d)
        if not n:
            break
        penalty = 1.0 / (c * n)  # of the mean loss, half the squared weights
        loss += 0.5 * penalty * n * float((w[:, 1:] ** 2).sum())
        if loss > last + 1e-9 * abs(last) and damped > 1e-4:  # the step went too far: half of it
            damped /= 2.0
            w = before + damped * step
            continue
        mask = np.tile(np.arange(d) > 0, k) * penalty * n
        g = grad.reshape(-1) + mask * w.reshape(-1)
        h = curve + np.diag(mask)
        shift = np.zeros((k * d, 1))
        shift[::d, 0] = 1.0  # the direction in which all intercepts move together, which changes nothing
        step = -np.linalg.solve(h + shift @ shift.T * max(1.0, n / k), g).reshape(k, d)
        before, last, damped, w = w, loss, 1.0, w + step
        if np.abs(step).max() < STILL * max(1.0, np.abs(w).max()):
            break
    w[:, 0] -= w[:, 0].mean()
    return LogitModel(actions, tuple(float(v) for v in w[:, 0]), tuple(tuple(float(v) for v in line) for line in w[:, 1:]))


def _pass(rows: DataFrame, w: np.ndarray, k: int, d: int) -> tuple[float, np.ndarray, np.ndarray, int]:
    """Loss, gradient and curvature at ``w``, and the number of rows: a row of sums from every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 + k * d + k * d * k * d)
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            y = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = np.stack([np.ones(m), *(batch.column(j).to_numpy(zero_copy_only=False) for j in range(1, d))], axis=1)
            s = x @ w.T
            s -= s.max(axis=1, keepdims=True)
            p = np.exp(s)
            total = p.sum(axis=1, keepdims=True)
            p /= total
            sums[0] += (np.log(total[:, 0]) - s[np.arange(m), y]).sum()
            sums[1] += m
            curve = np.zeros((k, d, k, d))
            for a in range(k):
                for b in range(a, k):
                    part = x.T @ (x * (p[:, a] * ((a == b) - p[:, b]))[:, None])
                    curve[a, :, b, :] = part
                    curve[b, :, a, :] = part
            p[np.arange(m), y] -= 1.0
            sums[2 : 2 + k * d] += (p.T @ x).reshape(-1)
            sums[2 + k * d :] += curve.reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["s"])

    found = [np.array(r["s"]) for r in rows.mapInArrow(run, "s array<double>").collect()]
    sums = np.sum(found, axis=0) if found else np.zeros(2 + k * d + k * d * k * d)
    return float(sums[0]), sums[2 : 2 + k * d].reshape(k, d), sums[2 + k * d :].reshape(k * d, k * d), int(sums[1])


def _score(model: LogitModel, k: int, features: list[Column]) -> Column:
    return sum((F.lit(w) * f for w, f in zip(model.weights[k], features, strict=True)), F.lit(model.intercepts[k]))


def _probabilities(model: LogitModel, features: list[Column]) -> list[Column]:
    scores = [_score(model, k, features) for k in range(len(model.actions))]
    top = F.greatest(*scores)
    powers = [F.exp(s - top) for s in scores]
    total = sum(powers[1:], powers[0])
    return [p / total for p in powers]


def logit_decisions(offers: DataFrame, personas: DataFrame | None, model: LogitModel, seed: int) -> DataFrame:
    """Trace of the logit baseline: categorical draws by hash, P(accept), reservation fare by bisection."""
    from farelens.operators.decisions import _trace, with_persona

    median = F.greatest(F.col("median_fare_paid"), F.lit(1e-6))
    transit = F.when(F.col("transit_alt_minutes") <= 0, F.col("eta_min") * 2.0).otherwise(F.col("transit_alt_minutes"))
    airport = (F.col("origin_zone").isin(*X.AIRPORT_ZONES) | F.col("dest_zone").isin(*X.AIRPORT_ZONES)).cast("double")
    rest = [X.clip("surge", 1.0, 3.0), F.col("eta_min"), transit, airport]
    at = lambda fare: [fare / median, *rest]
    p = _probabilities(model, at(F.col("quoted_fare")))
    accept = model.actions.index("accept")
    u, upto, action = hash_uniform(f"{seed}:logit", "offer_id"), F.lit(0.0), F.lit(model.actions[-1])
    steps = []
    for name, q in zip(model.actions, p, strict=True):
        upto = upto + q
        steps.append((name, upto))
    for name, edge in reversed(steps[:-1]):
        action = F.when(u < edge, name).otherwise(action)

    @F.pandas_udf("double")
    def half_accepted(fare: pd.Series, median: pd.Series, surge: pd.Series, eta: pd.Series, transit: pd.Series, airport: pd.Series) -> pd.Series:
        """Where P(accept) is one half: the other actions' weight against that of acceptance is 1."""
        low, high = np.zeros(len(fare)), np.maximum(fare.to_numpy() * 10.0, 1.0)
        given = np.stack([c.to_numpy(float) for c in (surge, eta, transit, airport)])
        away = [k for k in range(len(model.actions)) if k != accept]
        weights, starts = np.array(model.weights), np.array(model.intercepts)
        level = (starts[away] - starts[accept])[:, None] + (weights[away, 1:] - weights[accept, 1:]) @ given
        slope = (weights[away, 0] - weights[accept, 0])[:, None] / median.to_numpy(float)
        with np.errstate(over="ignore"):
            for _ in range(40):
                mid = (low + high) / 2.0
                keeps = np.exp(level + slope * mid).sum(axis=0) <= 1.0
                low, high = np.where(keeps, mid, low), np.where(keeps, high, mid)
        return pd.Series(low)

    found = half_accepted("quoted_fare", median.cast("double"), *(c.cast("double") for c in rest))
    with_median = offers if personas is None else with_persona(offers, personas, "median_fare_paid")
    columns = {"action": action, "confidence": F.greatest(*p), "reservation_fare": X.rounded(found, 2)}
    out = _trace(with_median, personas, "logit_baseline", columns, p[accept])
    fixed = F.when((F.col("action") == "accept") & (F.col("reservation_fare") < F.col("quoted_fare")), F.col("quoted_fare")).otherwise(F.col("reservation_fare"))
    return out.withColumn("reservation_fare", fixed).drop("median_fare_paid")
