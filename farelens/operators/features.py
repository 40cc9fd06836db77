"""Behaviour features of decision sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farelens.functions import exprs as X
from farelens.functions import stats as S

#: The names of the sequence features.
FEATURES = (
    "accept_rate", "fare_pctl_accepted", "wait_accepted_median", "surge_elasticity", "purpose_commute", "purpose_social", "purpose_airport",
    "action_entropy", "run_accept_mean", "run_accept_max", "surge_accepted_mean", "log_n_decisions",
)


def action_entropy(events: DataFrame) -> DataFrame:
    """Entropy (nats) of each rider's actions."""
    p = [F.avg((F.col("action") == a).cast("int")) for a in X.ACTIONS]
    terms = sum((F.when(x > 0, x * F.ln(x)).otherwise(0.0) for x in p), F.lit(0.0))
    return events.groupBy("rider_id").agg((-terms).alias("action_entropy"))


def run_lengths(events: DataFrame, order: list[Column | str]) -> DataFrame:
    """Mean and longest run of accepted decisions; zeros without any.

    Accepted decisions of a run have as many others before them, so one order of a rider's decisions tells the runs apart.
    """
    yes = F.coalesce(F.col("accepted") == 1, F.lit(False))
    narrow = events.select("rider_id", yes.alias("_yes"), *(F.col(o).alias(f"_o{k}") if isinstance(o, str) else o.alias(f"_o{k}") for k, o in enumerate(order)))
    upto = Window.partitionBy("rider_id").orderBy(*(f"_o{k}" for k in range(len(order)))).rowsBetween(Window.unboundedPreceding, 0)
    runs = narrow.withColumn("_island", F.count_if(~F.col("_yes")).over(upto)).groupBy("rider_id", "_island").agg(F.count_if("_yes").alias("n"))
    one = F.when(F.col("n") > 0, F.col("n"))
    return runs.groupBy("rider_id").agg(F.coalesce(F.avg(one), F.lit(0.0)).alias("run_accept_mean"), F.coalesce(F.max(one), F.lit(0)).cast("double").alias("run_accept_max"))


def fare_percentiles(events: DataFrame, market: DataFrame) -> DataFrame:
    """Adds each quoted fare's place among the market's fares."""
    return S.ecdf_lookup(events, "quoted_fare", market, "quoted_fare", "fare_pctl")


def surge_slopes(events: DataFrame) -> DataFrame:
    """Per rider the logistic slope of acceptance on ln surge (nearly unpenalized); 0 where it is undefined.

    Decisions at one surge are alike to the fit, so they are counted first, map-side: a rider has an entry for each surge
    met, however many decisions. The Newton iterations of all riders of a batch run side by side in numpy.
    Rows without surge or decision don't count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = batch.column(1)
            at = np.repeat(np.arange(batch.num_rows), met.value_lengths().fill_null(0).to_numpy())
            surge, n, k = (met.flatten().field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("surge", "n", "k"))
            slopes = _slopes(at, np.log(np.maximum(surge, 1.0)), n, k, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(slopes)], names=["rider_id", "surge_elasticity"])

    counted = events.groupBy("rider_id", "surge").agg(F.count("accepted").alias("n"), F.coalesce(F.sum("accepted"), F.lit(0)).alias("k"))
    met = F.when(F.col("surge").isNotNull() & ~F.isnan("surge") & (F.col("n") > 0), F.struct(F.col("surge").cast("double").alias("surge"), "n", F.col("k").cast("long").alias("k")))
    return counted.groupBy(F.col("rider_id").cast("long").alias("rider_id")).agg(F.collect_list(met).alias("_met")).mapInArrow(run, "rider_id long, surge_elasticity double")


def _slopes(at: np.ndarray, x: np.ndarray, n: np.ndarray, k: np.ndarray, riders: int) -> np.ndarray:
    """The slope of each rider from entries (rider ``at``, ln surge, decisions, accepted ones)."""
    out = np.zeros(riders)
    total = lambda v: np.bincount(at, weights=v, minlength=riders)
    low, high = np.full(riders, np.inf), np.full(riders, -np.inf)
    np.minimum.at(low, at, np.round(x, 3))
    np.maximum.at(high, at, np.round(x, 3))
    decisions, accepted = total(n), total(k)
    left = np.flatnonzero((decisions >= 4) & (low < high) & (accepted > 0) & (accepted < decisions))
    place = np.full(riders, -1)
    b = np.zeros((len(left), 2))
    for _ in range(50):
        if not len(left):
            break
        place[:] = -1
        place[left] = np.arange(len(left))
        mine = place[at] >= 0
        at, x, n, k = at[mine], x[mine], n[mine], k[mine]
        to = place[at]
        p = 1.0 / (1.0 + np.exp(-np.clip(b[to, 0] + b[to, 1] * x, -30, 30)))
        w, r = n * p * (1 - p), k - n * p
        added = lambda v: np.bincount(to, weights=v, minlength=len(left))  # noqa: E731, B023
        h01 = added(w * x)
        h = np.stack([added(w) + 1e-9, h01, h01, added(w * x * x) + 1e-6], axis=1).reshape(-1, 2, 2)
        step = np.linalg.solve(h, np.stack([added(r), added(r * x) - 1e-6 * b[:, 1]], axis=1)[:, :, None])[:, :, 0]
        b += np.clip(step, -5, 5)
        out[left] = b[:, 1]
        moving = np.abs(step).max(axis=1) >= 1e-8
        left, b = left[moving], b[moving]
    return out


def sequence_features(events: DataFrame, market: DataFrame, order: list[Column | str], slopes: bool = True) -> DataFrame:
    """The feature row of every rider. ``order`` is the order of decisions for run lengths.

    Each part takes the columns it needs and no more; only riders and accepted fares meet the market's fares.
    """
    yes = F.col("accepted") == 1
    shares = [F.avg((F.col("action") == a).cast("int")) for a in X.ACTIONS]
    entropy = sum((F.when(x > 0, x * F.ln(x)).otherwise(0.0) for x in shares), F.lit(0.0))
    base = events.groupBy("rider_id").agg(
        F.avg(F.col("accepted").cast("double")).alias("accept_rate"),
        F.coalesce(F.median(F.when(yes, F.col("eta_min"))), F.lit(0.0)).alias("wait_accepted_median"),
        *(F.avg((F.col("purpose") == p).cast("int")).alias(f"purpose_{p}") for p in ("commute", "social", "airport")),
        F.coalesce(F.avg(F.when(yes, F.col("surge"))), F.lit(0.0)).alias("surge_accepted_mean"), F.ln(F.count("*").cast("double")).alias("log_n_decisions"),
        (-entropy).alias("action_entropy"),
    )
    fares = fare_percentiles(events.where(yes).select("rider_id", "quoted_fare"), market).groupBy("rider_id").agg(F.avg("fare_pctl").alias("_p"))
    out = base.join(fares, "rider_id", "left").withColumn("fare_pctl_accepted", F.coalesce("_p", F.lit(0.0))).drop("_p").join(run_lengths(events, order), "rider_id")
    return out.join(surge_slopes(events), "rider_id") if slopes else out
