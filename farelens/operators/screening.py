"""Screening of interventions: paired lifts, CUPED, resampling errors, power and back-tests."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farelens.functions import exprs as X
from farelens.functions import stats as S
from farelens.functions.rand import hash_uniform, numbered_hashes, replicate_sums

#: Intervention cells as (name, price multiplier, surge multiplier); control changes nothing.
CONTROL = ("control", 1.0, 1.0)
CELLS = (("price_-20", 0.8, 1.0), ("price_+25", 1.25, 1.0), ("price_+80", 1.8, 1.0), ("surge_2x", 1.0, 2.0), ("price_+25_surge_2x", 1.25, 2.0))
METRICS = ("accept_rate", "completed_rides", "mean_fare", "abandonment_rate")
PRIMARY = "accept_rate"
PRE_SPLIT = 0.5
Z_975 = NormalDist().inv_cdf(0.975)
MIN_PAIRS = 5
HIGH_BAND, LOW_BAND = (2.0, 3.0), (1.0, 1.2)


def with_cells(trace: DataFrame) -> DataFrame:
    """Rows of control and intervention cells with the cell's name."""
    cell = None
    for name, price, surge in (CONTROL, *CELLS):
        here = (F.col("price_mult") == price) & (F.col("surge_mult") == surge)
        cell = F.when(here, name) if cell is None else cell.when(here, name)
    return trace.withColumn("cell", cell).where("cell IS NOT NULL")


def pre_post_split(celled: DataFrame) -> DataFrame:
    """Adds ``period``: of a rider's offers in a cell, ordered by id, the first half (one at least) is 'pre'."""
    w = Window.partitionBy("cell", "rider_id")
    n_pre = F.greatest(F.lit(1), F.floor(F.count("*").over(w) * PRE_SPLIT))
    return celled.withColumn("period", F.when(F.row_number().over(w.orderBy("offer_id")) <= n_pre, "pre").otherwise("post"))


def rider_metrics(split: DataFrame) -> DataFrame:
    """Per cell, period and rider the four observed metrics; the mean fare of no rides is null."""
    rate = F.avg(F.col("accepted").cast("double"))
    return split.groupBy("cell", "period", "rider_id").agg(
        rate.alias("accept_rate"), F.sum("accepted").cast("double").alias("completed_rides"), F.avg(F.when(F.col("accepted") == 1, F.col("quoted_fare"))).alias("mean_fare"), (1.0 - rate).alias("abandonment_rate")
    )


def paired_deltas(metrics: DataFrame) -> DataFrame:
    """cell, rider_id, metric, delta (cell less control, post) and covariate (control, pre)."""
    unpack = lambda df: df.select("cell", "period", "rider_id", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS))).alias("m")).select("cell", "period", "rider_id", "m.*")
    long = unpack(metrics)
    key = ["rider_id", "metric"]
    post = long.where("period = 'post' AND cell <> 'control'").select("cell", *key, F.col("value").alias("treated"))
    control = long.where("cell = 'control'").groupBy(*key).agg(F.max(F.when(F.col("period") == "post", F.col("value"))).alias("control"), F.max(F.when(F.col("period") == "pre", F.col("value"))).alias("covariate"), F.max((F.col("period") == "post").cast("int")).alias("has_post"))
    return post.join(control.where("has_post = 1"), key).select("cell", *key, (F.col("treated") - F.col("control")).alias("delta"), "covariate")


def cell_lifts(deltas: DataFrame) -> DataFrame:
    """Per cell and metric over pairs with both numbers: lift, rider variance and CUPED.

    The adjustment keeps the mean, so the adjusted lift is the lift; its variance is what shrinks. Fewer
    than five pairs give nulls.
    """
    valid = deltas.where("delta IS NOT NULL AND covariate IS NOT NULL")
    g = valid.groupBy("cell", "metric").agg(
        F.count("*").alias("n"), F.avg("delta").alias("lift"), F.var_pop("delta").alias("var_delta"), F.var_pop("covariate").alias("var_x"), F.covar_samp("delta", "covariate").alias("cov"), F.covar_pop("delta", "covariate").alias("cov_pop")
    )
    usable = (F.col("var_x") > 0) & (F.col("var_delta") > 0) & (F.col("n") >= 3)
    theta = F.when(usable, F.try_divide("cov", "var_x")).otherwise(0.0)
    g = g.withColumn("theta", theta)
    adjusted = F.col("var_delta") - 2 * F.col("theta") * F.col("cov_pop") + F.col("theta") * F.col("theta") * F.col("var_x")
    enough = F.col("n") >= MIN_PAIRS
    out = g.select(
        "cell", "metric", "n", F.col("lift"), F.sqrt(F.col("var_delta") / F.col("n")).alias("se_rider"), "theta",
        F.when(usable, 1.0 - F.try_divide(adjusted, F.col("var_delta"))).otherwise(0.0).alias("cuped_var_reduction"), F.sqrt(F.greatest(adjusted, F.lit(0.0)) / F.col("n")).alias("se_rider_cuped"),
    )
    return out.select("cell", "metric", "n", *(F.when(enough, F.col(c)).alias(c) for c in out.columns[3:]))


def rider_bootstrap(deltas: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Per cell and metric the standard deviation and percentile interval of replicate lifts.

    Every rider is drawn on its own, once for all cells and metrics, with a Poisson count.
    """
    valid = deltas.where("delta IS NOT NULL AND covariate IS NOT NULL")
    riders = valid.groupBy("rider_id").agg(F.collect_list(F.struct("cell", "metric", F.col("delta").alias("s"))).alias("_e"))  # cells x metrics at most
    per = replicate_sums(riders, replicates, f"{seed}:riders", "rider_id", ("cell", "metric"), ("s",)).where("n > 0").withColumn("lift", F.col("s") / F.col("n"))
    return per.groupBy("cell", "metric").agg(F.stddev_pop("lift").alias("se_rider_boot"), F.percentile("lift", F.lit(0.025)).alias("lo"), F.percentile("lift", F.lit(0.975)).alias("hi"))


def sampling_errors(split: DataFrame) -> DataFrame:
    """Closed form of the decisions' own noise in the accept rate: per cell sqrt(mean variance / riders)."""
    per = split.where("period = 'post'").groupBy("cell", "rider_id").agg((F.sum(F.col("p_accept") * (1 - F.col("p_accept"))) / F.pow(F.count("*"), F.lit(2.0))).alias("v"))
    control = per.where("cell = 'control'").select("rider_id", F.col("v").alias("vc"))
    return per.where("cell <> 'control'").join(control, "rider_id").groupBy("cell").agg(F.sqrt(F.avg(F.col("v") + F.col("vc")) / F.count("*")).alias("se_sampling"))


def bernoulli_redraws(split: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Per cell, rider and replicate the four metrics of redrawn decisions (post period)."""
    drawn = split.where("period = 'post'").withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    hit = (hash_uniform(f"{seed}:draw", F.concat_ws(":", "replicate", "cell", "offer_id")) < F.col("p_accept")).cast("double")
    return drawn.withColumn("hit", hit).groupBy("cell", "rider_id", "replicate").agg(F.avg("hit").alias("accept_rate"), F.sum("hit").alias("completed_rides"), F.avg(F.when(F.col("hit") == 1, F.col("quoted_fare"))).alias("mean_fare"), (1.0 - F.avg("hit")).alias("abandonment_rate"))


#: Decisions whose redraws of all replicates a task holds at once.
REDRAWN_ROWS = 4096


def redraw_totals(split: DataFrame, replicates: int, seed: int) -> DataFrame:
    """``bernoulli_redraws`` added up over the riders: per cell and replicate the sum of each of the four metrics.

    A rider's decisions of a cell stand in one row, and tasks redraw and add them up, all replicates at once: what is shuffled
    afterwards is tasks x cells x replicates, not riders x replicates.
    """
    drawn = split.where("period = 'post' AND p_accept IS NOT NULL").groupBy("cell", "rider_id").agg(F.collect_list(F.struct("offer_id", "p_accept", "quoted_fare")).alias("_e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}  # per cell: the four sums, and the riders with a mean fare
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            at = 0
            while at < batch.num_rows:
                n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + REDRAWN_ROWS]), REDRAWN_ROWS, side="right")))
                part = batch.slice(at, n)
                at += n
                told, count = part.column(1).flatten(), sizes[at - n : at]
                first = np.concatenate(([0], np.cumsum(count)[:-1]))
                cells = part.column(0).to_pylist()
                tails = [f":{c}:{o}".encode() if o is not None else f":{c}".encode() for c, o in zip(np.repeat(np.array(cells, dtype=object), count), told.field("offer_id").to_pylist(), strict=True)]
                chance = told.field("p_accept").cast(pa.float64()).to_numpy(zero_copy_only=False) * 4294967296.0
                fare = told.field("quoted_fare").cast(pa.float64()).to_numpy(zero_copy_only=False)
                hit = numbered_hashes(f"{seed}:draw:", replicates, tails) < chance[:, None]
                rides = np.add.reduceat(hit, first, axis=0, dtype=np.float64)
                priced = ~np.isnan(fare)
                paid = np.add.reduceat(np.where(hit, np.where(priced, fare, 0.0)[:, None], 0.0), first, axis=0)
                rated = rides if priced.all() else np.add.reduceat(hit & priced[:, None], first, axis=0, dtype=np.float64)
                rate, some = rides / count[:, None], rated > 0
                sums = np.stack([rate, rides, np.divide(paid, rated, out=np.zeros_like(paid), where=some), 1.0 - rate, some])
                named = np.array(cells)
                for cell in np.unique(named):
                    mine = sums[:, named == cell].sum(axis=1)
                    found[cell] = found[cell] + mine if cell in found else mine
        for cell, sums in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([str(cell)] * replicates), pa.array(np.arange(1, replicates + 1, dtype=np.int32)), *map(pa.array, sums)], names=["cell", "replicate", *METRICS, "riders"])

    partial = drawn.select("cell", "_e").mapInArrow(run, "cell string, replicate int, " + ", ".join(f"{m} double" for m in (*METRICS, "riders")))
    sums = partial.groupBy("cell", "replicate").agg(*(F.sum(c).alias(c) for c in (*METRICS, "riders")))
    return sums.withColumn("mean_fare", F.when(F.col("riders") > 0, F.col("mean_fare"))).drop("riders")


def redraw_errors(split: DataFrame, replicates: int, seed: int) -> DataFrame:
    """The sampling error of the accept-rate lift by redraws."""
    r = bernoulli_redraws(split, replicates, seed).select("cell", "rider_id", "replicate", "accept_rate")
    control = r.where("cell = 'control'").select("rider_id", "replicate", F.col("accept_rate").alias("c"))
    per = r.where("cell <> 'control'").join(control, ["rider_id", "replicate"]).groupBy("cell", "rider_id").agg(F.var_pop(F.col("accept_rate") - F.col("c")).alias("v"))
    return per.groupBy("cell").agg(F.sqrt(F.avg("v") / F.count("*")).alias("se_sampling_draws"))


def metric_errors(split: DataFrame, deltas: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Per cell and metric the sampling error over the riders with both numbers.

    Rates and rides have closed forms; the mean fare, whose number of rides is drawn, has redraws (0 for a
    rider without any).
    """
    n, noise = F.count("*"), F.sum(F.col("p_accept") * (1 - F.col("p_accept")))
    closed = split.where("period = 'post'").groupBy("cell", "rider_id").agg((noise / F.pow(n, F.lit(2.0))).alias("rate"), noise.alias("rides"))
    long = closed.select("cell", "rider_id", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col("rides" if m == "completed_rides" else "rate").alias("v")) for m in METRICS if m != "mean_fare"))).alias("m")).select("cell", "rider_id", "m.*")
    control = long.where("cell = 'control'").select("rider_id", "metric", F.col("v").alias("vc"))
    exact = long.where("cell <> 'control'").join(control, ["rider_id", "metric"]).select("cell", "rider_id", "metric", (F.col("v") + F.col("vc")).alias("v"))
    fares = bernoulli_redraws(split, replicates, seed).select("cell", "rider_id", "replicate", "mean_fare")
    base = fares.where("cell = 'control'").select("rider_id", "replicate", F.col("mean_fare").alias("c"))
    drawn = fares.where("cell <> 'control'").join(base, ["rider_id", "replicate"]).groupBy("cell", "rider_id").agg(F.coalesce(F.var_pop(F.col("mean_fare") - F.col("c")), F.lit(0.0)).alias("v"))
    each = exact.unionByName(drawn.select("cell", "rider_id", F.lit("mean_fare").alias("metric"), "v"))
    valid = deltas.where("delta IS NOT NULL AND covariate IS NOT NULL").select("cell", "rider_id", "metric")
    return each.join(valid, ["cell", "rider_id", "metric"]).groupBy("cell", "metric").agg(F.sqrt(F.avg("v") / F.count("*")).alias("se_sampling"))


def _with_intervals(lifts: DataFrame) -> DataFrame:
    total = F.sqrt(F.col("se_rider") * F.col("se_rider") + F.col("se_sampling") * F.col("se_sampling"))
    cuped = F.sqrt(F.col("se_rider_cuped") * F.col("se_rider_cuped") + F.col("se_sampling") * F.col("se_sampling"))
    out = lifts.withColumns({"se_total": total, "se_cuped": cuped})
    return out.withColumns({"ci_low": F.col("lift") - Z_975 * F.col("se_total"), "ci_high": F.col("lift") + Z_975 * F.col("se_total"), "cuped_ci_low": F.col("lift") - Z_975 * F.col("se_cuped")})


def screen_metrics(trace: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Every cell and metric: lift, sampling and total error, interval and CUPED interval; nulls under five pairs."""
    split = pre_post_split(with_cells(trace))
    deltas = paired_deltas(rider_metrics(split))
    out = _with_intervals(cell_lifts(deltas).join(metric_errors(split, deltas, replicates, seed), ["cell", "metric"], "left"))
    out = out.withColumn("se_sampling", F.when(F.col("n") >= MIN_PAIRS, F.col("se_sampling")))
    return out.withColumn("cuped_ci_high", F.col("lift") + Z_975 * F.col("se_cuped"))


def screen(trace: DataFrame) -> DataFrame:
    """All cells ranked by lift: total error, intervals and the recommendation."""
    split = pre_post_split(with_cells(trace))
    lifts = cell_lifts(paired_deltas(rider_metrics(split))).where(F.col("metric") == PRIMARY).join(sampling_errors(split), "cell")
    out = _with_intervals(lifts)
    low = F.when(F.col("cuped_var_reduction") > 0, F.col("cuped_ci_low")).otherwise(F.col("ci_low"))
    out = out.withColumn("screen_in", F.coalesce(low > 0, F.lit(False)))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.col("lift").desc_nulls_last(), "cell")).cast("long"))  # as many rows as cells


def recommend(ranked: DataFrame, backtest_verdict: Column) -> DataFrame:
    """Cells that touch surge are vetoed when the back-test fails."""
    veto = F.col("cell").contains("surge") & (backtest_verdict == "FAIL")
    return ranked.withColumn("recommendation", F.when(veto, "veto").when(F.col("screen_in"), "screen_in").otherwise("hold"))


def sample_size(p0: Column, p1: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Two-proportion sample size per arm; null for no effect."""
    za, zb = NormalDist().inv_cdf(1 - alpha / 2), NormalDist().inv_cdf(power)
    mean = (p0 + p1) / 2.0
    top = F.lit(za) * F.sqrt(2.0 * mean * (1.0 - mean)) + F.lit(zb) * F.sqrt(p0 * (1.0 - p0) + p1 * (1.0 - p1))
    return F.ceil(F.try_divide(top * top, (p1 - p0) * (p1 - p0))).cast("long")


def daily_volume(raw: DataFrame) -> DataFrame:
    """One row per month: requests, and requests a day in whole numbers."""
    month = F.date_trunc("month", F.col("request_datetime").cast("timestamp"))
    per = raw.groupBy(month.alias("m")).agg(F.count("*").alias("n"))
    return per.select(F.date_format("m", "yyyy-MM").alias("month"), "n", F.floor(F.col("n") / F.day(F.last_day("m"))).cast("long").alias("daily"))


def power_table(effects: DataFrame, daily: Column, share: float = 0.5) -> DataFrame:
    """For rows (name, control_rate, lift): clamped rates, size per arm, and days at ``share`` of daily volume."""
    out = effects.withColumns({"p0": X.clamp_probability(F.col("control_rate")), "p1": X.clamp_probability(F.col("control_rate") + F.col("lift"))}).withColumn("_daily", daily)
    out = out.withColumn("n_per_arm", sample_size(F.col("p0"), F.col("p1")))
    return out.withColumn("days", X.rounded(F.try_divide(F.col("n_per_arm"), F.col("_daily") * share), 2)).drop("_daily")


def control_rate(trace: DataFrame) -> DataFrame:
    return trace.where("price_mult = 1 AND surge_mult = 1").agg(F.avg(F.col("accepted").cast("double")).alias("control_rate"))


def effects_of(ranked: DataFrame, trace: DataFrame) -> DataFrame:
    return ranked.select(F.col("cell").alias("name"), "lift").withColumn("control_rate", control_rate(trace).scalar())


def real_demand(trips: DataFrame, high: tuple = HIGH_BAND, low: tuple = LOW_BAND) -> DataFrame:
    """One row: trips and shares in both surge bands, and their log ratio."""
    r = trips.agg(F.count("*").alias("n_total"), F.count_if(X.in_band("surge_ratio", high)).alias("n_high"), F.count_if(X.in_band("surge_ratio", low)).alias("n_low"))
    share = lambda c: F.try_divide(F.col(c), F.col("n_total"))
    return r.select("*", share("n_high").alias("share_high"), share("n_low").alias("share_low")).withColumn("log_ratio", F.when((F.col("n_high") > 0) & (F.col("n_low") > 0), F.ln(F.try_divide("share_high", "share_low"))))


def _band_sums(trace: DataFrame, high: tuple, low: tuple, weight: Column) -> list[Column]:
    one = lambda band, c: F.sum(F.when(X.in_band("surge", band), c * weight).otherwise(0))
    return [one(high, F.lit(1)).alias("n_high"), one(low, F.lit(1)).alias("n_low"), one(high, F.col("accepted")).alias("k_high"), one(low, F.col("accepted")).alias("k_low")]


def _log_ratio() -> Column:
    return F.ln(S.laplace_rate(F.col("k_high"), F.col("n_high")) / S.laplace_rate(F.col("k_low"), F.col("n_low")))


def simulated_demand(trace: DataFrame, high: tuple = HIGH_BAND, low: tuple = LOW_BAND) -> DataFrame:
    """One row: decisions in both bands and the log ratio of smoothed acceptance; null under five in a band."""
    s = trace.agg(*_band_sums(trace, high, low, F.lit(1)))
    return s.select("n_high", "n_low", F.when((F.col("n_high") >= 5) & (F.col("n_low") >= 5), _log_ratio()).alias("log_ratio"))


#: The chance that a bootstrap of riders draws a given rider at all.
DRAWN_AT_ALL = 1.0 - 0.36787944117144233


def demand_replicates(trace: DataFrame, replicates: int, seed: int, dedup: bool = False, high: tuple = HIGH_BAND, low: tuple = LOW_BAND) -> DataFrame:
    """Rider bootstrap of the simulated log ratio. ``dedup`` counts a drawn rider once, however often drawn.

    Riders' band sums come first, so replicates multiply riders and not decisions; every rider is drawn on its own.
    """
    sums = ("n_high", "n_low", "k_high", "k_low")
    riders = trace.groupBy("rider_id").agg(*_band_sums(trace, high, low, F.lit(1))).select("rider_id", F.array(F.struct(*sums)).alias("_e"))
    totals = replicate_sums(riders, replicates, f"{seed}:backtest", "rider_id", (), sums, once=dedup)
    plain = simulated_demand(trace, high, low).select("log_ratio").scalar()
    return totals.withColumn("_p", plain).select(F.col("replicate").cast("long").alias("replicate"), F.when((F.col("n_high") > 0) & (F.col("n_low") > 0), _log_ratio()).otherwise(F.col("_p")).alias("log_ratio"))


def backtest(trace: DataFrame, trips: DataFrame, replicates: int, seed: int, dedup: bool = False) -> DataFrame:
    """One row: real and simulated log ratios, interval, signed error and verdict."""
    ci = demand_replicates(trace, replicates, seed, dedup).agg(F.percentile("log_ratio", F.lit(0.025)).alias("lo"), F.percentile("log_ratio", F.lit(0.975)).alias("hi"))
    row = real_demand(trips).select(F.col("log_ratio").alias("real")).withColumns({"sim": simulated_demand(trace).select("log_ratio").scalar(), "ci_low": ci.select("lo").scalar(), "ci_high": ci.select("hi").scalar()})
    row = row.withColumn("signed_error", F.col("sim") - F.col("real"))
    row = row.withColumns({"direction_agrees": F.coalesce(F.col("sim") * F.col("real") > 0, F.lit(False)), "ci_covers_real": F.coalesce(F.col("real").between(F.col("ci_low"), F.col("ci_high")), F.lit(False))})
    return row.withColumn("verdict", F.when(F.col("direction_agrees") & F.col("ci_covers_real"), "PASS").when(F.col("direction_agrees"), "PARTIAL").otherwise("FAIL"))


def gate_checks(metrics: DataFrame, baselines: DataFrame) -> DataFrame:
    """Three rows: AUC inside its band, marginals at the floor, elasticity sign equal.

    ``metrics`` and ``baselines`` are one row each: (discriminator_auc, ks_passed, elasticity_sign) and
    (discriminator_auc, discriminator_auc_tolerance, min_ks_marginals_passed, elasticity_sign).
    """
    m = metrics.select(F.struct("discriminator_auc", "ks_passed", "elasticity_sign").alias("m"))
    joined = m.withColumn("b", baselines.select(F.struct("discriminator_auc", "discriminator_auc_tolerance", "min_ks_marginals_passed", "elasticity_sign")).scalar())
    auc_ok = F.abs(F.col("m.discriminator_auc") - F.col("b.discriminator_auc")) <= F.col("b.discriminator_auc_tolerance")
    checks = F.array(
        F.struct(F.lit("discriminator AUC").alias("check"), auc_ok.alias("passed")), F.struct(F.lit("KS marginals passed").alias("check"), (F.col("m.ks_passed") >= F.col("b.min_ks_marginals_passed")).alias("passed")),
        F.struct(F.lit("elasticity sign").alias("check"), (F.col("m.elasticity_sign") == F.col("b.elasticity_sign")).alias("passed")),
    )
    return joined.select(F.explode(checks).alias("c")).select("c.*")


def table_of_cells(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([CONTROL, *CELLS], "cell string, price_mult double, surge_mult double")
