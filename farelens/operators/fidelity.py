"""Fidelity of simulated decisions: calibration, distributions, elasticity, permutation tests."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farelens.functions import exprs as X
from farelens.functions import stats as S
from farelens.functions.rand import cell_draws, dealt_out, hash_order, replicate_sums
from farelens.operators import boosting
from farelens.sources.staging import discard, materialize

#: Number of surge bands, least segment, the tested marginals, and the published elasticity range.
BANDS = 8
MIN_SEGMENT = 4
MARGINALS = ("accepted_fare", "accepted_wait", "accept_rate_by_hour", "purpose_mix")
_DRAWN = ("accepted_fare", "accepted_wait", "purpose_mix")
ALPHA = 0.05 / len(MARGINALS)
ELASTICITY_RANGE = (-0.6, -0.4)
#: Sample size up to which the KS p-value counts paths.
EXACT_KS = 10_000


def labeled_offers(trace: DataFrame) -> DataFrame:
    """Base offers (accepted by construction) and their reject counterfactuals."""
    return trace.where("is_base OR reject_counterfactual").withColumn("label", F.col("is_base").cast("long"))


def tercile_labels(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds low/mid/high by the column's own third quantiles over all rows."""
    cuts = S.global_quantiles(df, value, [1 / 3, 2 / 3])
    cut = cuts.select(F.struct("q0", "q1")).scalar()
    return df.withColumn("_cut", cut).withColumn(name, F.when(F.col(value) <= F.col("_cut.q0"), "low").when(F.col(value) > F.col("_cut.q1"), "high").otherwise("mid")).drop("_cut")


def segmented(labeled: DataFrame) -> DataFrame:
    """Each labeled offer once for the whole and once per segmentation: one pass for all segments."""
    t = tercile_labels(tercile_labels(labeled, "price_sensitivity", "_ps"), "wait_tolerance_minutes", "_wt")
    segments = F.array(
        F.lit("overall"), F.concat(F.lit("price_sensitivity="), "_ps"), F.concat(F.lit("wait_tolerance_minutes="), "_wt"),
        F.concat(F.lit("has_transit_alternative="), F.when(F.col("has_transit_alternative"), "True").otherwise("False")),
    )
    return t.withColumn("segment", F.explode(segments)).drop("_ps", "_wt")


def brier(labeled: DataFrame) -> DataFrame:
    return labeled.agg(F.avg(F.pow(F.col("p_accept") - F.col("label"), 2)).alias("brier"), F.count("*").alias("n"))


def brier_by_segment(labeled: DataFrame) -> DataFrame:
    per = segmented(labeled).groupBy("segment").agg(F.avg(F.pow(F.col("p_accept") - F.col("label"), 2)).alias("brier"), F.count("*").alias("n"))
    return per.where(f"segment <> 'overall' AND n >= {MIN_SEGMENT}")


def reliability_curve(labeled: DataFrame, n_bins: int = 10) -> DataFrame:
    """Observed and predicted mean per non-empty uniform bin and segment; bins are right-closed.

    As many bins as half the rows, 2 at least and ``n_bins`` at most; a segment needs two rows per bin.
    """
    total = labeled.agg(F.count("*").alias("n")).scalar()
    bins = F.greatest(F.lit(2), F.least(F.lit(n_bins), F.floor(total / 2)))
    s = segmented(labeled).withColumn("bins", bins.cast("int"))
    inner = F.transform(F.sequence(F.lit(1), F.col("bins") - 1), lambda k: k / F.col("bins"))
    s = s.withColumn("bin", F.size(F.filter(inner, lambda e: e < F.col("p_accept"))))
    per = s.groupBy("segment", "bin").agg(F.avg(F.col("label").cast("double")).alias("observed"), F.avg("p_accept").alias("predicted"), F.count("*").alias("n"), F.first("bins").alias("bins"))
    size = F.sum("n").over(Window.partitionBy("segment"))
    return per.withColumn("size", size).where((F.col("segment") == "overall") | (F.col("size") >= 2 * F.col("bins"))).select("segment", F.col("bin").cast("long").alias("bin"), "observed", "predicted", "n")


def matched_sample(real: DataFrame, n: Column | int, seed: int, key: str) -> DataFrame:
    """As many real rows as there are simulated ones, by smallest hash; ``n`` may be a scalar subquery.

    Rows are numbered range by range of their hash, so no task orders the whole table.
    """
    numbered = real.withColumns({"_order": hash_order(seed, key), "_one": F.lit(1)})
    ranked = S.running_sums(numbered, "_order", ["_one"], ties=(key,))
    return ranked.withColumn("_n", n if isinstance(n, Column) else F.lit(n)).where(F.col("cum__one") <= F.col("_n")).select(*real.columns)


def purpose_order(real: DataFrame) -> DataFrame:
    """Purposes by falling frequency, name on ties (at most four rows)."""
    counted = real.groupBy("purpose").agg(F.count("*").alias("n"))
    return counted.select("purpose", (F.row_number().over(Window.orderBy(F.desc("n"), "purpose")) - 1).cast("long").alias("rank"))


def accept_rate_by_hour(trace: DataFrame) -> DataFrame:
    return trace.groupBy("pickup_hour").agg(F.avg(F.col("accepted").cast("double")).alias("accept_rate"), F.count("*").alias("n"))


def ks_p_value(d: float | None, n: int, m: int) -> float | None:
    """Two-sided p-value: the share of lattice paths that reach the distance, exact up to EXACT_KS values in a
    sample; Kolmogorov's series beyond, where both agree to three digits."""
    if d is None:
        return None
    if max(n, m) <= EXACT_KS:
        i = np.arange(n + 1)
        inside, bound = np.zeros(n + 1), d - 1e-12  # of the points (i, s - i) of one diagonal: the share of paths that stay inside
        inside[0] = 1.0
        for s in range(1, n + m + 1):
            j = s - i
            inside = np.concatenate(([0.0], inside[:-1])) * (i / s) + inside * (np.maximum(j, 0) / s)
            inside[(j < 0) | (j > m) | (np.abs(i / n - j / m) >= bound)] = 0.0
        return float(min(1.0, max(0.0, 1.0 - inside[n])))
    x = d * math.sqrt(n * m / (n + m))
    if x < 1e-6:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def distribution_statistics(trace: DataFrame, real: DataFrame, seed: int, key: str = "tk") -> DataFrame:
    """The four marginals' KS statistics and sample sizes.

    Of the three marginals over rows as many real ones as simulated ones are taken, by smallest hash of the
    marginal's own seed; hashes are uniform, so rows are numbered inside equal ranges of them. All marginals are
    counted in one pass (marginal, value) and ranked together.
    """
    sim, order = trace.where("accepted = 1"), purpose_order(real)
    placed = lambda df: df.join(F.broadcast(order), "purpose")  # noqa: E731  four rows
    values = lambda: [F.col(c).cast("double") for c in ("quoted_fare", "eta_min", "rank")]
    n_sim = sim.agg(F.count("*").alias("n")).scalar()
    drawn = placed(real).select(key, F.explode(F.array(*(F.struct(F.lit(m).alias("marginal"), v.alias("v"), hash_order(seed + k, key).alias("hash")) for k, (m, v) in enumerate(zip(_DRAWN, values(), strict=True))))).alias("x")).select(key, "x.*")
    drawn = drawn.withColumn("_range", F.floor(F.col("hash") / F.lit(float(2**32 // S.ranges_of(real)))).cast("int"))
    sizes = drawn.groupBy("marginal", "_range").agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("marginal").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("marginal", "_range").orderBy("hash", key))
    taken = drawn.withColumn("_k", place).join(F.broadcast(sizes), ["marginal", "_range"]).withColumn("_want", n_sim).where(F.col("_k") + F.col("_before") <= F.col("_want"))
    simulated = placed(sim).select(F.explode(F.array(*(F.struct(F.lit(m).alias("marginal"), v.alias("v")) for m, v in zip(_DRAWN, values(), strict=True)))).alias("x")).select("x.*")
    hours = accept_rate_by_hour(real).select("pickup_hour", F.col("accept_rate").alias("real_rate")).join(accept_rate_by_hour(trace), "pickup_hour")
    hours = hours.select(F.explode(F.array(F.struct(F.col("real_rate").alias("v"), F.lit(1).alias("s")), F.struct(F.col("accept_rate").alias("v"), F.lit(0).alias("s")))).alias("x")).select(F.lit("accept_rate_by_hour").alias("marginal"), "x.*")
    both = taken.select("marginal", "v", F.lit(1).alias("s")).unionByName(simulated.withColumn("s", F.lit(0))).unionByName(hours).where("v IS NOT NULL")
    counted = materialize(both.groupBy("marginal", "v").agg(F.sum("s").alias("a"), F.sum(1 - F.col("s")).alias("b")), "marginals")
    ranked = S.grouped_running(counted, ["marginal"], "v", "a", "b")
    distance = F.abs(F.try_divide("cum_a", "all_a") - F.try_divide("cum_b", "all_b"))
    per = ranked.groupBy("marginal").agg(F.max(distance).alias("d"), F.max("all_a").alias("n_real"), F.max("all_b").alias("n_sim"))
    every = trace.sparkSession.createDataFrame([(m,) for m in MARGINALS], "marginal string").join(per, "marginal", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_real", "n_sim")})
    return every.select("marginal", F.when((F.col("n_real") >= 5) & (F.col("n_sim") >= 5), F.col("d")).alias("statistic"), "n_real", "n_sim")


def distribution_tests(trace: DataFrame, real: DataFrame, seed: int, key: str = "tk") -> DataFrame:
    """Adds p-values (four rows pass the driver) and Bonferroni verdicts."""
    rows = distribution_statistics(trace, real, seed, key).collect()
    out = []
    for r in rows:
        p = ks_p_value(r["statistic"], r["n_real"], r["n_sim"])
        out.append((r["marginal"], r["statistic"], p, ALPHA, p is not None and p >= ALPHA))
    return trace.sparkSession.createDataFrame(out, "marginal string, statistic double, p_value double, bonferroni_alpha double, passed boolean")


def surge_bands(trace: DataFrame) -> DataFrame:
    """Eight quantile bands of surge: mean surge, rows, and smoothed acceptance."""
    probs = [k / BANDS for k in range(BANDS + 1)]
    edges = S.global_quantiles(trace, "surge", probs)
    placed = trace.select("surge", "accepted").withColumn("_e", edges.select(F.array(*(f"q{k}" for k in range(BANDS + 1)))).scalar())
    band = F.greatest(F.lit(1), F.least(F.lit(BANDS), F.size(F.filter("_e", lambda e: e < F.col("surge")))))
    per = placed.withColumn("band", band.cast("long")).groupBy("band").agg(F.avg("surge").alias("mean_surge"), F.count("*").alias("n"), F.sum("accepted").alias("k"))
    return per.select("band", "mean_surge", "n", S.laplace_rate(F.col("k"), F.col("n")).alias("rate"))


def surge_elasticity(trace: DataFrame) -> DataFrame:
    """One row: the log-log slope of the bands' acceptance on surge."""
    return S.log_log_slope(surge_bands(trace), "mean_surge", "rate", "elasticity")


def elasticity_replicates(trace: DataFrame, replicates: int, seed: int, key: str = "offer_id") -> DataFrame:
    """The slope of each bootstrap replicate: fixed bands, every decision drawn on its own with a Poisson count.

    Decisions are told apart by ``key``; in a trace without it, equal decisions are numbered.
    """
    edges = S.global_quantiles(trace, "surge", [k / BANDS for k in range(BANDS + 1)])
    if key not in trace.columns:
        numbered = trace.groupBy("surge", "accepted").agg(F.count("*").alias("_m")).withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), "_m")))
        trace = numbered.withColumn(key, F.concat_ws(":", F.col("surge").cast("string"), F.col("accepted").cast("string"), F.col("_k").cast("string")))
    placed = trace.select(key, "surge", "accepted").withColumn("_e", edges.select(F.array(*(f"q{k}" for k in range(BANDS + 1)))).scalar())
    band = F.greatest(F.lit(1), F.least(F.lit(BANDS), F.size(F.filter("_e", lambda e: e < F.col("surge")))))
    rows = placed.select(key, F.array(F.struct(band.alias("band"), F.col("surge").alias("s"), F.col("accepted").alias("k"))).alias("_e"))
    sums = replicate_sums(rows, replicates, f"{seed}:boot", key, ("band",), ("s", "k"))
    pts = sums.where("n > 0").select("replicate", F.ln(F.col("s") / F.col("n")).alias("x"), F.ln(S.laplace_rate(F.col("k"), F.col("n"))).alias("y"))
    per = pts.groupBy("replicate").agg(F.regr_slope("y", "x").alias("slope"), F.count("*").alias("n"), F.countDistinct(F.round(F.col("x") * 1000.0)).alias("k"))
    return per.where("n >= 3 AND k >= 3").select(F.col("replicate").cast("long").alias("replicate"), "slope")


def elasticity_report(trace: DataFrame, replicates: int, seed: int) -> DataFrame:
    """One row: slope, percentile interval, sign and magnitude verdicts."""
    ci = elasticity_replicates(trace, replicates, seed).agg(F.percentile("slope", F.lit(0.025)).alias("lo"), F.percentile("slope", F.lit(0.975)).alias("hi"))
    row = surge_elasticity(trace).withColumns({"ci_low": ci.select("lo").scalar(), "ci_high": ci.select("hi").scalar()})
    sign, magnitude = F.col("elasticity") < 0, (F.col("ci_low") <= ELASTICITY_RANGE[1]) & (F.col("ci_high") >= ELASTICITY_RANGE[0])
    row = row.withColumns({"sign_pass": F.coalesce(sign, F.lit(False)), "magnitude_pass": F.coalesce(magnitude, F.lit(False))})
    return row.withColumn("verdict", F.when(F.col("sign_pass") & F.col("magnitude_pass"), "PASS").otherwise("FAIL"))


#: Bits of a permutation's hash that one pass of the selection counts.
DIGITS = (8, 12, 12)


def permutation_test(scores: DataFrame, permutations: int, seed: int) -> DataFrame:
    """Pairs of configurations with the AUC difference and its permutation p-value.

    ``scores``: config, item, is_real, score. Real scores are those of the pair's first configuration. A permutation deals the
    pair's simulated items by hash: the n with the lowest hashes (item on ties) take the first configuration's place.

    An item's real scores below it do not change between permutations, so every score is ranked once per
    configuration of reals, and a permutation's AUC is a sum over the items below its n-th hash. That hash is selected by its
    bits, all pairs and permutations at once: counts and sums per leading digit find the digit that holds
    the n-th, those per next digit the next, until it is exact. Nothing is sorted within a permutation; a
    table of the selection holds configurations x permutations x digits rows at most, whatever the number of items.
    """
    scores = materialize(scores.select("config", "item", "is_real", "score"), "permutation-scores")  # read five times
    names = sorted(r["config"] for r in scores.select("config").distinct().collect())  # a handful of named configurations
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :]]
    spark = scores.sparkSession
    schema = "config_a string, config_b string, auc_difference double, p_value double"
    if not pairs:
        return spark.createDataFrame([], schema)
    # twice the number of real scores below (ties one half), for each configuration of reals that a simulated item can meet
    values = scores.groupBy("config", "score").agg(F.count_if("is_real").alias("r"), F.count_if(~F.col("is_real")).alias("s"))
    first = F.explode(F.when(F.col("s") > 0, F.array(*(F.lit(n) for n in names))).otherwise(F.array("config"))).alias("config_a")
    met = values.select(first, "config", "score", "r").select("config_a", "score", F.when(F.col("config") == F.col("config_a"), F.col("r")).otherwise(0).alias("r"))
    ranked = S.grouped_running(materialize(met.groupBy("config_a", "score").agg(F.sum("r").alias("r")), "met-scores"), ["config_a"], "score", "r")
    below = ranked.groupBy("score").pivot("config_a", names).agg(F.max(2 * F.col("cum_r") - F.col("r")))
    below = below.select("score", F.array(*(F.coalesce(F.col(f"`{n}`"), F.lit(0)) for n in names)).alias("below"))
    sims = materialize(scores.where("NOT is_real").select("config", F.concat_ws("/", "config", "item").alias("item"), "score").join(below, "score", "left").select("config", "item", "below"), "permuted")
    sizes = {r["config"]: (r["sims"], r["reals"]) for r in scores.groupBy("config").agg(F.count_if(~F.col("is_real")).alias("sims"), F.count_if("is_real").alias("reals")).collect()}
    # how many items the first configuration of a pair has, and what a permutation's sum is compared with
    plain = spark.createDataFrame([(a, b, names.index(a), *(sizes[a][0], sizes[b][0], sizes[a][1])) for a, b in pairs], "config_a string, config_b string, a int, n_a long, n_b long, n_r long")
    totals = sims.groupBy("config").agg(F.array(*(F.sum(F.col("below")[k]) for k in range(len(names)))).alias("total"))
    of = lambda side: totals.select(F.col("config").alias(f"config_{side}"), F.col("total").alias(f"_{side}"))
    plain = plain.join(F.broadcast(of("a")), "config_a", "left").join(F.broadcast(of("b")), "config_b", "left")
    at = lambda c: F.coalesce(F.element_at(c, F.col("a") + 1), F.lit(0))
    plain = plain.select("config_a", "config_b", "a", "n_a", "n_b", "n_r", at("_a").alias("sum_a"), at("_b").alias("sum_b"))
    dealt = _dealt(sims, permutations, seed)
    chosen = None
    for level, bits in enumerate(DIGITS):
        shift = sum(DIGITS[level + 1 :])
        digit = F.shiftright("h", shift).bitwiseAND((1 << bits) - 1)
        if chosen is None:  # the first digit of all items, once per configuration; pairs add two configurations up
            count = dealt.groupBy("config", "perm", digit.alias("digit")).agg(F.count("*").alias("n"), *(F.sum(F.col("below")[k]).alias(f"_{k}") for k in range(len(names))))
            count = materialize(count.select("config", "perm", "digit", "n", F.array(*(f"_{k}" for k in range(len(names)))).alias("sums")), "permuted-digits")
            sides = plain.select("config_a", "config_b", "a", F.explode(F.array("config_a", "config_b")).alias("config"))
            per = count.join(F.broadcast(sides), "config").groupBy("config_a", "config_b", "perm", "digit").agg(F.sum("n").alias("n"), F.sum(F.element_at("sums", F.col("a") + 1)).alias("s"))
            want = per.join(F.broadcast(plain.select("config_a", "config_b", F.col("n_a").alias("k"))), ["config_a", "config_b"]).withColumns({"prefix": F.lit(0).cast("long"), "taken": F.lit(0).cast("long")})
        else:  # only items whose leading digits are those of the n-th
            sides = chosen.select("config_a", "config_b", "perm", "prefix", "k", "taken", "a", F.explode(F.array("config_a", "config_b")).alias("config"))
            met = dealt.withColumn("prefix", F.shiftright("h", shift + bits)).join(F.broadcast(sides), ["config", "perm", "prefix"])
            want = met.groupBy("config_a", "config_b", "perm", "prefix", "k", "taken", digit.alias("digit")).agg(F.count("*").alias("n"), F.sum(F.element_at("below", F.col("a") + 1)).alias("s"))
        upto = Window.partitionBy("config_a", "config_b", "perm").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)  # a row for each digit
        cut = want.withColumns({"_n": F.sum("n").over(upto), "_s": F.sum("s").over(upto)}).where((F.col("_n") >= F.col("k")) & (F.col("_n") - F.col("n") < F.col("k")))
        cut = cut.select("config_a", "config_b", "perm", (F.shiftleft("prefix", bits) + F.col("digit")).alias("prefix"), (F.col("k") - (F.col("_n") - F.col("n"))).alias("k"), (F.col("taken") + F.col("_s") - F.col("s")).alias("taken"), "n", "s")
        chosen = materialize(cut.join(F.broadcast(plain.select("config_a", "config_b", "a")), ["config_a", "config_b"]), "permuted-cut")
    # items of the very hash of the n-th: all of them, or the first by name where several share it
    whole = chosen.where("k = n").select("config_a", "config_b", "perm", (F.col("taken") + F.col("s")).alias("sum"))
    sides = chosen.where("k < n").select("config_a", "config_b", "perm", F.col("prefix").alias("h"), "k", "taken", "a", F.explode(F.array("config_a", "config_b")).alias("config"))
    shared = dealt.join(F.broadcast(sides), ["config", "perm", "h"]).withColumn("_k", F.row_number().over(Window.partitionBy("config_a", "config_b", "perm").orderBy("item"))).where("_k <= k")
    shared = shared.groupBy("config_a", "config_b", "perm").agg((F.max("taken") + F.sum(F.element_at("below", F.col("a") + 1))).alias("sum"))
    sums = whole.unionByName(shared).unionByName(plain.select("config_a", "config_b", F.lit(0).alias("perm"), F.col("sum_a").alias("sum")))
    every = sums.join(F.broadcast(plain), ["config_a", "config_b"])
    mean = lambda s, n: F.try_divide(s, 2.0 * F.col(n) * F.col("n_r"))
    diff = F.round(F.abs(mean(F.col("sum"), "n_a") - mean(F.col("sum_a") + F.col("sum_b") - F.col("sum"), "n_b")) * 1e9) / 1e9
    observed = F.max(F.when(F.col("perm") == 0, F.col("diff"))).over(Window.partitionBy("config_a", "config_b"))  # a row for each permutation
    judged = every.withColumn("diff", diff).withColumn("observed", observed).groupBy("config_a", "config_b")
    return judged.agg(F.max("observed").alias("auc_difference"), ((F.count_if((F.col("perm") > 0) & (F.col("diff") >= F.col("observed"))) + 1) / F.lit(permutations + 1.0)).alias("p_value"))


def _dealt(sims: DataFrame, permutations: int, seed: int) -> DataFrame:
    """Every item with its 32-bit hash ``h`` in each permutation from 1; one md5 serves four permutations."""
    blocks = dealt_out(sims, "item").withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(permutations // 4))))
    blocks = blocks.withColumn("_h", F.md5(F.concat_ws(":", F.lit(f"{seed}:perm"), "_block", "item").cast("binary")))
    four = F.array(*(F.struct((F.col("_block") * 4 + k).alias("perm"), F.substring("_h", 8 * k + 1, 8).alias("place")) for k in range(4)))
    each = blocks.select("config", "item", "below", F.explode(four).alias("_p")).where(F.col("_p.perm").between(1, permutations))
    return each.select("config", "item", "below", "_p.perm", F.conv("_p.place", 16, 10).cast("long").alias("h"))


def discriminate(real: DataFrame, sim: DataFrame, columns: list[str], folds: int = 5, trees: int = 100, seed: int = 7, final: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """A gradient-boosted classifier that tells simulated riders from real ones: out-of-fold scores (item, is_real,
    score) and, from a model of all riders, the shares of gain (rank, feature, importance)."""
    scores, shares = discriminate_all({"": (real, sim)}, columns, folds, trees, seed, final)
    return scores.drop("config"), None if shares is None else shares.drop("config")


def discriminate_all(features: dict[str, tuple[DataFrame, DataFrame]], columns: list[str], folds: int = 5, trees: int = 100, seed: int = 7, final: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """``discriminate`` for several configurations (name -> real and simulated riders' features), with a column ``config``.

    Folds are equal in size. All configurations' and folds' models grow in the same passes over the riders (``boosting.fit``).
    """
    rules, names = boosting.BoosterRules(trees=trees, seed=seed), list(features)
    placed = []
    for part, (real, sim) in enumerate(features.values()):
        rows = _told_apart(real, sim, columns)
        placed.append((rows, boosting.binned(rows, columns, rules, "item", "label").withColumn("part", F.lit(part))))
    both = reduce(DataFrame.unionByName, (p for _, p in placed))
    table = materialize(boosting.with_folds(both, "item", folds, seed).withColumn("h", hash_order(f"{seed}:row", "item")), "binned")
    discard(*(rows for rows, _ in placed))
    models = boosting.fit(table, len(columns), folds, rules, final)
    named = F.element_at(F.array(*(F.lit(n) for n in names)), F.col("part") + 1)
    scored = boosting.out_of_fold(table, models, "part", "item", "label") if folds else table.select("part", "item", "label", F.lit(0.5).alias("score"))
    scores = materialize(scored.select(named.alias("config"), "item", (F.col("label") == 0).alias("is_real"), "score"), "scores")
    discard(table)
    if not final:
        return scores, None
    out = []
    for model in (m for m in models if m.fold == boosting.ALL):
        gains = boosting.gains(model, columns)
        total = sum(gains.values())
        out += [(names[model.part], k, c, g / total if total else 0.0) for k, (c, g) in enumerate(sorted(gains.items(), key=lambda x: -x[1]), 1)]
    return scores, scores.sparkSession.createDataFrame(out, "config string, rank long, feature string, importance double")


def discriminator(real: DataFrame, sim: DataFrame, columns: list[str], folds: int = 5, trees: int = 100, seed: int = 7) -> DataFrame:
    """Out-of-fold scores alone: item, is_real, score."""
    return discriminate(real, sim, columns, folds, trees, seed, final=False)[0]


def importances(real: DataFrame, sim: DataFrame, columns: list[str], trees: int = 100, seed: int = 7) -> DataFrame:
    """rank, feature, importance of a model of all riders alone, falling."""
    return discriminate(real, sim, columns, 0, trees, seed)[1]


def auc_interval(scores: DataFrame, replicates: int, seed: int) -> DataFrame:
    """One row: the AUC of (item, is_real, score) and the percentile interval of bootstrap replicates.

    Riders of one score (to a millionth) and side are drawn together; a replicate's scores are ordered in ranges, so no task
    holds a replicate.
    """
    cells = scores.groupBy("is_real", F.round(F.col("score") * 1e6).cast("long").alias("at")).agg(F.count("*").alias("m"))
    side = lambda real: F.sum(F.when(F.col("is_real") == real, F.col("w")).otherwise(0))
    drawn = cell_draws(cells, "m", replicates, f"{seed}:auc", F.col("is_real").cast("int"), "at").groupBy("replicate", "at").agg(side(True).alias("r"), side(False).alias("s"))
    ranked = S.grouped_running(materialize(drawn, "replicates"), ["replicate"], "at", "r", "s")
    per = ranked.groupBy("replicate").agg(F.try_divide(F.sum(F.col("s") * (F.col("cum_r") - F.col("r") / 2.0)), F.max("all_s") * F.max("all_r")).alias("auc"))
    point = S.auc(scores.withColumn("label", (~F.col("is_real")).cast("int")), "score", "label")
    return per.agg(F.percentile("auc", F.lit(0.025)).alias("auc_ci_low"), F.percentile("auc", F.lit(0.975)).alias("auc_ci_high")).withColumn("auc", point.scalar())


def _told_apart(real: DataFrame, sim: DataFrame, columns: list[str]) -> DataFrame:
    """item, label and features of all riders as a table."""
    both = real.select(F.concat(F.lit("real:"), "rider_id").alias("item"), F.lit(0.0).alias("label"), *columns).unionByName(sim.select(F.concat(F.lit("sim:"), "rider_id").alias("item"), F.lit(1.0).alias("label"), *columns))
    return materialize(both, "told-apart")
