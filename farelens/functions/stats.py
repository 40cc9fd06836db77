"""Exact statistics that stay distributed.

A global order never runs through one window over the rows: values are first counted, the distinct
values are cut into ranges at approximate quantiles, running sums are taken inside each range, and the
ranges' totals - a few rows - are added. Memory of a task is bounded by a range of distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farelens.sources.staging import materialize

#: Ranges of a global order: as many as the cluster runs tasks, within these bounds.
RANGES, MOST_RANGES = 64, 1024


def ranges_of(df: DataFrame) -> int:
    return max(RANGES, min(MOST_RANGES, df.sparkSession.sparkContext.defaultParallelism))


def cut_points(df: DataFrame, value: str) -> Column:
    """The bounds of a value's ranges, approximate quantiles of it."""
    k = ranges_of(df)
    return df.agg(F.percentile_approx(value, [i / k for i in range(1, k)], 20 * k).alias("c")).scalar()


def below(cuts: Column, value: Column) -> Column:
    """How many entries of a rising array, of fewer than 2 * MOST_RANGES, are below the value.

    The place is found by halving. The value goes in as a lambda's argument: written inside the inner lambda, a long expression
    would be evaluated once for every step.
    """
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(MOST_RANGES.bit_length()))))
    return F.transform(F.array(value), lambda v: F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(cuts, at + step - 1) < v, step).otherwise(0)))[0]


def running_sums(counted: DataFrame, value: str, sums: list[str], ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds, for each s of ``sums``, ``cum_s`` (up to and including) and ``all_s`` in order of a numeric ``value``.

    ``counted`` has one row per value, or per value and ``ties``. Rows whose value is null are dropped.
    """
    given = counted.where(F.col(value).isNotNull())
    ranged = given.withColumn("_cuts", cut_points(given, value)).withColumn("_range", below(F.col("_cuts"), F.col(value))).drop("_cuts")
    totals = ranged.groupBy("_range").agg(*(F.sum(s).alias(f"_t_{s}") for s in sums))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # MOST_RANGES rows at most
    whole = Window.partitionBy()
    totals = totals.select("_range", *(F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_b_{s}") for s in sums), *(F.sum(f"_t_{s}").over(whole).alias(f"all_{s}") for s in sums))
    inside = Window.partitionBy("_range").orderBy(value, *ties).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.select("*", *(F.sum(s).over(inside).alias(f"_i_{s}") for s in sums)).join(F.broadcast(totals), "_range")
    return summed.select(*counted.columns, *((F.col(f"_b_{s}") + F.col(f"_i_{s}")).alias(f"cum_{s}") for s in sums), *(F.col(f"all_{s}") for s in sums))


def numbered(df: DataFrame, keys: list[str], order: str, ties: tuple[str, ...], name: str) -> DataFrame:
    """Adds the 1-based place of every row inside its key, by a 32-bit hash ``order`` and ``ties``.

    Hashes are uniform, so a key is cut into equal ranges of them: rows are numbered inside each (key, range) and the sizes of the ranges
    before are added. A key with a third of all rows is as many tasks as there are ranges.
    """
    ranged = df.withColumn("_range", F.floor(F.col(order) / F.lit(float(2**32 // ranges_of(df)))).cast("int"))
    sizes = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    sizes = sizes.select(*keys, "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order, *ties))
    return ranged.withColumn("_place", place).join(sizes, [*keys, "_range"]).withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def value_counts(df: DataFrame, value: str, *weights: Column) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"), *weights)


def global_quantiles(df: DataFrame, value: str, probs: list[float]) -> DataFrame:
    """One row ``q0, q1, ...``: exact quantiles with linear interpolation over all rows."""
    ranked = running_sums(value_counts(df.select(F.col(value).alias("_v")), "_v"), "_v", ["n"])
    aggs = []
    for k, p in enumerate(probs):
        place = (F.col("all_n") - 1) * F.lit(float(p))  # 0-based; a value covers [cum - n, cum - 1]
        low, high = F.floor(place), F.ceil(place)
        covers = lambda at: (F.col("cum_n") - F.col("n") <= at) & (at < F.col("cum_n"))
        aggs += [F.max(F.when(covers(low), F.col("_v"))).alias(f"_l{k}"), F.max(F.when(covers(high), F.col("_v"))).alias(f"_h{k}"), F.max(place - low).alias(f"_f{k}")]
    got = ranked.agg(*aggs)
    return got.select(*((F.col(f"_l{k}") + (F.col(f"_h{k}") - F.col(f"_l{k}")) * F.col(f"_f{k}")).alias(f"q{k}") for k in range(len(probs))))


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """keys, n and one column per quantile: exact, with linear interpolation, for all groups at once.

    Selection instead of a sort or a buffer of a group's distinct values: rows are counted per group and range of the value (summed
    map-side), the counts tell in which range each wanted place falls, and only the values of those ranges are looked
    at. Ranges are cut at quantiles of all rows, so a group of most rows has most ranges to itself. Null values
    do not count, and a group of only such rows has no row; null keys are groups, too.
    """
    k = [f"_k{i}" for i in range(len(keys))]
    given = df.select(*(F.struct(F.col(c).isNull().alias("z"), F.col(c).alias("v")).alias(i) for i, c in zip(k, keys, strict=True)), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    ranged = given.withColumn("_cuts", cut_points(given, "_v")).withColumn("_range", below(F.coalesce(F.col("_cuts"), F.array().cast("array<double>")), F.col("_v"))).drop("_cuts")
    group = Window.partitionBy(*k)
    counts = ranged.groupBy(*k, "_range").agg(F.count("*").alias("_n"))
    counts = counts.withColumns({"_upto": F.sum("_n").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_n").over(group)})  # a group's ranges
    place = lambda p: (F.col("_all") - 1) * F.lit(float(p))
    ends = F.array(*(F.struct(F.lit(i).alias("q"), F.lit(high).alias("high"), (F.ceil(place(p)) if high else F.floor(place(p))).alias("at"), (place(p) - F.floor(place(p))).alias("part")) for i, p in enumerate(quantiles.values()) for high in (False, True)))
    wanted = counts.withColumn("_e", F.explode(ends)).where((F.col("_e.at") < F.col("_upto")) & (F.col("_e.at") >= F.col("_upto") - F.col("_n")))
    wanted = materialize(wanted.select(*k, "_range", "_all", "_e.q", "_e.high", "_e.part", (F.col("_e.at") - (F.col("_upto") - F.col("_n"))).alias("_at")), "wanted-places")
    near = ranged.join(wanted.select(*k, "_range").distinct(), [*k, "_range"], "left_semi").groupBy(*k, "_range", "_v").agg(F.count("*").alias("_m"))
    near = near.withColumn("_cum", F.sum("_m").over(Window.partitionBy(*k, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    hit = near.join(wanted, [*k, "_range"]).where((F.col("_at") < F.col("_cum")) & (F.col("_at") >= F.col("_cum") - F.col("_m")))
    one = lambda i, high: F.max(F.when((F.col("q") == i) & (F.col("high") == high), F.col("_v")))
    part = lambda i: F.max(F.when(F.col("q") == i, F.col("part")))
    out = hit.groupBy(*k).agg(F.max("_all").alias("n"), *((one(i, False) + (one(i, True) - one(i, False)) * part(i)).alias(name) for i, name in enumerate(quantiles)))
    return out.select(*(F.col(f"{i}.v").alias(c) for i, c in zip(k, keys, strict=True)), "n", *quantiles)


def percentile_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the average-tie rank over the number of rows."""
    ranked = running_sums(value_counts(df.select(F.col(value).alias("_v")), "_v"), "_v", ["n"])
    rank = ranked.select(F.col("_v").alias(value), ((F.col("cum_n") - (F.col("n") - 1) / 2.0) / F.col("all_n")).alias(name))
    return df.join(rank, value, "left")


def ecdf(market: DataFrame, value: str) -> DataFrame:
    """Distinct market values with the fraction of market rows at or below each."""
    return running_sums(value_counts(market.select(F.col(value).alias("_v")), "_v"), "_v", ["n"]).select(F.col("_v").alias(value), (F.col("cum_n") / F.col("all_n")).alias("ecdf"))


def ecdf_lookup(probe: DataFrame, probe_value: str, market: DataFrame, market_value: str, name: str) -> DataFrame:
    """Adds the fraction of market rows at or below the probe's value; probes need not be market values."""
    m = market.where(F.col(market_value).isNotNull()).groupBy(F.col(market_value).alias("_v")).agg(F.count("*").alias("n"))
    p = probe.where(F.col(probe_value).isNotNull()).select(F.col(probe_value).alias("_v")).distinct().withColumn("n", F.lit(0).cast("long"))
    both = m.unionByName(p).groupBy("_v").agg(F.sum("n").alias("n"))
    found = running_sums(both, "_v", ["n"]).select(F.col("_v").alias(probe_value), (F.col("cum_n") / F.col("all_n")).alias(name))
    return probe.join(found, probe_value, "left")


def ks_statistic(df: DataFrame, value: str, first: Column, name: str = "ks_d") -> DataFrame:
    """One row: the largest distance of the two samples' distribution functions; ``first`` marks sample one."""
    g = df.select(F.col(value).alias("_v"), first.cast("int").alias("_s")).where("_v IS NOT NULL").groupBy("_v").agg(F.sum("_s").alias("a"), F.sum(1 - F.col("_s")).alias("b"))
    c = running_sums(g, "_v", ["a", "b"])
    return c.agg(F.max(F.abs(F.try_divide(F.col("cum_a"), F.col("all_a")) - F.try_divide(F.col("cum_b"), F.col("all_b")))).alias(name))


def auc(df: DataFrame, score: str, label: str, name: str = "auc") -> DataFrame:
    """One row: the area under the ROC curve by rank sums, ties one half."""
    g = df.groupBy(F.col(score).alias("_v")).agg(F.sum(label).alias("pos"), F.count("*").alias("n"))
    c = running_sums(g, "_v", ["n", "pos"])
    mean_rank = F.col("cum_n") - (F.col("n") - 1) / 2.0
    s = c.agg(F.sum(mean_rank * F.col("pos")).alias("r"), F.max("all_pos").alias("p"), F.max("all_n").alias("t"))
    return s.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0, F.col("p") * (F.col("t") - F.col("p")) * F.lit(1.0)).alias(name))


def laplace_rate(hits: Column, n: Column) -> Column:
    return (hits + 0.5) / (n + 1.0)


def log_log_slope(df: DataFrame, x: str, y: str, name: str = "slope") -> DataFrame:
    """One row: least squares of ln y on ln x; null under three points or three distinct ln x at three places."""
    lx, ly = F.ln(x), F.ln(y)
    got = df.where((F.col(x) > 0) & (F.col(y) > 0)).agg(F.regr_slope(ly, lx).alias("s"), F.count("*").alias("n"), F.countDistinct(F.round(lx * 1000.0)).alias("k"))
    return got.select(F.when((F.col("n") >= 3) & (F.col("k") >= 3), F.col("s")).alias(name))


def right_closed_bin(value: Column, edges: list[Column]) -> Column:
    """How many edges are below the value."""
    out = F.lit(0)
    for e in edges:
        out = out + (e < value).cast("int")
    return out


def grouped_running(counted: DataFrame, keys: list[str], value: str, *sums: str) -> DataFrame:
    """Adds ``cum_s`` and ``all_s`` per group for each s of ``sums``; ``counted`` has one row per group and value.

    As in ``running_sums`` a group is cut into ranges of its values, here at quantiles of all groups' values,
    so a group with most of the rows is spread over as many tasks.
    """
    ranged = counted.withColumn("_cuts", cut_points(counted, value)).withColumn("_range", below(F.col("_cuts"), F.col(value))).drop("_cuts")
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # MOST_RANGES rows of a group at most
    totals = ranged.groupBy(*keys, "_range").agg(*(F.sum(s).alias(f"_t_{s}") for s in sums))
    totals = totals.select(*keys, "_range", *(F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_b_{s}") for s in sums), *(F.sum(f"_t_{s}").over(whole).alias(f"all_{s}") for s in sums))
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.select("*", *(F.sum(s).over(inside).alias(f"_i_{s}") for s in sums)).join(totals, [*keys, "_range"])
    return summed.select(*counted.columns, *((F.col(f"_b_{s}") + F.col(f"_i_{s}")).alias(f"cum_{s}") for s in sums), *(F.col(f"all_{s}") for s in sums))
