"""Rider statistics and data-grounded personas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farelens.functions import exprs as X
from farelens.functions import stats as S
from farelens.functions.rand import hash_uniform
from farelens.sources.staging import materialize

FARE_WEIGHT, TIP_WEIGHT = 0.6, 0.4
TRANSIT_MAX_MILES, TRANSIT_MIN_SENSITIVITY = 2.5, 0.55


def _by_rider(trips: DataFrame, *columns: str) -> DataFrame:
    """A few columns of the trips, a rider's in one task: medians made there are never shuffled as half-made value counts, which are several
    times the size of the values."""
    return trips.select("rider_id", *columns).repartition("rider_id")


def rider_stats(trips: DataFrame) -> DataFrame:
    """Seven statistics per rider in one grouping."""
    return _by_rider(trips, "fare_paid", "trip_miles", "wait_secs", "tips").groupBy("rider_id").agg(
        F.median("fare_paid").alias("median_fare_paid"),
        F.median(F.col("fare_paid") / F.col("trip_miles")).alias("median_fpm"),
        F.median("trip_miles").alias("median_miles"),
        (F.median("wait_secs") / 60.0).alias("median_wait_min"),
        (F.percentile("wait_secs", F.lit(0.75)) / 60.0).alias("p75_wait_min"),
        F.avg((F.col("tips") > 0).cast("int")).alias("tip_rate"),
        F.count("*").alias("observed_trip_count"),
    )


def purpose_mix(trips: DataFrame) -> DataFrame:
    """Shares of the four purposes among a rider's trips."""
    p = X.trip_purpose()
    return trips.groupBy("rider_id").agg(*(F.avg((p == k).cast("int")).alias(k) for k in X.PURPOSES))


def ranked_stats(stats: DataFrame) -> DataFrame:
    """Average-tie percentile ranks of fare per mile and of spend over the whole panel."""
    stats = materialize(stats, "rider-stats")  # read for both ranks' ranges, sums and rows
    return S.percentile_rank(S.percentile_rank(stats, "median_fpm", "fare_pctl"), "median_fare_paid", "spend_pctl")


def riders_of(trips: DataFrame) -> DataFrame:
    """The rider dimension: most frequent pickup and drop-off zones (lowest on ties) and trip counts."""
    return _by_rider(trips, "pickup_zone", "dropoff_zone").groupBy("rider_id").agg(
        F.mode("pickup_zone", deterministic=True).alias("home_zone"), F.mode("dropoff_zone", deterministic=True).alias("work_zone"), F.count("*").alias("observed_trip_count")
    )


def fit_personas(riders: DataFrame, trips: DataFrame) -> DataFrame:
    """One persona per rider with trips; ranks are over all riders of ``trips``."""
    s = ranked_stats(rider_stats(trips)).drop("observed_trip_count")
    sensitivity = X.clip(1.0 - (FARE_WEIGHT * F.col("fare_pctl") + TIP_WEIGHT * F.col("tip_rate")), 0.0, 1.0)
    joined = riders.select("rider_id", "home_zone", "work_zone", "observed_trip_count").join(s, "rider_id").join(purpose_mix(trips), "rider_id")
    return joined.withColumn("price_sensitivity", sensitivity).select(
        "rider_id", "home_zone", "work_zone", *X.PURPOSES, "price_sensitivity",
        F.greatest("p75_wait_min", 1.25 * F.col("median_wait_min"), F.lit(0.5)).alias("wait_tolerance_minutes"),
        X.income_bracket("spend_pctl").alias("income_bracket"),
        ((F.col("median_miles") <= TRANSIT_MAX_MILES) & (F.col("price_sensitivity") >= TRANSIT_MIN_SENSITIVITY)).alias("has_transit_alternative"),
        X.loyalty_tier("observed_trip_count").alias("loyalty_tier"), "observed_trip_count", "median_fare_paid", F.col("median_wait_min").alias("median_wait_experienced"),
    )


def sample_riders(riders: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` riders without replacement, by smallest hash."""
    if n < 1:
        raise ValueError("n must be 1 at least")
    return riders.orderBy(hash_uniform(seed, "rider_id"), "rider_id").limit(n)


def sample_personas(riders: DataFrame, trips: DataFrame, n: int, seed: int) -> DataFrame:
    """Personas of ``n`` sampled riders; asking for more than there are is an error."""
    have = riders.count()
    if n > have:
        raise ValueError(f"{n} personas asked for, {have} riders available")
    return fit_personas(sample_riders(riders, n, seed), trips)


def persona_summary(personas: DataFrame) -> DataFrame:
    """One row: size, share with a transit alternative, and riders per bracket and tier.

    Medians are exact and taken from value counts.
    """
    brackets, tiers = ("low", "middle", "upper_middle", "high"), ("member", "silver", "gold", "platinum")
    counts = personas.agg(
        F.count("*").alias("n"), F.avg(F.col("has_transit_alternative").cast("int")).alias("transit_share"),
        *(F.count_if(F.col("income_bracket") == b).alias(f"income_{b}") for b in brackets), *(F.count_if(F.col("loyalty_tier") == t).alias(f"tier_{t}") for t in tiers),
    )
    medians = {"median_sensitivity": "price_sensitivity", "median_tolerance": "wait_tolerance_minutes", "median_fare": "median_fare_paid"}
    return counts.select("*", *(S.global_quantiles(personas, c, [0.5]).scalar().alias(k) for k, c in medians.items()))


def persona_violations(personas: DataFrame) -> DataFrame:
    """One row per broken constraint of a persona."""
    ok = {
        "rider_id": F.col("rider_id") >= 0, "home_zone": F.col("home_zone") >= 1, "work_zone": F.col("work_zone") >= 1,
        "trip_purpose_mix": F.abs(sum((F.col(p) for p in X.PURPOSES), F.lit(0.0)) - 1.0) <= 1e-6, "price_sensitivity": F.col("price_sensitivity").between(0, 1),
        "wait_tolerance_minutes": F.col("wait_tolerance_minutes") > 0, "income_bracket": F.col("income_bracket").isin("low", "middle", "upper_middle", "high"),
        "loyalty_tier": F.col("loyalty_tier").isin("member", "silver", "gold", "platinum"), "observed_trip_count": F.col("observed_trip_count") >= 1,
        "median_fare_paid": F.col("median_fare_paid") >= 0, "median_wait_experienced": F.col("median_wait_experienced") >= 0,
    }
    return violations(personas, "rider_id", ok)


def checked_personas(personas: DataFrame) -> DataFrame:
    """The personas as they are; one that breaks a constraint is an error that names rider and field."""
    bad = persona_violations(personas).orderBy("rider_id", "field").limit(5).collect()
    if bad:
        raise ValueError("personas break constraints: " + ", ".join(f"{b['field']} of rider {b['rider_id']}" for b in bad))
    return personas


def violations(df: DataFrame, key: str, ok: dict) -> DataFrame:
    """``key, field`` for every constraint that is false or null."""
    broken = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(None)).otherwise(F.lit(k)) for k, c in ok.items())), lambda x: x.isNotNull())
    return df.select(key, F.explode(broken).alias("field"))
