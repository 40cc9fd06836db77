"""Market lookups with fallback from lane to origin to city: one pre-aggregate per level, then joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farelens.functions import exprs as X
from farelens.functions import stats as S
from farelens.sources.staging import materialize

MIN_LANE_TRIPS, MIN_ZONE_TRIPS = 20, 100
LANE = ["pickup_zone", "dropoff_zone"]


def _levels(trips: DataFrame, value: str, quantiles: dict[str, float], **levels: tuple[str, ...]) -> dict[str, DataFrame]:
    """Quantiles of a value at several levels, each a grouping by up to two columns: name -> its columns, ``name_n`` and ``name_q``.

    Every trip counts once per level, so all levels are one selection over (level, column, column).
    """
    key = lambda columns, k: F.col(columns[k]).cast("long") if len(columns) > k else F.lit(0).cast("long")
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("level"), key(columns, 0).alias("k0"), key(columns, 1).alias("k1")) for name, columns in levels.items()))).alias("l")
    found = materialize(S.grouped_quantiles(trips.select(value, each).select(value, "l.*"), ["level", "k0", "k1"], value, quantiles), "level-quantiles")
    out = {}
    for name, columns in levels.items():
        out[name] = found.where(F.col("level") == name).select(*(F.col(f"k{k}").alias(c) for k, c in enumerate(columns)), F.col("n").alias(f"{name}_n"), *(F.col(q).alias(f"{name}_{q}") for q in quantiles))
    return out


def price_history(trips: DataFrame, lanes: DataFrame | None = None) -> DataFrame:
    """Per lane: the scope with enough trips, and the fare's median and ninth decile there."""
    at = _levels(trips, "fare_paid", {"p50": 0.5, "p90": 0.9}, lane=("pickup_zone", "dropoff_zone"), zone=("pickup_zone",), city=())
    lane, city = at["lane"], at["city"]
    asked = lane if lanes is None else lanes.select(*LANE).distinct().join(lane, LANE, "left")
    n = F.coalesce("lane_n", F.lit(0))
    scope = F.when(n >= MIN_LANE_TRIPS, "lane").when(F.coalesce("zone_n", F.lit(0)) >= MIN_ZONE_TRIPS, "origin_zone").otherwise("citywide")
    # the city's row is one row of two numbers
    joined = asked.join(at["zone"], "pickup_zone", "left").withColumn("scope", scope).withColumns({c: city.select(c).scalar() for c in ("city_p50", "city_p90")})
    pick = lambda p: F.when(F.col("scope") == "lane", F.col(f"lane_{p}")).when(F.col("scope") == "origin_zone", F.col(f"zone_{p}")).otherwise(F.col(f"city_{p}"))
    return joined.select(*LANE, "scope", n.alias("n_trips"), pick("p50").alias("market_fare_p50"), pick("p90").alias("market_fare_p90"))


def rider_price_history(trips: DataFrame) -> DataFrame:
    """Per rider and lane travelled: the rider's own median fare in the lane's scope and the share of the
    scope's fares at or below it."""
    scope = price_history(trips).select(*LANE, "scope")
    scoped = trips.select("rider_id", *LANE, "fare_paid").join(scope, LANE)
    # a scope is named by the columns it fixes, so that all levels share one grouping
    market = trips.select(*LANE, "fare_paid").select(F.explode(F.array(
        F.struct(F.lit("lane").alias("scope"), F.col("pickup_zone").alias("z1"), F.col("dropoff_zone").alias("z2"), "fare_paid"),
        F.struct(F.lit("origin_zone").alias("scope"), F.col("pickup_zone").alias("z1"), F.lit(0).cast("long").alias("z2"), "fare_paid"),
        F.struct(F.lit("citywide").alias("scope"), F.lit(0).cast("long").alias("z1"), F.lit(0).cast("long").alias("z2"), "fare_paid"),
    )).alias("m")).select("m.*")
    key = [
        F.when(F.col("scope") == "citywide", F.lit(0)).otherwise(F.col("pickup_zone")).cast("long").alias("z1"),
        F.when(F.col("scope") == "lane", F.col("dropoff_zone")).otherwise(F.lit(0)).cast("long").alias("z2"),
    ]
    asked = scoped.select("rider_id", *LANE, "scope", *key).distinct()
    own = trips.select("rider_id", *LANE, "fare_paid").select("rider_id", F.explode(F.array(
        F.struct(F.lit("lane").alias("scope"), F.col("pickup_zone").alias("z1"), F.col("dropoff_zone").alias("z2"), "fare_paid"),
        F.struct(F.lit("origin_zone").alias("scope"), F.col("pickup_zone").alias("z1"), F.lit(0).cast("long").alias("z2"), "fare_paid"),
        F.struct(F.lit("citywide").alias("scope"), F.lit(0).cast("long").alias("z1"), F.lit(0).cast("long").alias("z2"), "fare_paid"),
    )).alias("m")).select("rider_id", "m.*").groupBy("rider_id", "scope", "z1", "z2").agg(F.median("fare_paid").alias("rider_median_fare"))
    # read three times from here on, so it is written once
    mine = materialize(asked.join(own, ["rider_id", "scope", "z1", "z2"]), "rider-medians")
    # ECDF inside each scope: market rows and probes in one ordered running count
    counted = market.groupBy("scope", "z1", "z2", "fare_paid").agg(F.count("*").alias("n")).withColumnRenamed("fare_paid", "v")
    probes = mine.select("scope", "z1", "z2", F.col("rider_median_fare").alias("v")).distinct().withColumn("n", F.lit(0).cast("long"))
    both = materialize(counted.unionByName(probes).groupBy("scope", "z1", "z2", "v").agg(F.sum("n").alias("n")), "scope-fares")
    found = S.grouped_running(both, ["scope", "z1", "z2"], "v", "n").select("scope", "z1", "z2", F.col("v").alias("rider_median_fare"), (F.col("cum_n") / F.col("all_n")).alias("rider_fare_percentile"))
    return mine.join(found, ["scope", "z1", "z2", "rider_median_fare"]).select("rider_id", *LANE, "scope", "rider_median_fare", "rider_fare_percentile")


def eta_reliability(trips: DataFrame) -> DataFrame:
    """Per pickup zone and hour: scope with enough trips, and the wait's median and ninth decile in minutes."""

    at = _levels(trips, "wait_secs", {"p50": 0.5, "p90": 0.9}, hour=("pickup_zone", "pickup_hour"), zone=("pickup_zone",))
    joined = at["hour"].join(at["zone"], "pickup_zone")
    joined = joined.withColumns({c: F.col(c) / 60.0 for c in ("hour_p50", "hour_p90", "zone_p50", "zone_p90")})
    fine = F.col("hour_n") >= MIN_ZONE_TRIPS
    return joined.select(
        "pickup_zone", "pickup_hour", F.when(fine, "zone_hour").otherwise("origin_zone").alias("scope"), F.col("hour_n").alias("n_trips"),
        F.when(fine, F.col("hour_p50")).otherwise(F.col("zone_p50")).alias("wait_p50_minutes"), F.when(fine, F.col("hour_p90")).otherwise(F.col("zone_p90")).alias("wait_p90_minutes"),
    )


def _median_miles(trips: DataFrame, lanes: DataFrame) -> DataFrame:
    at = _levels(trips, "trip_miles", {"miles": 0.5}, lane=("pickup_zone", "dropoff_zone"), zone=("pickup_zone",))
    lane, zone = at["lane"].withColumnRenamed("lane_n", "n_trips"), at["zone"]
    return lanes.join(lane, LANE, "left").join(zone, "pickup_zone", "left").withColumn("miles", F.coalesce("lane_miles", "zone_miles"))


def transit_alternative(trips: DataFrame, lanes: DataFrame) -> DataFrame:
    """Per lane asked for: transit minutes at the lane's (else the origin's) median miles, and the flat fare."""
    m = _median_miles(trips, lanes.select(*LANE).distinct())
    minutes = X.rounded(F.col("miles") / X.TRANSIT_MPH * 60.0, 1)
    return m.select(*LANE, minutes.alias("transit_minutes"), F.when(minutes.isNotNull(), F.lit(X.TRANSIT_FARE)).alias("transit_cost"), F.coalesce("n_trips", F.lit(0)).alias("n_trips"))


def lane_transit_minutes(trips: DataFrame, lanes: DataFrame) -> DataFrame:
    """As ``transit_alternative``, 60 minutes where nothing is known."""
    m = _median_miles(trips, lanes.select(*LANE).distinct())
    return m.select(*LANE, F.coalesce(X.rounded(F.col("miles") / X.TRANSIT_MPH * 60.0, 1), F.lit(60.0)).alias("transit_alt_minutes"))


def all_lanes(trips: DataFrame) -> DataFrame:
    """Every pair of a pickup zone and a drop-off zone in use: zones are a bounded dimension, taken as one array."""
    drops = trips.select("dropoff_zone").distinct().agg(F.sort_array(F.collect_list("dropoff_zone")).alias("d")).scalar()
    return trips.select("pickup_zone").distinct().select("pickup_zone", F.explode(drops).alias("dropoff_zone"))


TOOLS = {"check_price_history": price_history, "check_eta_reliability": eta_reliability, "check_transit_alternative": transit_alternative}


def call_tool(name: str, *args: DataFrame) -> DataFrame:
    """Dispatch by name; an unknown name is an error that lists the known ones."""
    if name not in TOOLS:
        raise KeyError(f"unknown tool {name!r}; known: {', '.join(sorted(TOOLS))}")
    return TOOLS[name](*args)
