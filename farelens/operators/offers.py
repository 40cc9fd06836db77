"""Counterfactual offers: sampled trips of each rider times a grid of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farelens.functions import exprs as X
from farelens.functions.rand import hash_uniform
from farelens.operators.lookups import LANE, lane_transit_minutes
from farelens.operators.personas import violations

#: Fixed values: (price, surge) changes of the evaluation grid and (price, wait) changes of the simulation.
EVALUATION_GRID = ((1.0, 1.0), (0.8, 1.0), (1.25, 1.0), (1.8, 1.0), (1.0, 2.0), (1.25, 2.0))
SIMULATION_GRID = ((0.8, 1.0), (1.0, 1.0), (1.25, 1.0), (1.0, 0.5), (1.0, 2.0))
FRAMINGS = ("numeric", "range", "reassuring")
WEATHER = ("clear", "rain", "snow")
MAX_SURGE = 5.0


def sample_trips(trips: DataFrame, k: int, seed: int) -> DataFrame:
    """``k`` trips of each rider (all if there are fewer), with their ``trip_index`` from 0."""
    order = Window.partitionBy("rider_id").orderBy(hash_uniform(seed, "tk"), "tk")
    first = trips.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)  # in this form Spark drops the others before the shuffle
    return first.withColumn("trip_index", (F.col("_r") - 1).cast("long")).drop("_r")


def _grid(pairs: tuple[tuple[float, float], ...], first: str, second: str) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("variant"), F.lit(a).alias(first), F.lit(b).alias(second)) for i, (a, b) in enumerate(pairs))))


def evaluation_offers(trips: DataFrame, trips_per_rider: int, seed: int, riders: DataFrame | None = None) -> DataFrame:
    """Six offers for each sampled trip; ``riders`` restricts who gets offers, never the market behind them."""
    return offers_of(offer_bases(trips, trips_per_rider, seed, riders), seed)


#: What an offer takes from its trip.
BASE = ("rider_id", "tk", "trip_index", "pickup_zone", "dropoff_zone", "pickup_hour", "is_weekend", "fare_paid", "surge_ratio", "wait_secs")


def offer_bases(trips: DataFrame, trips_per_rider: int, seed: int, riders: DataFrame | None = None) -> DataFrame:
    """The sampled trips that offers change, with their lane's transit minutes: a sixth of the offers' rows."""
    bases = trips if riders is None else trips.join(riders.select("rider_id"), "rider_id", "left_semi")
    bases = sample_trips(bases.select([c for c in BASE if c != "trip_index"]), trips_per_rider, seed)
    return bases.join(F.broadcast(lane_transit_minutes(trips, trips)), LANE).select(*BASE[:1], *BASE[2:], "transit_alt_minutes")  # a row for each pair of zones


def offers_of(bases: DataFrame, seed: int, *traits: str) -> DataFrame:
    """Six offers for each base; ``traits`` of the base's rider go with them."""
    joined = bases.withColumn("g", _grid(EVALUATION_GRID, "price_mult", "surge_mult")).select("*", "g.*")
    surge = X.rounded(F.least(X.clip("surge_ratio", 1.0, 3.0) * F.col("surge_mult"), F.lit(MAX_SURGE)), 2)
    pick = lambda names, at: F.element_at(F.array(*(F.lit(n) for n in names)), (at + 1).cast("int"))
    offer_id = F.concat(F.lit("r"), F.col("rider_id"), F.lit("t"), F.col("trip_index"), F.lit("v"), F.col("variant"))
    return joined.select(
        "rider_id", offer_id.alias("offer_id"), F.col("pickup_zone").alias("origin_zone"), F.col("dropoff_zone").alias("dest_zone"), X.trip_purpose().alias("purpose"), "pickup_hour",
        X.rounded(F.col("fare_paid") * F.col("price_mult"), 2).alias("quoted_fare"), surge.alias("surge"), (F.col("wait_secs") / 60.0).alias("eta_min"),
        pick(FRAMINGS, F.col("variant") % len(FRAMINGS)).alias("eta_framing"),
        F.when(F.col("price_mult") < 1.0, X.rounded((1.0 - F.col("price_mult")) * 100.0, 1)).otherwise(0.0).alias("discount_pct"), X.time_of_day("pickup_hour").alias("time_of_day"),
        pick(WEATHER, F.floor(hash_uniform(f"{seed}:weather", offer_id) * len(WEATHER))).alias("weather"), "transit_alt_minutes", "price_mult", "surge_mult",
        ((F.col("price_mult") == 1.0) & (F.col("surge_mult") == 1.0)).alias("is_base"), ((F.col("price_mult") == 1.8) & (F.col("surge_mult") == 1.0)).alias("reject_counterfactual"), *traits,
    )


def simulation_offers(trips: DataFrame, trips_per_rider: int, seed: int) -> DataFrame:
    """Five price and wait changes of each sampled trip."""
    bases = sample_trips(trips, trips_per_rider, seed).withColumn("g", _grid(SIMULATION_GRID, "price_mult", "wait_mult")).select("*", "g.*")
    wait = F.col("wait_secs") / 60.0
    return bases.select(
        "rider_id", "tk", "variant", "pickup_zone", "dropoff_zone", "pickup_hour", "trip_miles", F.col("fare_paid").alias("base_fare"), wait.alias("base_wait_min"), "price_mult", "wait_mult",
        (F.col("fare_paid") * F.col("price_mult")).alias("offered_fare"), (wait * F.col("wait_mult")).alias("offered_wait_min"),
    )


def as_shown(offers: DataFrame) -> DataFrame:
    """Offers with the rounding that riders see: fare and surge at two places, wait and discount at one."""
    return offers.withColumns({"quoted_fare": X.rounded("quoted_fare", 2), "surge": X.rounded("surge", 2), "eta_min": X.rounded("eta_min", 1), "discount_pct": X.rounded("discount_pct", 1)})


def offer_violations(offers: DataFrame) -> DataFrame:
    """One row per broken constraint of a shown offer."""
    o = as_shown(offers)
    ok = {
        "origin_zone": F.col("origin_zone") >= 1, "dest_zone": F.col("dest_zone") >= 1, "trip_purpose": F.col("purpose").isin(*X.PURPOSES), "quoted_fare": F.col("quoted_fare") > 0,
        "surge_multiplier": F.col("surge") >= 1, "eta_minutes": F.col("eta_min") > 0, "eta_framing": F.col("eta_framing").isin(*FRAMINGS), "discount_pct": F.col("discount_pct").between(0, 100),
        "time_of_day": F.col("time_of_day").isin("night", "morning", "midday", "evening"), "transit_alt_minutes": F.col("transit_alt_minutes") >= 0,
    }
    return violations(o, "offer_id", ok)
