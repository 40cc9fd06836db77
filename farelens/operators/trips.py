"""From raw trip records to the trip fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelens.functions import exprs as X
from farelens.functions import stats as S

MAX_WAIT = 3600


def pay_per_mile_median(raw: DataFrame) -> DataFrame:
    """One row: the exact median of driver pay per mile."""
    usable = raw.where("trip_miles > 0 AND driver_pay >= 0 AND base_passenger_fare > 0")
    rate = usable.select((F.col("driver_pay") / F.col("trip_miles")).alias("ppm"))
    return S.global_quantiles(rate, "ppm", [0.5]).select(F.col("q0").alias("median_ppm"))


def usable(raw: DataFrame) -> DataFrame:
    return raw.where(
        "trip_miles > 0 AND trip_time > 0 AND base_passenger_fare > 0 AND driver_pay >= 0 AND PULocationID IS NOT NULL AND DOLocationID IS NOT NULL"
        " AND request_datetime IS NOT NULL AND pickup_datetime IS NOT NULL AND pickup_datetime >= request_datetime"
    )


def clean_trips(raw: DataFrame, median_ppm: DataFrame | None = None) -> DataFrame:
    """The trip fact table. Columns of ``raw`` that are not part of it (keys) stay."""
    return priced_trips(measured_trips(raw), pay_per_mile_median(raw) if median_ppm is None else median_ppm)


def measured_trips(raw: DataFrame) -> DataFrame:
    """The usable trips with what is read off each; prices follow from it."""
    seconds = (F.unix_micros(F.col("pickup_datetime").cast("timestamp")) - F.unix_micros(F.col("request_datetime").cast("timestamp"))) / 1e6
    keys = [c for c in raw.columns if c in ("rider_id", "tk")]
    return usable(raw).select(
        *keys,
        F.col("PULocationID").cast("long").alias("pickup_zone"), F.col("DOLocationID").cast("long").alias("dropoff_zone"),
        F.hour("pickup_datetime").cast("long").alias("pickup_hour"), X.weekend("pickup_datetime").cast("long").alias("is_weekend"),
        "base_passenger_fare", "tips", "trip_miles", "trip_time",
        F.least(F.greatest(F.bround(seconds).cast("long"), F.lit(0)), F.lit(MAX_WAIT)).cast("long").alias("wait_secs"),
        "driver_pay",
    )


def priced_trips(measured: DataFrame, median_ppm: DataFrame) -> DataFrame:
    """The fact table of measured trips.

    The price ratio divides a trip's pay by what its miles earn at the median rate, which reaches the
    rows as a scalar subquery.
    """
    keys = [c for c in measured.columns if c in ("rider_id", "tk")]
    return measured.withColumn("_ppm", median_ppm.scalar()).select(
        *keys, "pickup_zone", "dropoff_zone", "pickup_hour", "is_weekend", X.miles_bucket("trip_miles").cast("long").alias("miles_bucket"), "base_passenger_fare", "tips", "trip_miles", "trip_time", "wait_secs",
        "driver_pay", (F.col("base_passenger_fare") + F.col("tips")).alias("fare_paid"),
        X.clip(F.try_divide(F.col("driver_pay"), F.col("trip_miles") * F.col("_ppm")), 0.0, 10.0).alias("surge_ratio"),
    )


def with_purpose(trips: DataFrame) -> DataFrame:
    return trips.withColumn("purpose", X.trip_purpose())


def counts_by(df: DataFrame, key: Column, name: str) -> DataFrame:
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n"))


def accepted_events(trips: DataFrame) -> DataFrame:
    """Each real trip as an accepted decision."""
    return trips.select(
        *[c for c in ("rider_id", "tk") if c in trips.columns], F.col("fare_paid").alias("quoted_fare"), X.clip("surge_ratio", 1.0, 3.0).alias("surge"),
        (F.col("wait_secs") / 60.0).alias("eta_min"), X.trip_purpose().alias("purpose"), F.lit("accept").alias("action"), F.lit(1).cast("long").alias("accepted"), "pickup_hour",
    )
