"""The engine's inputs as views over order, customer, supplier and event tables.

A line item is a trip of its order's customer from the customer's nation to the supplier's; an event is
an entry of a rider's decision log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farelens.sources.tables import table


#: Suppliers up to this number travel to every task (some 30 bytes each); more are joined by key.
SENT_SUPPLIERS = 500_000


def raw_trips(spark: SparkSession, folder: str) -> DataFrame:
    """Raw trips with a rider and a unique trip key. One in 97 parts has its pickup before the request."""
    return trips_of(trip_items(spark, folder))


def trip_items(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with their rider and zones, as compact as they come: what ``trips_of`` makes trips of.

    Orders meet their customers first and suppliers are sent, so items are shuffled once.
    """
    item, order = table(spark, folder, "lineitem"), table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    if supplier.limit(SENT_SUPPLIERS + 1).count() <= SENT_SUPPLIERS:
        supplier = F.broadcast(supplier)
    joined = item.join(order.join(customer, F.col("o_custkey") == F.col("c_custkey")), item.l_orderkey == F.col("o_orderkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "o_custkey", "c_nationkey", "s_nationkey")


#: What makes a trip's key: together unique.
KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents")


def key_text(key: Column) -> Column:
    return F.concat_ws(":", *(key[c] for c in KEY))


def trips_of(items: DataFrame, text: bool = True) -> DataFrame:
    """Each of ``trip_items`` as a raw trip, without a shuffle; its key as a text or, smaller, as its numbers."""
    wait = F.when(F.col("l_partkey") % 97 == 0, F.lit(-60.0)).otherwise((F.col("l_partkey") * 37 + F.col("l_suppkey") * 11) % 1200 + 30) + (F.col("l_linenumber") % 4) * F.lit(0.25)
    return items.withColumns({"_wait": wait, "cents": F.round(F.col("l_extendedprice") * 100).cast("long")}).select(
        F.col("o_custkey").cast("long").alias("rider_id"),
        key_text(F.struct(*KEY)).alias("tk") if text else F.struct(*KEY).alias("tk"),
        (F.col("c_nationkey") + 1).cast("long").alias("PULocationID"), (F.col("s_nationkey") + 1).cast("long").alias("DOLocationID"),
        F.expr("l_shipdate + make_dt_interval(0, cast(l_orderkey % 24 as int), 0, 0)").alias("request_datetime"),
        F.expr("l_shipdate + make_dt_interval(0, cast(l_orderkey % 24 as int), 0, cast(_wait as decimal(18,6)))").alias("pickup_datetime"),
        (F.col("l_quantity") / 5.0).alias("trip_miles"), (F.col("l_quantity") * 36.0).alias("trip_time"),
        (F.col("l_extendedprice") / 1000.0).alias("base_passenger_fare"),
        (F.col("l_extendedprice") / 1000.0 * F.greatest(F.col("l_tax") - 0.04, F.lit(0.0))).alias("tips"),
        (F.col("l_extendedprice") / 1000.0 * (1 - F.col("l_discount"))).alias("driver_pay"),
    )


def decision_log(spark: SparkSession, folder: str) -> DataFrame:
    """Each rider's decisions in order, with realized outcomes for some of them."""
    seq = F.row_number().over(Window.partitionBy("rider_id").orderBy("ts", "offer_id"))
    return decisions_of(table(spark, folder, "events")).withColumn("seq", seq.cast("long"))


def decisions_of(e: DataFrame) -> DataFrame:
    """Events as decisions, in no order yet; a stream of events will do."""
    action = F.when(F.col("event_type") == "purchase", "accept").when(F.col("event_type") == "click", "wait_for_better").when(F.col("event_type") == "view", "switch_mode").otherwise("reject")
    purpose = F.element_at(F.array(*(F.lit(p) for p in ("commute", "social", "errand", "airport"))), (F.col("event_id") % 4 + 1).cast("int"))
    out = e.select(
        F.col("user_id").cast("long").alias("rider_id"), F.col("event_id").cast("long").alias("offer_id"), "ts", action.alias("action"), purpose.alias("purpose"),
        (F.col("event_id") % 25 + 1).cast("long").alias("origin_zone"), (F.round(F.col("value") * 100) / 100).alias("quoted_fare"),
        (1 + (F.col("event_id") % 13) / 8.0).alias("surge"), ((F.col("event_id") * 7 % 200) / 10.0).alias("eta_min"),
    )
    out = out.withColumn("accepted", (F.col("action") == "accept").cast("long"))
    return out.select(
        "*", F.when((F.col("accepted") == 1) & (F.col("offer_id") % 3 != 0), F.round(F.col("quoted_fare") * 105) / 100).alias("realized_fare"),
        F.when(F.col("accepted") == 1, F.col("eta_min") + F.col("offer_id") % 25).alias("realized_wait"),
    )
