"""Schemas, readers and writers of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_TRIPS = "PULocationID long, DOLocationID long, request_datetime timestamp_ntz, pickup_datetime timestamp_ntz, trip_miles double, trip_time double, base_passenger_fare double, tips double, driver_pay double"
ZONES = "LocationID int, Borough string, Zone string, service_zone string"
PURPOSE_MIX = "commute double, social double, errand double, airport double"
TRACE_KEYS = ("run_id", "config")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_raw_trips(spark: SparkSession, path: str) -> DataFrame:
    """Raw trip records under the declared schema."""
    return spark.read.schema(RAW_TRIPS).parquet(path)


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """The zone dimension, a CSV file with a header."""
    return spark.read.schema(ZONES).csv(path, header=True)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_personas(personas: DataFrame, path: str) -> None:
    """Personas at rest: the purpose mix is one JSON text column."""
    mix = F.to_json(F.struct(*(F.col(c.split()[0]) for c in PURPOSE_MIX.split(", "))))
    personas.withColumn("trip_purpose_mix", mix).drop(*(c.split()[0] for c in PURPOSE_MIX.split(", "))).write.mode("overwrite").parquet(path)


def read_personas(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("mix", F.from_json("trip_purpose_mix", PURPOSE_MIX)).select("*", "mix.*").drop("mix", "trip_purpose_mix")


def write_trace(trace: DataFrame, path: str) -> None:
    """Decision traces, one folder per run and configuration; only folders that the trace has are replaced."""
    trace.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*TRACE_KEYS).parquet(path)


def write_run(df: DataFrame, path: str, run_id: str) -> None:
    """A run's results, in a folder of their own beside those of other runs."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def read_run(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """The results of one run, or of all of them; the run is the last column and always text."""
    df = spark.read.parquet(path).withColumn("run_id", F.col("run_id").cast("string"))
    return df if run_id is None else df.where(F.col("run_id") == run_id)


def read_trace(spark: SparkSession, path: str, run_id: str | None = None, config: str | None = None) -> DataFrame:
    """A trace; run and configuration prune folders and are always text."""
    df = spark.read.parquet(path)
    df = df.withColumns({name: F.col(name).cast("string") for name in TRACE_KEYS})
    for name, value in zip(TRACE_KEYS, (run_id, config), strict=True):
        df = df if value is None else df.where(F.col(name) == value)
    return df


def list_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*TRACE_KEYS).distinct().orderBy(*TRACE_KEYS)


def read_json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json_document(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def write_metrics_document(metrics: DataFrame, path: str, seed: int, provider: str = "offline") -> None:
    """A run's metrics as one nested JSON document: run_id, provider, seed and an object for each configuration."""
    figures = F.struct(*(c for c in metrics.columns if c not in ("run_id", "config")))
    configs = F.map_from_entries(F.collect_list(F.struct("config", figures.alias("figures"))))
    document = metrics.groupBy("run_id").agg(configs.alias("configs"))  # a run has a handful of configurations
    text = F.to_json(F.struct("run_id", F.lit(provider).alias("provider"), F.lit(seed).alias("seed"), "configs"), {"ignoreNullFields": "false"})
    document.select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_metrics_document(spark: SparkSession, path: str) -> DataFrame:
    """run_id, provider, seed and ``configs``, a map of each configuration's figures as JSON."""
    return spark.read.text(path).select(F.from_json("value", "run_id string, provider string, seed long, configs map<string,string>").alias("d")).select("d.*")
