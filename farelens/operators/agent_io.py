"""Messages to and from language-model agents: prompts, parsing, cache and cost, as DataFrame operators."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farelens.functions import exprs as X
from farelens.functions import stats as S
from farelens.sources.staging import delete

#: Dollars per million tokens (input, output) by provider.
PRICES = {"anthropic": (3.0, 15.0), "openai": (0.15, 0.6)}
MAX_WORDS = 60
MAX_REPAIR_CHARS = 2000
DECISION = "action string, reasoning string, confidence double, reservation_fare double, tools_called array<string>"
PROMPT = "Decide on a ride offer.\n\n```json\n{{persona_json}}\n```\n\n```json\n{{memory_json}}\n```\n\n```json\n{{offer_json}}\n```\n"


def canonical_json(*columns: str) -> Column:
    """JSON of the columns with sorted keys."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def render_prompt(template: str, persona_json: Column, memory_json: Column, offer_json: Column) -> Column:
    out = F.lit(template)
    for name, value in (("persona_json", persona_json), ("memory_json", memory_json), ("offer_json", offer_json)):
        out = F.replace(out, F.lit("{{" + name + "}}"), value)
    return out


def fenced_json(text: Column | str, number: int) -> Column:
    """The body of the n-th fenced JSON block (from 0), null if there are fewer."""
    return F.try_element_at(F.regexp_extract_all(X.col(text), F.lit("(?s)```json\\s*(.*?)\\s*```"), F.lit(1)), F.lit(number + 1))


def repair_prompt(raw: Column, error: Column) -> Column:
    return F.concat(F.lit("Return one JSON decision only. Error: "), error, F.lit("\nOutput was:\n"), F.substring(raw, 1, MAX_REPAIR_CHARS))


def _first_object(text: str | None) -> str | None:
    """The first JSON object inside a text, out of a fence if there is one."""
    decoder, at = json.JSONDecoder(), (text or "").find("{")
    while text and at >= 0:
        try:
            value, _ = decoder.raw_decode(text, at)
            if isinstance(value, dict):
                return json.dumps(value)
        except json.JSONDecodeError:
            pass
        at = text.find("{", at + 1)
    return None


def plain_object(text: Column | str) -> Column:
    """What follows the first brace, where a JSON object begins there; else null. Readers ignore what follows an object."""
    rest = F.regexp_extract(X.col(text), r"(?s)(\{.*)", 1)
    return F.when(F.try_parse_json(rest).isNotNull(), rest)


def parse_decisions(outputs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``decision`` (struct, null if it breaks a rule) and ``error``.

    An object at the first brace is read in the JVM. Only texts whose first brace opens something else go
    to a scanner, a small vectorized function; validation is columns.
    """

    @F.pandas_udf("string")
    def scan(s: pd.Series) -> pd.Series:
        return s.map(_first_object)

    plain = outputs.withColumn("_plain", plain_object(text))
    found = plain.withColumn("_json", F.coalesce("_plain", scan(F.when(F.col("_plain").isNull(), F.col(text))))).drop("_plain")
    out = found.withColumn("decision", F.from_json("_json", DECISION))
    known = F.array(*(F.lit(f.split()[0]) for f in DECISION.split(", ")))
    d = lambda f: F.col(f"decision.{f}")
    error = (
        F.when(F.col("_json").isNull(), "no JSON object found in output")
        .when(F.size(F.array_except(F.json_object_keys("_json"), known)) > 0, "extra field")
        .when(~F.coalesce(d("action").isin(*X.ACTIONS), F.lit(False)), "action")
        .when(F.coalesce(X.word_count(d("reasoning")), F.lit(MAX_WORDS + 1)) > MAX_WORDS, "reasoning")
        .when(~F.coalesce(d("confidence").between(0, 1), F.lit(False)), "confidence")
        .when(~F.coalesce(d("reservation_fare") >= 0, F.lit(False)), "reservation_fare")
    )
    return out.withColumn("error", error).withColumn("decision", F.when(F.col("error").isNull(), F.col("decision"))).drop("_json")


def resolve_decisions(parsed: DataFrame, repaired: DataFrame, key: str, fare: str = "quoted_fare") -> DataFrame:
    """First parse, else the repaired one, else a rejection at confidence 0 with the fare as reservation."""
    fallback = F.struct(F.lit("reject").alias("action"), F.lit("fallback").alias("reasoning"), F.lit(0.0).alias("confidence"), F.col(fare).cast("double").alias("reservation_fare"), F.array().cast("array<string>").alias("tools_called"))
    second = repaired.select(key, F.col("decision").alias("_second"))
    out = parsed.join(second, key, "left")
    return out.withColumn("parse_ok", F.col("decision").isNotNull() | F.col("_second").isNotNull()).withColumn("decision", F.coalesce("decision", "_second", fallback)).drop("_second")


def cache_key(*columns: str) -> Column:
    return F.sha2(canonical_json(*columns).cast("binary"), 256)


def cache_upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """A cache (key, response_json, created_at) after an insert-or-replace; of equal keys the newest stays."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = Window.partitionBy("key").orderBy(F.desc("_new"), F.desc("created_at"), F.desc("response_json"))
    return both.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_new")


#: Folders of a stored cache; a key is in one of them.
CACHE_PARTS = 64
_STORED = "key string, response_json string, created_at double, put string, part long"


def _part(key: Column | str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(CACHE_PARTS)).alias("part")


def cache_put(new: DataFrame, path: str) -> None:
    """Adds responses (key, response_json, created_at) to a stored cache; nothing that is there is written again.

    A put has a folder of its own, so puts that run side by side lose nothing. In it, rows go into folders by a hash of their key,
    sorted by it, with a Bloom filter of the keys in every file.
    """
    rows = new.select("key", "response_json", F.col("created_at").cast("double").alias("created_at"), _part("key"))
    dealt = rows.repartition("part").sortWithinPartitions("part", "key")
    dealt.write.mode("append").partitionBy("part").option("parquet.bloom.filter.enabled#key", "true").parquet(f"{path}/put={uuid.uuid4().hex}")


def _newest(stored: DataFrame) -> DataFrame:
    newest = stored.groupBy("key").agg(F.max(F.struct("created_at", "response_json")).alias("_n"))
    return newest.select("key", "_n.response_json", "_n.created_at")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_STORED).parquet(path)


def cache_get(spark: SparkSession, path: str) -> DataFrame:
    """A stored cache with one row per key: of several responses the newest, of equally new ones the last by text."""
    return _newest(_stored(spark, path))


def cache_point(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The cached response of one key, if there is one: the key's folder alone is opened."""
    part = spark.range(1).select(_part(F.lit(key))).first()["part"]
    return _newest(_stored(spark, path).where((F.col("part") == part) & (F.col("key") == key)))


def cache_lookup(requests: DataFrame, path: str) -> DataFrame:
    """Requests (key and more) with their cached response, null where there is none.

    Only the requests' folders are opened (the join prunes them at run time), and of the stored rows only those of
    requested keys are compared.
    """
    keys = requests.select("key").where("key IS NOT NULL").distinct().withColumn("part", _part("key"))
    found = _newest(_stored(requests.sparkSession, path).join(keys, ["part", "key"], "left_semi"))
    return requests.join(found, "key", "left")


def cache_compact(spark: SparkSession, path: str) -> list[str]:
    """Writes the newest response of each key as one put and returns the folders of the puts that are no longer needed.

    The new files stand beside the old ones, whose rows they repeat, so readers and puts may go on meanwhile;
    ``cache_vacuum`` deletes the old ones when no reader that began before is left.
    """
    puts = sorted({re.match(r".*/put=[^/]+", file)[0] for file in _stored(spark, path).inputFiles()})  # names only; a put that ends from here on is kept
    cache_put(_newest(spark.read.schema(_STORED).option("basePath", path).parquet(*puts)), path)
    return puts


def cache_vacuum(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        delete(spark, folder)


def cache_hits(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache.select("key", "response_json"), "key")


def cache_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache.select("key"), "key", "left_anti")


def token_cost(messages: DataFrame, provider: str = "anthropic", prices: tuple[float, float] | None = None) -> DataFrame:
    """Per conversation: estimated input and output tokens and dollars. Assistant messages are output."""
    price_in, price_out = prices or PRICES.get(provider, (0.0, 0.0))
    t = X.token_estimate(F.coalesce("text", F.lit("")))
    out = F.col("role") == "assistant"
    per = messages.groupBy("conv_id").agg(F.sum(F.when(~out, t).otherwise(0)).alias("input_tokens"), F.sum(F.when(out, t).otherwise(0)).alias("output_tokens"))
    return per.withColumn("cost_usd", (F.col("input_tokens") * price_in + F.col("output_tokens") * price_out) / 1e6)


def cost_per_thousand(cost: Column, n: Column) -> Column:
    return F.when(n > 0, cost / n * 1000.0).otherwise(0.0)


def latency_percentiles(decisions: DataFrame, latency: str, *keys: str) -> DataFrame:
    """Exact median and 95th percentile of a latency, by configuration or other keys of few values."""
    counted = decisions.where(F.col(latency).isNotNull()).groupBy(*keys, F.col(latency).cast("double").alias("_v")).agg(F.count("*").alias("n"))
    ranked = S.grouped_running(counted, list(keys), "_v", "n")
    covers = lambda at: (F.col("cum_n") - F.col("n") <= at) & (at < F.col("cum_n"))
    aggs = []
    for name, p in (("latency_p50", 0.5), ("latency_p95", 0.95)):
        place = (F.col("all_n") - 1) * F.lit(p)
        low, part = F.floor(place), place - F.floor(place)
        one, two = F.max(F.when(covers(low), F.col("_v"))), F.max(F.when(covers(F.ceil(place)), F.col("_v")))
        aggs.append((one + (two - one) * F.max(part)).alias(name))
    return ranked.groupBy(*keys).agg(F.max("all_n").alias("n"), *aggs)


def complete(requests: DataFrame, backend: Callable[[str], str], retries: int = 3, backoff: float = 1.0) -> DataFrame:
    """Answers (key, prompt) rows through a pluggable backend, batch by batch on the executors, with each answer's
    latency. A lost connection is tried again after ``backoff`` seconds, twice as long each time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers, took = [], []
            for prompt in batch["prompt"]:
                began = time.perf_counter()
                for attempt in range(retries + 1):
                    try:
                        answers.append(backend(prompt))
                        break
                    except ConnectionError:
                        if attempt == retries:
                            raise
                        time.sleep(backoff * 2**attempt)
                took.append(1000 * (time.perf_counter() - began))
            yield pd.DataFrame({"key": batch["key"], "text": answers, "latency_ms": took})

    return requests.select("key", "prompt").mapInPandas(run, "key string, text string, latency_ms double")
