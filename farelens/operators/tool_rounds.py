"""Conversations with tools: rounds of calls and answers over all open conversations at once.

A conversation is a row: its offer, its messages so far and the tools it has called. A round takes the conversations
whose last answer calls tools, parses the calls out, answers them by joins with lookup tables, appends call and
results as messages, and asks the backend again. After ``most_rounds`` rounds the last answer is read as a decision whatever it
is; one that breaks a rule is sent back once with its error, and if the second one breaks a rule too, the fallback rejects.

The backend is any function from requests (key, step, messages) to answers (key, content, calls), so scripted answers are a
join and a service is a stage of its own; each round is one pass over what is still open. Rounds are written as tables, so no
answer is asked for twice by a plan that reads it twice.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelens.operators import agent_io
from farelens.sources.staging import discard, materialize

CALLS = "array<struct<id:string,name:string,arguments:map<string,bigint>>>"
MESSAGES = "array<struct<role:string,content:string>>"
REPAIR = "repair"
#: Fixed value: what a decision says that no valid output stands behind.
FALLBACK = "model output failed validation twice; recorded as parse failure"
Backend = Callable[[DataFrame], DataFrame]


def scripted(answers: DataFrame, key: str = "offer_id") -> Backend:
    """A backend of written answers: key, step ('0', '1', ... or 'repair'), content, calls."""
    return lambda requests: requests.select(key, "step").join(answers, [key, "step"], "left").select(key, "content", F.coalesce("calls", F.array().cast(CALLS)).alias("calls"))


def answer_calls(calls: DataFrame, tools: dict[str, tuple[DataFrame, dict[str, str]]], key: str = "offer_id") -> DataFrame:
    """key, results: a conversation's tool messages in the order of its calls.

    ``tools``: name -> (table with one row per arguments, argument -> column of the table). An unknown tool or a missing argument is
    answered with an error, as is a place the table does not know with its nulls.
    """
    done = []
    message = lambda result: F.to_json(F.struct(result.alias("result"), F.col("name").alias("tool")), {"ignoreNullFields": "false"})
    for name, (table, columns) in tools.items():
        asked = calls.where(F.col("name") == name)
        given = {c: F.try_element_at("arguments", F.lit(a)) for a, c in columns.items()}
        whole = reduce(Column.__and__, (v.isNotNull() for v in given.values()))
        found = asked.where(whole).withColumns(given).join(table, [*columns.values()], "left")
        result = F.struct(*(F.col(c) for c in sorted(c for c in table.columns if c not in columns.values())))
        done.append(found.select(key, "at", message(result).alias("content")))
        lacking = F.struct(F.lit(f"invalid arguments for {name}").alias("error"))
        done.append(asked.where(~F.coalesce(whole, F.lit(False))).select(key, "at", message(lacking).alias("content")))
    unknown = F.struct(F.concat(F.lit("unknown tool '"), F.coalesce("name", F.lit("")), F.lit("'")).alias("error"))
    done.append(calls.where(~F.coalesce(F.col("name").isin(*tools), F.lit(False))).select(key, "at", message(unknown).alias("content")))
    every = reduce(DataFrame.unionByName, done)
    # the calls of one answer, as many as the model wrote
    return every.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "content"))), lambda x: F.struct(F.lit("tool").alias("role"), x["content"].alias("content"))).alias("results"))


def converse(offers: DataFrame, prompt: Column, tools: dict[str, tuple[DataFrame, dict[str, str]]], backend: Backend, most_rounds: int = 2, version: str = "v1", logged_at: Column | None = None, key: str = "offer_id", fare: str = "quoted_fare") -> DataFrame:
    """The decision log: key, action, confidence, reservation_fare, prompt_version, tools_called, parse_ok, logged_at, and beside it
    reasoning, messages and the last error. ``offers`` has one row per key."""
    said = lambda role, content: F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))
    opened = offers.select(key, F.col(fare).cast("double").alias("_fare"), said("user", prompt).cast(MESSAGES).alias("messages"), F.array().cast("array<string>").alias("tools_called"))
    tables, settled = [], []

    def asked(conversations: DataFrame, step: str) -> DataFrame:
        requests = materialize(conversations, f"requests-{step}")
        answers = backend(requests.select(key, "messages", F.lit(step).alias("step")))
        tables.append(materialize(requests.join(answers, key, "left").withColumn("calls", F.coalesce("calls", F.array().cast(CALLS))), f"answers-{step}"))
        discard(requests)
        return tables[-1]

    open_ = asked(opened, "0")
    for r in range(1, most_rounds + 1):
        calling = open_.where(F.size("calls") > 0)
        settled.append(open_.where(F.size("calls") == 0))
        calls = calling.select(key, F.posexplode("calls").alias("at", "_call")).select(key, "at", "_call.name", "_call.arguments")
        going = calling.join(answer_calls(calls, tools, key), key)
        messages = F.concat("messages", said("assistant", F.coalesce("content", F.lit(""))), "results")
        open_ = asked(going.select(key, "_fare", messages.cast(MESSAGES).alias("messages"), F.concat("tools_called", F.transform("calls", lambda c: c["name"])).alias("tools_called")), str(r))
    settled.append(open_)
    last = reduce(DataFrame.unionByName, settled).select(key, "_fare", "messages", "tools_called", "content")
    first = materialize(agent_io.parse_decisions(last, "content"), "parsed")
    broken = first.where("decision IS NULL")
    sent_back = F.concat("messages", said("assistant", F.coalesce("content", F.lit(""))), said("user", agent_io.repair_prompt(F.coalesce("content", F.lit("")), F.col("error"))))
    again = asked(broken.select(key, "_fare", sent_back.cast(MESSAGES).alias("messages"), "tools_called"), REPAIR)
    second = agent_io.parse_decisions(again.select(key, "_fare", "messages", "tools_called", "content"), "content")
    whole = F.struct(*(F.col(f"decision.{f}") for f in ("action", "reasoning", "confidence", "reservation_fare")))
    nothing = F.struct(F.lit("reject").alias("action"), F.lit(FALLBACK).alias("reasoning"), F.lit(0.0).alias("confidence"), (F.round(F.col("_fare") * 100.0) / 100.0).alias("reservation_fare"))
    good = first.where("decision IS NOT NULL").select(key, "messages", "tools_called", "error", whole.alias("d"), F.lit(True).alias("parse_ok"))
    mended = second.select(key, "messages", "tools_called", "error", F.when(F.col("decision").isNotNull(), whole).otherwise(nothing).alias("d"), F.col("decision").isNotNull().alias("parse_ok"))
    out = good.unionByName(mended)
    return out.select(key, "d.action", "d.confidence", "d.reservation_fare", F.lit(version).alias("prompt_version"), "tools_called", "parse_ok", (F.current_timestamp() if logged_at is None else logged_at).alias("logged_at"), "d.reasoning", "messages", "error")
