"""The stored response cache and conversations with tools."""

import threading

import pytest
from pyspark.sql import functions as F

from farelens.operators import agent_io, tool_rounds

CACHE = "key string, response_json string, created_at double"


def _files_read(df):
    """How many files the scans of a query that has run have opened."""
    df.collect()
    todo, n = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            node = node.executedPlan()
        if hasattr(node, "plan") and "QueryStage" in node.getClass().getSimpleName():
            node = node.plan()
        metric = node.metrics().get("numFiles")
        n += metric.get().value() if metric.isDefined() else 0
        children = node.children()
        todo += [children.apply(k) for k in range(children.length())]
    return n


def _cache(spark, rows):
    return spark.createDataFrame(rows, CACHE)


def test_a_point_lookup_opens_one_folder(spark, tmp_path):
    path = f"{tmp_path}/c"
    many = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("response_json"), F.lit(1.0).alias("created_at"))
    agent_io.cache_put(many, path)
    key = many.where("response_json = 'r77'").first().key
    point = agent_io.cache_point(spark, path, key)
    assert _files_read(agent_io.cache_get(spark, path)) >= 60 and _files_read(point) == 1
    assert [r.response_json for r in point.collect()] == ["r77"] and agent_io.cache_point(spark, path, "no such key").count() == 0
    agent_io.cache_put(_cache(spark, [(key, "newer", 2.0)]), path)
    point = agent_io.cache_point(spark, path, key)
    assert _files_read(point) == 2 and point.first().response_json == "newer"


def test_a_lookup_keeps_every_request_and_compaction_changes_no_answer(spark, tmp_path):
    path = f"{tmp_path}/c"
    for stamp in range(5):
        agent_io.cache_put(_cache(spark, [(f"k{k}", f"{k}:{stamp}", float(stamp)) for k in range(stamp, 40)]), path)
    asked = spark.createDataFrame([(f"k{k}", k) for k in (3, 3, 39, 0, 99)] + [(None, 7)], "key string, n int")
    want = sorted(map(tuple, agent_io.cache_lookup(asked, path).collect()), key=str)
    assert [w[2] for w in want if w[0] in ("k3", "k0")] == ["0:0", "3:3", "3:3"] and len(want) == 6 and sum(w[2] is None for w in want) == 2
    before = sorted(map(tuple, agent_io.cache_get(spark, path).collect()))
    old = agent_io.cache_compact(spark, path)
    assert sorted(map(tuple, agent_io.cache_get(spark, path).collect())) == before  # old and new files side by side
    agent_io.cache_put(_cache(spark, [("k0", "late", 9.0)]), path)  # between compaction and vacuum
    agent_io.cache_vacuum(spark, old)
    after = dict(r[:2] for r in map(tuple, agent_io.cache_get(spark, path).collect()))
    assert after == {k: v for k, v, _ in before} | {"k0": "late"} and spark.read.parquet(path).select("put").distinct().count() == 2 and len(old) == 5


def test_concurrent_puts_lose_nothing(spark, tmp_path):
    path = f"{tmp_path}/c"
    put = lambda n: agent_io.cache_put(_cache(spark, [(f"w{n}-{k}", "x", 1.0) for k in range(20)]), path)
    threads = [threading.Thread(target=put, args=(n,)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert agent_io.cache_get(spark, path).count() == 80


def _offers(spark, n=3):
    return spark.createDataFrame([(k, 10.004 + k) for k in range(n)], "offer_id long, quoted_fare double")


def _answers(spark, rows):
    return spark.createDataFrame([(k, step, content, [("c", name, arguments) for name, arguments in calls]) for k, step, content, calls in rows], f"offer_id long, step string, content string, calls {tool_rounds.CALLS}")


GOOD = '{"action": "accept", "reasoning": "fine", "confidence": 0.9, "reservation_fare": 3, "tools_called": []}'


def test_rounds_answer_calls_in_their_order_and_stop(spark):
    prices = spark.createDataFrame([(1, 2, 7)], "zone long, to_zone long, fare long")
    tools = {"price": (prices, {"a": "zone", "b": "to_zone"})}
    calls = [("price", {"a": 1, "b": 2}), ("weather", {}), ("price", {"a": 1}), ("price", {"a": 5, "b": 5})]
    rows = [(0, "0", "hm", calls), (0, "1", GOOD, []), (1, "0", None, [("price", {"a": 1, "b": 2})]), (1, "1", "x", [("price", {"a": 1, "b": 2})]), (1, "2", "y", [("price", {"a": 1, "b": 2})]), (1, "repair", GOOD, []), (2, "0", GOOD, [])]
    log = {r.offer_id: r for r in tool_rounds.converse(_offers(spark), F.lit("q"), tools, tool_rounds.scripted(_answers(spark, rows))).collect()}
    assert {k: r.parse_ok for k, r in log.items()} == {0: True, 1: True, 2: True}
    assert log[0].tools_called == ["price", "weather", "price", "price"] and log[1].tools_called == ["price", "price"] and log[2].tools_called == []
    assert [m.content for m in log[0].messages if m.role == "tool"] == ['{"result":{"fare":7},"tool":"price"}', '{"result":{"error":"unknown tool \'weather\'"},"tool":"weather"}', '{"result":{"error":"invalid arguments for price"},"tool":"price"}', '{"result":{"fare":null},"tool":"price"}']
    assert [m.role for m in log[1].messages] == ["user", "assistant", "tool", "assistant", "tool", "assistant", "user"]  # the third call is read as an output, and sent back
    fields = {"offer_id", "action", "confidence", "reservation_fare", "prompt_version", "tools_called", "parse_ok", "logged_at"}
    assert fields <= set(log[0].asDict()) and log[0].logged_at is not None


def test_two_broken_outputs_and_silence_fall_back(spark):
    rows = [(0, "0", "no", []), (0, "repair", "no", []), (1, "0", '{"action": "fly"}', []), (1, "repair", GOOD, [])]
    log = {r.offer_id: r for r in tool_rounds.converse(_offers(spark), F.lit("q"), {}, tool_rounds.scripted(_answers(spark, rows))).collect()}
    assert (log[0].action, log[0].confidence, log[0].reservation_fare, log[0].parse_ok) == ("reject", 0.0, 10.0, False)
    assert log[1].parse_ok and log[1].action == "accept" and not log[2].parse_ok  # the backend never answers the third
    assert tool_rounds.converse(_offers(spark, 0), F.lit("q"), {}, tool_rounds.scripted(_answers(spark, rows))).count() == 0


def test_an_offer_without_persona_stops_the_logit_baseline_too(spark, folder):
    from farelens.operators import logit
    from farelens.plans import registry

    i = registry.Inputs(spark, folder)
    model = logit.fit(logit.training_rows(i.trips, 7))
    with pytest.raises(Exception, match="no persona for rider"):
        logit.logit_decisions(i.offers, i.personas.where("rider_id % 2 = 0"), model, 7).collect()
