"""Exact quantiles of groups, and the arrival of a month's file."""

import random
import shutil
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from farelens.functions import stats as S
from farelens.sources import arrival


def test_quantiles_of_one_group_of_all_rows_with_distinct_values(spark):
    rows = spark.range(60_000).select(F.lit("z").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 7.0).alias("v"))
    got = S.grouped_quantiles(rows, ["g"], "v", {"a": 0.5, "b": 0.9, "c": 0.0, "d": 1.0}).collect()
    values = np.array([r.v for r in rows.collect()])
    assert len(got) == 1 and got[0].n == 60_000
    assert [got[0].a, got[0].b, got[0].c, got[0].d] == pytest.approx(np.quantile(values, [0.5, 0.9, 0, 1]).tolist(), rel=1e-12)


def test_quantiles_match_numpy_on_odd_groups(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 2), rng.choice([None, 1.0, 1.0, 2.5, -3.0, rng.random()])) for _ in range(400)] + [("only", 0, None), ("one", 0, 4.0)]
    frame = spark.createDataFrame(rows, "g string, h long, v double")
    got = {(r.g, r.h): (r.n, r.m, r.q) for r in S.grouped_quantiles(frame, ["g", "h"], "v", {"m": 0.5, "q": 0.37}).collect()}
    groups = {}
    for g, h, v in rows:
        if v is not None:
            groups.setdefault((g, h), []).append(v)
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert got[k] == (len(v), pytest.approx(np.quantile(v, 0.5)), pytest.approx(np.quantile(v, 0.37)))
    assert S.grouped_quantiles(frame.limit(0), ["g"], "v", {"m": 0.5}).count() == 0


COLUMNS = "request_datetime timestamp, pickup_datetime timestamp, trip_miles double, extra string"


def _month(spark, path, n=50, kind=COLUMNS):
    spark.range(n).selectExpr("timestamp'2024-01-05 10:00:00' AS request_datetime", "timestamp'2024-01-05 10:05:00' AS pickup_datetime", "CAST(id AS DOUBLE) AS trip_miles", "'x' AS extra").selectExpr(*(f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in kind.split(", "))).coalesce(1).write.parquet(path)
    return path


WANTED = "request_datetime timestamp, pickup_datetime timestamp, trip_miles double"


def test_a_month_arrives_whole_and_once(spark, tmp_path):
    store = f"{tmp_path}/store"
    assert arrival.months(spark, store) == [] and arrival.read_month(spark, store, "2024-01", WANTED).count() == 0
    first = _month(spark, f"{tmp_path}/in1")
    got = arrival.arrive(spark, first, store, "2024-01", WANTED)
    assert got.rows == 50 and got.added and arrival.months(spark, store) == ["2024-01"]
    again = arrival.arrive(spark, first, store, "2024-01", WANTED)
    assert again.rows == 50 and not again.added and arrival.read_month(spark, store, "2024-01", WANTED).count() == 50
    other = arrival.arrive(spark, _month(spark, f"{tmp_path}/in2", 70), store, "2024-02", WANTED)
    assert other.added and arrival.months(spark, store) == ["2024-01", "2024-02"] and arrival.row_count(spark, store, "2024-02") == 70


def test_broken_short_and_foreign_files_are_refused(spark, tmp_path):
    store, good = f"{tmp_path}/store", _month(spark, f"{tmp_path}/good")
    file = next(p for p in (tmp_path / "good").iterdir() if p.suffix == ".parquet")
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "part.parquet").write_bytes(file.read_bytes()[:-40])
    with pytest.raises(arrival.RefusedError, match="footer"):
        arrival.arrive(spark, f"{tmp_path}/cut", store, "2024-01", WANTED)
    (tmp_path / "none").mkdir()
    with pytest.raises(arrival.RefusedError, match="no file"):
        arrival.arrive(spark, f"{tmp_path}/none", store, "2024-01", WANTED)
    with pytest.raises(arrival.RefusedError, match="trip_miles"):
        arrival.arrive(spark, _month(spark, f"{tmp_path}/lacks", kind="request_datetime timestamp, pickup_datetime timestamp, extra string"), store, "2024-01", WANTED)
    with pytest.raises(arrival.RefusedError, match="trip_miles"):
        arrival.arrive(spark, _month(spark, f"{tmp_path}/text", kind="request_datetime timestamp, pickup_datetime timestamp, trip_miles string"), store, "2024-01", WANTED)
    with pytest.raises(arrival.RefusedError, match="rows"):
        arrival.arrive(spark, good, store, "2024-01", WANTED, least_rows=51)
    assert arrival.months(spark, store) == []


def test_a_month_that_is_being_written_is_not_seen(spark, tmp_path):
    store, good = f"{tmp_path}/store", _month(spark, f"{tmp_path}/good")
    arrival.arrive(spark, good, store, "2024-01", WANTED)
    shutil.move(tmp_path / "store" / "manifests", tmp_path / "kept")  # as if the writer had stopped before its commit
    assert arrival.months(spark, store) == [] and arrival.read_month(spark, store, "2024-01", WANTED).count() == 0
    assert arrival.arrive(spark, good, store, "2024-01", WANTED).added and arrival.read_month(spark, store, "2024-01", WANTED).count() == 50


def test_two_arrivals_at_once_leave_one(spark, tmp_path):
    store, good = f"{tmp_path}/store", _month(spark, f"{tmp_path}/good")
    added = []
    threads = [threading.Thread(target=lambda: added.append(arrival.arrive(spark, good, store, "2024-03", WANTED).added)) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sum(added) == 1 and arrival.read_month(spark, store, "2024-03", WANTED).count() == 50


def test_rows_are_counted_without_reading_them(spark, tmp_path):
    """The counted file's pages are overwritten with zeros; its footer still tells the number of rows."""
    _month(spark, f"{tmp_path}/good", 500)
    file = next(p for p in (tmp_path / "good").iterdir() if p.suffix == ".parquet")
    data = bytearray(file.read_bytes())
    footer = int.from_bytes(data[-8:-4], "little")
    data[4 : len(data) - 8 - footer] = bytes(len(data) - 12 - footer)
    (tmp_path / "blank").mkdir()
    (tmp_path / "blank" / "a.parquet").write_bytes(bytes(data))
    assert arrival.footer_rows(spark, f"{tmp_path}/blank").agg(F.sum("rows")).first()[0] == 500
