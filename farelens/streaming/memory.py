"""A rider's memory as keyed state: decisions stream in, each comes out with what its rider remembered before it.

State per rider: counters, the last ``k`` episodes of every set of traits (purpose, origin, surge band), and the waits quoted for
accepted offers whose outcome is still to come. Of episodes with equal traits only the last ``k`` can be among the ``k`` most similar,
so the state follows the number of trait sets and open outcomes, not the number of decisions. An event-time timer drops the state
of a rider that has been at rest for long.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from farelens.functions import exprs as X
from farelens.operators.memory import BAD_WAIT_SLACK, HIGH_SURGE, MATCHES

DAY_MS = 86_400_000
_OUT = "rider_id long, offer_id long, seq long, episodes_total long, paid long, n_paid long, n_high long, k_high long, bad_wait_experiences long, recalled array<struct<similarity:bigint,episode_seq:bigint>>"


class RiderMemory(StatefulProcessor):
    """``k``: episodes recalled; ``rest_days``: a rider's state is dropped so long after the last event (None: never)."""

    def __init__(self, k: int = 5, rest_days: int | None = 365):
        self.k, self.rest_days = k, rest_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("memory", StructType([StructField("memory", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - names of the interface
        stored = self.state.get() if self.state.exists() else None
        m = {"n": 0, "paid": 0, "n_paid": 0, "n_high": 0, "k_high": 0, "bad": 0, "traits": {}, "open": {}} if stored is None else json.loads(stored[0])
        batch = pd.concat(list(rows)).sort_values(["at_ms", "offer_id"], kind="stable")  # a rider's rows of one batch
        out = [self._decided(key[0], m, r) for r in batch.itertuples(index=False) if not self._realized(m, r)]
        self.state.update((json.dumps(m, separators=(",", ":")),))
        if self.rest_days is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(batch["at_ms"].max()) + self.rest_days * DAY_MS)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    def _realized(self, m: dict, r) -> bool:
        """An outcome that comes by itself fills in the latest episode of its offer."""
        if r.decision:
            return False
        eta = m["open"].pop(str(r.offer_id), None)
        if eta is not None:
            self._outcome(m, r.paid, r.realized_wait, eta)
        return True

    @staticmethod
    def _outcome(m: dict, paid, wait, eta: float) -> None:
        if not pd.isna(paid):
            m["paid"], m["n_paid"] = m["paid"] + int(paid), m["n_paid"] + 1
        m["bad"] += int(not pd.isna(wait) and wait > eta + BAD_WAIT_SLACK)

    def _decided(self, rider: int, m: dict, r) -> tuple:
        traits = [r.purpose, int(r.origin_zone), float(r.band)]
        points = list(MATCHES.values())
        scored = ((sum(p for p, a, b in zip(points, json.loads(t), traits, strict=True) if a == b), seq) for t, seqs in m["traits"].items() for seq in seqs)
        best = [{"similarity": s, "episode_seq": e} for s, e in heapq.nlargest(self.k, scored)]
        seq = m["n"] + 1
        row = (rider, int(r.offer_id), seq, m["n"], m["paid"], m["n_paid"], m["n_high"], m["k_high"], m["bad"], best)
        m["n"] = seq
        m["n_high"], m["k_high"] = m["n_high"] + int(r.high), m["k_high"] + int(r.high and r.accepted)
        same = m["traits"].setdefault(json.dumps(traits), [])
        same.append(seq)
        del same[: -self.k]
        if pd.isna(r.paid) and pd.isna(r.realized_wait):
            if r.accepted:
                m["open"][str(r.offer_id)] = float(r.eta_min)
        else:
            self._outcome(m, r.paid, r.realized_wait, float(r.eta_min))
        return row

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def remember(decisions: DataFrame, k: int = 5, rest_days: int | None = 365, late: str = "1 day") -> DataFrame:
    """A stream of decisions (rider_id, offer_id, event_time, purpose, origin_zone, surge, action, eta_min, realized_fare,
    realized_wait) as a stream of what was remembered at each: counts, means and the most similar episodes.

    A row whose ``action`` is null is an outcome alone. Rows of a rider are taken by event time within a batch, and batch
    after batch; rows later than the watermark are dropped.
    """
    rows = decisions.withWatermark("event_time", late).select(
        "rider_id", "offer_id", "event_time", F.unix_millis("event_time").alias("at_ms"), F.coalesce("purpose", F.lit("")).alias("purpose"), F.coalesce("origin_zone", F.lit(0)).cast("long").alias("origin_zone"), F.coalesce(X.surge_band("surge"), F.lit(0.0)).alias("band"),
        F.coalesce(F.col("surge") > HIGH_SURGE, F.lit(False)).alias("high"), F.col("action").isNotNull().alias("decision"), F.coalesce(F.col("action") == "accept", F.lit(False)).alias("accepted"),
        F.coalesce(F.col("eta_min").cast("double"), F.lit(0.0)).alias("eta_min"), F.round(F.col("realized_fare") * 10_000).cast("long").alias("paid"), F.col("realized_wait").cast("double").alias("realized_wait"),
    )
    kept = rows.groupBy("rider_id").transformWithStateInPandas(RiderMemory(k, rest_days), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")
    return kept.select(
        "rider_id", "offer_id", "seq", "episodes_total", X.rounded(F.try_divide(F.col("paid") / 10_000.0, F.col("n_paid")), 2).alias("mean_fare_paid"),
        X.rounded(F.try_divide(F.col("k_high") * 1.0, F.col("n_high")), 3).alias("accept_rate_high_surge"), "bad_wait_experiences", "recalled",
    )
