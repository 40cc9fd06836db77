"""Column expressions of the trip, persona and offer vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zones of airports, and the limits of buckets, tiers and brackets.
AIRPORT_ZONES = (1, 132, 138)
PURPOSES = ("commute", "social", "errand", "airport")
ACTIONS = ("accept", "reject", "wait_for_better", "switch_mode")
TRANSIT_MPH = 12.0
TRANSIT_FARE = 2.90


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


def rounded(c: Column | str, digits: int) -> Column:
    """Half away from zero at ``digits`` places, by one multiplication and one division."""
    scale = float(10**digits)
    return F.round(col(c) * F.lit(scale)) / F.lit(scale)


def ladder(value: Column | str, steps: list[tuple[float, object]], last: object, strict: bool = True) -> Column:
    """The first step whose limit is above (``strict``) or not below the value, else ``last``."""
    out = F.lit(last)
    for limit, result in reversed(steps):
        out = F.when(col(value) < limit if strict else col(value) <= limit, F.lit(result)).otherwise(out)
    return out


def miles_bucket(miles: Column | str) -> Column:
    return ladder(miles, [(1, 0), (2, 1), (4, 2), (8, 3)], 4)


def weekend(ts: Column | str) -> Column:
    return F.dayofweek(col(ts)).isin(1, 7).cast("int")


def time_of_day(hour: Column | str) -> Column:
    return ladder(hour, [(5, "night"), (11, "morning"), (16, "midday")], "evening", strict=False)


def trip_purpose(pickup: str = "pickup_zone", dropoff: str = "dropoff_zone", hour: str = "pickup_hour", is_weekend: str = "is_weekend") -> Column:
    h = F.col(hour)
    airport = F.col(pickup).isin(*AIRPORT_ZONES) | F.col(dropoff).isin(*AIRPORT_ZONES)
    return (
        F.when(airport, "airport").when((h >= 21) | (h <= 4), "social")
        .when((F.col(is_weekend) == 0) & (h.between(6, 9) | h.between(15, 19)), "commute").otherwise("errand")
    )


def income_bracket(spend_rank: Column | str) -> Column:
    return ladder(spend_rank, [(0.25, "low"), (0.5, "middle"), (0.75, "upper_middle")], "high")


def loyalty_tier(trips: Column | str) -> Column:
    return ladder(trips, [(8, "member"), (15, "silver"), (25, "gold")], "platinum")


def surge_band(surge: Column | str) -> Column:
    """Half-unit bands, ties to even, 5 at most."""
    return F.least(F.bround(col(surge) * 2.0) / 2.0, F.lit(5.0))


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def in_band(c: Column | str, band: tuple[float, float]) -> Column:
    return (col(c) >= band[0]) & (col(c) < band[1])


def clamp_probability(p: Column) -> Column:
    return clip(p, 1e-6, 1 - 1e-6)


def token_estimate(text: Column | str) -> Column:
    """About four characters to a token, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(col(text)) / 4).cast("int"))


def word_count(text: Column | str) -> Column:
    trimmed = F.trim(col(text))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))
