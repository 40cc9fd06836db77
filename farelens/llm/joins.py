"""Joins that no single key can slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more left rows than this, and than one row in HOT_KEYS, is joined by broadcast.
HOT_ROWS = 100_000
HOT_KEYS = 1000
#: Broadcast rows of hot keys hold this many bytes at most; beyond, they are joined like the others.
HOT_BYTES = 32 << 20


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame | None = None, rows: int | None = None, how: str = "inner") -> DataFrame:
    """Inner or left join with a table in which each key stands once.

    ``left`` is a table at rest or cheap to read again; ``counts`` (keys and ``n``) and ``rows`` save the count of its keys.
    Rows of a hot key stay where they are: the right rows of at most HOT_KEYS hot keys are broadcast, after
    a check of their bytes. All other keys have at most max(HOT_ROWS, rows / HOT_KEYS) rows in a task.
    """
    rows = left.count() if rows is None else rows
    if rows <= HOT_ROWS:
        return left.join(right, keys, how)
    counts = left.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts
    hot = counts.where(F.col("n") > max(HOT_ROWS, rows // HOT_KEYS)).select(*keys)
    few = hot.collect()  # HOT_KEYS keys at most
    if not few:
        return left.join(right, keys, how)
    hot = left.sparkSession.createDataFrame([tuple(r) for r in few], hot.schema)
    sent = right.join(F.broadcast(hot), keys)
    wide = [c for c, kind in right.dtypes if kind in ("string", "binary")]
    size = sent.agg(F.coalesce(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in wide), F.lit(64))), F.lit(0)).alias("n")).first()["n"]
    if size > HOT_BYTES:
        return left.join(right, keys, how)
    rest = left.join(F.broadcast(hot), keys, "left_anti").join(right, keys, how)
    return left.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(sent), keys, how).unionByName(rest)
