"""Reproducible randomness: a uniform number is a hash of a seed and the row's keys."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many equal rows a cell's draws are looked up in its distribution function, entry by entry; beyond, the function is
#: inverted by its expansion in the normal quantile, which there is within a few hundredths of a row.
LISTED = 32
#: Rows whose draws of all replicates a task holds at once.
DRAWN_ROWS = 256
#: Rational approximation of the normal quantile (centre numerator and denominator, tail numerator and denominator, where the tail begins).
QUANTILE = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
)
TAIL = 0.02425


def hash_uniform(seed: int | str, *keys: Column | str) -> Column:
    """A number in [0, 1) from the first 32 bits of md5(seed:key:key...). Keys are integers or strings."""
    joined = F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_order(seed: int | str, *keys: Column | str) -> Column:
    """The hash itself as a whole number, to order rows by; ties are left to the keys."""
    return (hash_uniform(seed, *keys) * 4294967296.0).cast("long")


def dealt_out(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Rows dealt to as many tasks as there are cores or shuffle partitions: before each row becomes hundreds."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def replicate_weights(df: DataFrame, replicates: int, seed: int | str, *keys: Column | str) -> DataFrame:
    """Each row once for every bootstrap replicate (``replicate`` from 1) that draws it, with the number of draws ``w``.

    One md5 of (seed, block of eight replicates, keys) gives eight uniform numbers of 16 bits. Rows that a replicate
    does not draw are left out before anything is shuffled.
    """
    joined = F.concat_ws(":", F.lit(str(seed)), "_block", *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys))
    blocks = dealt_out(df, *keys).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // 8)))).withColumn("_h", F.md5(joined.cast("binary")))
    blocks = blocks.withColumns({f"_p{k}": F.conv(F.substring("_h", at, n), 16, 10).cast("long") for k, (at, n) in enumerate(((1, 12), (13, 12), (25, 8)))}).drop("_h")
    u = [F.shiftright(p, shift).bitwiseAND(F.lit(65535)) / F.lit(65536.0) for p, shifts in (("_p0", (32, 16, 0)), ("_p1", (32, 16, 0)), ("_p2", (16, 0))) for shift in shifts]
    draws = F.array(*(F.struct(F.lit(k).alias("at"), poisson_one(x).alias("w")) for k, x in enumerate(u, 1)))
    drawn = blocks.withColumn("_drawn", F.explode(draws)).select(*df.columns, (F.col("_block") * 8 + F.col("_drawn.at")).cast("int").alias("replicate"), F.col("_drawn.w").alias("w"))
    return drawn.where((F.col("w") > 0) & (F.col("replicate") <= replicates))


def poisson_edges() -> np.ndarray:
    """The 32-bit numbers at which a Poisson(1) count goes up by one; a count beyond them has no such number."""
    total, term, edges = 0.0, 0.36787944117144233, []
    for k in range(1, 20):
        total += term
        term /= k
        edges.append(math.ceil(total * 4294967296.0 - 0.5))
    return np.array([e for e in edges if e < 1 << 32], np.uint32)


def replicate_sums(rows: DataFrame, replicates: int, seed: int | str, key: str, groups: tuple[str, ...], values: tuple[str, ...], once: bool = False) -> DataFrame:
    """Bootstrap sums of every row on its own: per group and replicate (from 1) the number of draws ``n``, and each value's sum over the draws.

    ``rows`` has the column ``key``, which names what is drawn, and ``_e``, an array of structs with the ``groups`` and ``values`` that are drawn with it.
    A row's Poisson(1) count in a replicate (with ``once`` at most 1) comes from 32 bits of sha256(seed:block of eight replicates:key). Tasks add up
    their rows, so what is shuffled afterwards is tasks x groups x replicates.
    """
    prefixes, edges = [f"{seed}:{block}".encode() for block in range(-(-replicates // 8))], poisson_edges()

    def draws(keys: list[str | None]) -> np.ndarray:
        tails = [b"" if k is None else b":" + k.encode() for k in keys]
        u = np.frombuffer(b"".join([hashlib.sha256(p + t).digest() for t in tails for p in prefixes]), ">u4").reshape(len(keys), -1)[:, :replicates].astype(np.uint32)
        w = np.zeros(u.shape, np.uint8)
        for edge in edges:
            w += u >= edge
        return (np.minimum(w, 1) if once else w).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, DRAWN_ROWS):
                part = batch.slice(at, DRAWN_ROWS)
                told = part.column(1).flatten()
                if not len(told):
                    continue
                row = np.repeat(np.arange(part.num_rows), part.column(1).value_lengths().fill_null(0).to_numpy())
                code = np.zeros(len(told), np.int64)
                for name in groups:
                    coded = told.field(name).dictionary_encode(null_encoding="encode")
                    code = code * len(coded.dictionary) + coded.indices.to_numpy()
                _, first, group = np.unique(code, return_index=True, return_inverse=True)
                given = np.stack([np.ones(len(told)), *(pc.fill_null(told.field(v).cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False) for v in values)])
                spread = np.zeros((len(first), len(given), part.num_rows))
                for k, v in enumerate(given):
                    np.add.at(spread, (group, k, row), v)
                sums = (spread.reshape(-1, part.num_rows) @ draws(part.column(0).to_pylist())).reshape(len(first), len(given), replicates)
                for k, i in enumerate(first):
                    name = tuple(told.field(g)[int(i)].as_py() for g in groups)
                    found[name] = found[name] + sums[k] if name in found else sums[k]
        for name, sums in found.items():
            yield pa.RecordBatch.from_arrays([*(pa.array([g] * replicates, t) for g, t in zip(name, types, strict=True)), pa.array(np.arange(1, replicates + 1, dtype=np.int32)), *map(pa.array, sums)], names=[*groups, "replicate", "n", *values])

    entry = rows.schema["_e"].dataType.elementType
    types = [{"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[entry[g].dataType.simpleString()] for g in groups]
    schema = ", ".join((*(f"{g} {entry[g].dataType.simpleString()}" for g in groups), "replicate int", "n double", *(f"{v} double" for v in values)))
    partial = dealt_out(rows.select(F.col(key).cast("string").alias(key), "_e"), key).mapInArrow(run, schema)
    return partial.groupBy(*groups, "replicate").agg(F.sum("n").cast("long").alias("n"), *(F.sum(v).alias(v) for v in values))


#: Constants of md5: the start, what each step adds, and how far it rotates.
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ADDED = [int(abs(math.sin(i + 1)) * 4294967296.0) & 0xFFFFFFFF for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
#: Hashes that are worked on together, so that they stay in a core's cache.
_TOGETHER = 1 << 14


def _md5_first(words: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The first 32 bits of the md5 of one-block messages; ``words`` are a block's sixteen, of shapes that broadcast to ``shape``."""
    a, b, c, d = (np.full(shape, s, np.uint32) for s in _START)
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(61):  # the last three steps don't touch the first word
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
            g = 7 * i % 16
        turn = _TURNS[i // 16][i % 4]
        f += a
        f += words[g] + np.uint32(_ADDED[i])
        np.left_shift(f, np.uint32(turn), out=t)
        f >>= np.uint32(32 - turn)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return (b + np.uint32(_START[0])).byteswap()


def numbered_hashes(start: str, numbers: int, tails: list[bytes]) -> np.ndarray:
    """``hash_order`` of many numbers at once: for every tail (a row) and every n from 1 to ``numbers`` (a column) the first 32 bits of md5(start, n, tail).

    The sixteen words of a message are the same for all numbers but the one or two with digits in them, so a step of md5 is one operation on all
    of them. Messages beyond one block of 55 bytes are hashed one by one.
    """
    head, out = start.encode(), np.empty((len(tails), numbers), np.uint32)
    low = 1
    while low <= numbers:
        digits, high = len(str(low)), min(numbers, 10 ** len(str(low)) - 1)
        which = np.arange(low, high + 1)
        added: dict[int, np.ndarray] = {}
        for k in range(digits):
            place = len(head) + k
            digit = (which // 10 ** (digits - 1 - k) % 10).astype(np.uint32) << np.uint32(8 * (place % 4))
            added[place // 4] = added.get(place // 4, np.uint32(0)) + digit
        short = np.array([len(head) + digits + len(t) <= 55 for t in tails], dtype=bool)
        rows, many = np.flatnonzero(short), max(1, _TOGETHER // len(which))
        for at in range(0, len(rows), many):
            some = rows[at : at + many]
            messages = [head + b"0" * digits + tails[r] for r in some]
            block = np.frombuffer(b"".join((m + b"\x80").ljust(56, b"\0") + (8 * len(m)).to_bytes(8, "little") for m in messages), "<u4").reshape(-1, 16)
            words = [block[:, k, None] + added[k][None, :] if k in added else block[:, k, None] for k in range(16)]
            out[some, low - 1 : high] = _md5_first(words, (len(some), len(which)))
        for r in np.flatnonzero(~short):
            out[r, low - 1 : high] = [int.from_bytes(hashlib.md5(head + str(n).encode() + tails[r]).digest()[:4], "big") for n in which]
        low = high + 1
    return out


def normal_quantile(u: Column) -> Column:
    """The standard normal value below which a share ``u`` (above 0, below 1) lies."""

    def polynomial(x: Column, parts: tuple[float, ...]) -> Column:
        out = F.lit(parts[0])
        for c in parts[1:]:
            out = out * x + F.lit(c)
        return out

    centre, under, top, bottom = QUANTILE
    q = u - 0.5
    tail = lambda p: polynomial(F.sqrt(-2.0 * F.ln(p)), top) / polynomial(F.sqrt(-2.0 * F.ln(p)), bottom)
    return F.when(u < TAIL, tail(u)).when(u > 1.0 - TAIL, -tail(1.0 - u)).otherwise(q * polynomial(q * q, centre) / polynomial(q * q, under))


def _distribution(m: Column, chance: float | None) -> Column:
    """The distribution function of a cell of ``m`` rows at 0, 1, 2...: of Poisson(m), or of binomial(m, chance)."""
    last = F.ceil(m + 12.0 * F.sqrt(m) + 12.0).cast("int") if chance is None else m.cast("int")
    first = F.exp(-m.cast("double")) if chance is None else F.pow(F.lit(1.0 - chance), m)
    ratio = (lambda k: m / k) if chance is None else (lambda k: (m - k + 1) / k * (chance / (1.0 - chance)))
    start = F.struct(first.alias("p"), F.array(first).alias("c"))
    step = lambda a, k: F.struct((a["p"] * ratio(k)).alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * ratio(k))).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda a: a["c"])


def _expanded(m: Column, u: Column, chance: float | None) -> Column:
    """The same count for a large cell: mean, deviation, skewness and excess in the normal quantile, to the nearest whole number."""
    z = normal_quantile(u)
    mean, variance, skew, excess = (m, m, 1.0, 1.0) if chance is None else (m * chance, m * (chance * (1.0 - chance)), 1.0 - 2.0 * chance, 1.0 - 6.0 * chance * (1.0 - chance))
    third = (z * z * z - 3.0 * z) * (excess / 24.0) - (2.0 * z * z * z - 5.0 * z) * (skew * skew / 36.0)
    k = F.floor(mean + F.sqrt(variance) * z + (z * z - 1.0) * (skew / 6.0) + third / F.sqrt(variance) + 0.5).cast("long")
    return F.greatest(k, F.lit(0)) if chance is None else F.least(F.greatest(k, F.lit(0)), m)


def cell_draws(cells: DataFrame, m: str, replicates: int, seed: int | str, *keys: Column | str, chance: float | None = None) -> DataFrame:
    """Bootstrap of ``m`` equal rows at once: each cell once for every replicate (``replicate`` from 1) that draws from it.

    ``w`` is how often the cell's rows are drawn together: a Poisson(m) count, the sum of m counts of Poisson(1), or with
    ``chance`` how many of the rows are drawn, a binomial(m, chance) count. Either is its distribution function's inverse at a hash
    of (seed, replicate, keys), so the work follows distinct cells x replicates and not rows. One md5 serves four
    replicates. A count may be 0.
    """
    joined = F.concat_ws(":", F.lit(str(seed)), "_block", *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys))
    listed = cells.withColumn("_c", F.when(F.col(m).between(2 if chance is None else 1, LISTED), _distribution(F.col(m), chance)))
    blocks = dealt_out(listed, *keys).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // 4)))).withColumn("_h", F.md5(joined.cast("binary")))
    four = F.array(*(F.struct(F.lit(k + 1).alias("at"), F.substring("_h", 8 * k + 1, 8).alias("digits")) for k in range(4)))
    each = blocks.withColumn("_d", F.explode(four)).withColumn("replicate", (F.col("_block") * 4 + F.col("_d.at")).cast("int")).where(F.col("replicate") <= replicates)
    each = each.withColumn("_u", (F.conv("_d.digits", 16, 10).cast("double") + 0.5) / 4294967296.0)
    below = F.size(F.filter("_c", lambda c: c < F.col("_u"))).cast("long")
    listed_count = below if chance is None else F.least(below, F.col(m))
    w = F.when(F.col("_c").isNotNull(), listed_count).when(F.col(m) == 1, poisson_one(F.col("_u"), 13).cast("long")).otherwise(_expanded(F.col(m), F.col("_u"), chance))
    return each.select(*cells.columns, "replicate", w.alias("w"))


def poisson_one(u: Column, last: int = 7) -> Column:
    """The Poisson(1) count of a uniform number: weights of a bootstrap replicate, cut at ``last``."""
    total, term, out = 0.0, 0.36787944117144233, F.lit(last)
    steps = []
    for k in range(last):
        total += term
        steps.append((k, total))
        term /= k + 1
    for k, edge in reversed(steps):
        out = F.when(u < F.lit(edge), F.lit(k)).otherwise(out)
    return out
