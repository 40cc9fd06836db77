"""Importance resampling of documents towards a target distribution (operator 12).

Hashed n-gram features of a large raw set and of a small target set give, per bucket, the gain: the log ratio of
smoothed target and raw frequency in thousandths. A document's weight is the floored mean gain of its features; with
Gumbel noise from a hash of its id added, the highest scores are a sample without replacement, drawn in proportion
to the exponential of the weights.

Native DataFrame functions: n-gram arrays are exploded, their bytes' crc32 modulo the number of buckets is the
bucket, raw and target counts are grouped sums (combined map-side, ``buckets`` rows per task at most), the gain
table (``buckets`` rows, a parameter, so of bounded size) is broadcast to the exploded features, a document's gains are summed where
they were exploded (a row per document is shuffled), and ranks come from one distributed sort: rows are
dealt to ranges of (drawable, score, id), sorted inside them and written with their place, and a range's
offset is the number of rows in the ranges before it.

Defined results: a null or wordless text has no feature, weight 0 and, unless ``least_words`` is 0, no rank; a null id hashes
as an empty one; rows that repeat are rows of their own with ranks that follow one another; ties go to the smaller id (null first), then by
features and weight; very long texts are taken whole; an empty target has no feature, so all gains compare with
the uniform distribution; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farelens.llm.tables import table
from farelens.sources.staging import materialize

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Ranks are dealt to this many ranges for each core, so that none is large beside the others.
RANGES_A_CORE = 2


@dataclass(frozen=True)
class SamplingRules:
    most_words: int = 1  # features are all runs of 1 to this many words
    buckets: int = 10_000
    seed: int = 2024
    least_words: int = 20
    percent: int = 10


def _words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWERED), F.lit(WORD), 0), F.array().cast("array<string>"))


def _grams(words: Column, most: int) -> Column:
    """All runs of one to ``most`` words, each joined by one space."""

    def runs(n: int) -> Column:
        # later words beside earlier ones: an array for each place in the run, so that no run is sliced out of the whole text
        shifted = [F.slice(words, k + 1, F.greatest(F.size(words) - (n - 1), F.lit(0))) for k in range(n)]
        return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat_ws(" ", x, y)), shifted)

    return reduce(F.concat, [words, *(runs(n) for n in range(2, most + 1))])


def features(docs: DataFrame, rules: SamplingRules, text_col: str = "text", *kept: Column | str) -> DataFrame:
    """Each feature's bucket beside ``kept`` columns and the number of words; a document without features gives one row with a null bucket."""
    words = docs.select(*kept, _words(F.col(text_col).cast("string")).alias("_words"))
    grams = words.select(*(c for c in words.columns if c != "_words"), F.size("_words").cast("long").alias("n_words"), F.explode_outer(_grams(F.col("_words"), rules.most_words)).alias("_gram"))
    return grams.withColumn("bucket", (F.crc32(F.col("_gram").cast("binary")) % rules.buckets).cast("int")).drop("_gram")


def gains(raw: DataFrame, target: DataFrame, rules: SamplingRules, text_col: str = "text") -> DataFrame:
    """bucket, gain for every bucket that holds a feature."""
    side = lambda df, name: features(df, rules, text_col).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias(name))
    counts = materialize(side(raw, "s").join(side(target, "t"), "bucket", "full").na.fill(0, ["s", "t"]), "gram-counts")
    total = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("S"), F.coalesce(F.sum("t"), F.lit(0)).alias("T"))
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1.0) * (d("a.S") + float(rules.buckets)) / ((d("s") + 1.0) * (d("a.T") + float(rules.buckets)))
    return counts.withColumn("a", total.select(F.struct("S", "T")).scalar()).select("bucket", F.floor(1000.0 * F.ln(ratio)).cast("long").alias("gain"))


def weights(docs: DataFrame, table_of_gains: DataFrame, rules: SamplingRules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_features and weight of every document; a document's row is told from others by its place."""
    each = features(docs, rules, text_col, F.col(id_col).cast("long").alias(id_col), F.monotonically_increasing_id().alias("_row"))
    # a bucket outside the table cannot occur here: the raw counts hold every feature of the documents
    sums = each.join(F.broadcast(table_of_gains), "bucket", "left").groupBy("_row", id_col).agg(F.max("n_words").alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("_sum"))
    floored = F.when(F.col("n_features") > 0, F.expr("(_sum - pmod(_sum, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    return sums.select(id_col, "n_words", "n_features", floored.alias("weight"))


def scored(weighed: DataFrame, rules: SamplingRules, id_col: str = "doc_id") -> DataFrame:
    """Adds ``score``: the weight and the id's Gumbel noise, both in thousandths."""
    digest = F.sha2(F.concat(F.lit(f"{rules.seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000.0 * F.ln(-F.ln(uniform))).cast("long"))


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the 1-based place of every row in one order of the whole table.

    Rows are dealt to ranges of the order, sorted inside each and written with their place; offsets come from the
    written rows' counts. ``order`` has to end with what tells equal rows apart, so that no range holds them all.
    """
    spark = rows.sparkSession
    ranges = RANGES_A_CORE * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    written = materialize(placed.withColumns({"_part": F.spark_partition_id(), "_place": inside}), "sorted")
    sizes = written.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return written.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def resample(docs: DataFrame, target: DataFrame, rules: SamplingRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_features, weight, score and rank (null for those that are not drawn)."""
    rules = rules or SamplingRules()
    table_of_gains = gains(docs, target, rules, text_col)
    rows = materialize(scored(weights(docs, table_of_gains, rules, id_col, text_col), rules, id_col), "scored")
    drawable = F.col("n_words") >= rules.least_words
    order = [F.col("_drawable").desc(), F.col("score").desc(), F.col(id_col).asc(), F.col("n_features").asc(), F.col("weight").asc(), F.col("_row").asc()]
    out = ranked(rows.withColumns({"_drawable": drawable, "_row": F.monotonically_increasing_id()}), order, "rank")
    wanted = rows.agg(F.floor(F.count_if(drawable) * rules.percent / 100).alias("n")).scalar()
    out = out.withColumn("rank", F.when(F.col("_drawable") & (F.col("rank") <= wanted), F.col("rank"))).drop("_drawable", "_row")
    return out.select(id_col, "n_words", "n_features", "weight", "score", "rank")


def sample(docs: DataFrame, target: DataFrame, rules: SamplingRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The drawn documents themselves, with all their columns; ids have to be unique."""
    drawn = resample(docs, target, rules, id_col, text_col).where("rank IS NOT NULL").select(F.col(id_col).alias("_drawn"))
    return docs.join(drawn, docs[id_col] == F.col("_drawn"), "left_semi")


def op12_target_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def _oracle(rules: SamplingRules) -> str:
    entry = "list_reduce(range(8), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, i)"
    lowered = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWERED}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH crc AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, {entry} AS v FROM (SELECT unnest(range(256)) AS i))),
d AS (SELECT row_number() OVER () AS k, doc_id, {lowered} AS ws FROM documents), b AS (SELECT {lowered} AS ws FROM benchmark),
dw AS MATERIALIZED (SELECT k, w, count(*) AS n FROM (SELECT k, unnest(ws) AS w FROM d) GROUP BY 1, 2), bw AS MATERIALIZED (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM b) GROUP BY 1),
v AS MATERIALIZED (SELECT w, hex(encode(w)) AS hx FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
f AS MATERIALIZED (SELECT w, xor(list_reduce(list_transform(range(length(hx) // 2), lambda i: CAST('0x' || substr(hx, 2 * i + 1, 2) AS BIGINT)), lambda a, c: xor(a >> 8, tab[(xor(a, c) & 255) + 1]), 4294967295), 4294967295) % {rules.buckets} AS bucket FROM v, crc),
s AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS s FROM dw JOIN f USING (w) GROUP BY 1), t AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS t FROM bw JOIN f USING (w) GROUP BY 1),
g AS MATERIALIZED (SELECT bucket, CAST(floor(1000.0::DOUBLE * ln((coalesce(t, 0)::DOUBLE + 1.0) * (sum(coalesce(s, 0)) OVER () + {rules.buckets})::DOUBLE / ((coalesce(s, 0)::DOUBLE + 1.0) * (sum(coalesce(t, 0)) OVER () + {rules.buckets})::DOUBLE))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
m AS (SELECT k, CAST(sum(n * gain) AS BIGINT) AS total FROM dw JOIN f USING (w) JOIN g USING (bucket) GROUP BY 1),
e AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, CASE WHEN len(ws) > 0 THEN CAST((total - ((total % len(ws)) + len(ws)) % len(ws)) // len(ws) AS BIGINT) ELSE 0 END AS weight,
             (CAST('0x' || substr(sha256('{rules.seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM d LEFT JOIN m USING (k)),
x AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000.0::DOUBLE * ln(-ln(u))) AS BIGINT) AS score FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {rules.least_words} ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS place, count(*) OVER (PARTITION BY n_features >= {rules.least_words}) AS many FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {rules.least_words} AND place <= many * {rules.percent} // 100 THEN place END AS rank FROM r
"""


ORACLE_SQL = _oracle(SamplingRules())
