"""URL filters by rarest-token rule index (operator 3), DataFrame functions only.

A rule is a regular expression over ``host + path`` with the literal tokens any match must contain.
Each rule is filed under its rarest literal token, rarity being counted over the URLs themselves; a
URL's own tokens fetch candidate rules from that index and only the candidates' expressions run.
The index is an array of buckets: a token's hash says in which bucket its rules stand, so a lookup costs the
same for any number of rules. It is built from the rule list - a parameter of at most MAX_RULES rules, not data - and
reaches the rows as an uncorrelated scalar subquery, so the URL table is scanned without a shuffle. A rule goes
under one token, and only tokens of the rules are counted.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and is
allowed; of several fitting rules the longest rule text wins, site rules before pattern rules, ties
go to the alphabetically first; a URL of any length is tokenised whole; repeated rows get equal rows; an empty
table gives an empty result; without rules everything is allowed; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farelens.llm.tables import table

#: Rules are parameters of bounded number; a longer list is refused rather than broadcast.
MAX_RULES = 100_000
#: Tokens in one bucket of the index, about.
BUCKET_TOKENS = 4


@dataclass(frozen=True)
class UrlRule:
    """``site`` rules fit a host, its subdomains and a path prefix; ``pattern`` rules are free expressions."""

    text: str
    verdict: str
    kind: str
    pattern: str
    tokens: tuple[str, ...]


def site_rule(text: str, verdict: str) -> UrlRule:
    """``example.net/en/``: this host and its subdomains, paths that start with ``/en/``."""
    host, slash, rest = text.partition("/")
    tokens = re.findall(r"[a-z0-9]+", host) + [t for t in re.split(r"[^a-z0-9]+", rest.lower().rpartition("/")[0]) if t]
    return UrlRule(text, verdict, "site", rf"^(?:[^/]*[.])?{re.escape(host)}{re.escape(slash + rest)}", tuple(dict.fromkeys(tokens)))


def label_rule(label: str) -> UrlRule:
    """Blocks hosts one of whose dot-separated labels is ``label``."""
    return UrlRule(label, "block", "pattern", rf"^(?:[^/]*[.])?{re.escape(label)}(?:[.:/]|$)", tuple(dict.fromkeys(re.findall(r"[a-z0-9]+", label))))


#: The site rules of the contract and the host labels of known spam and tracker sites.
SITE_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BLOCKED_LABELS = ("ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def default_rules() -> list[UrlRule]:
    return [*(site_rule(*r) for r in SITE_RULES), *(label_rule(x) for x in BLOCKED_LABELS)]


def url_host(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return F.translate(F.coalesce(after, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1))
    return F.coalesce(after, F.lit(""))


def _tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.concat(host, F.lit("/"), path)), r"[^a-z0-9]+"), lambda t: t != ""))


def filter_urls(pages: DataFrame, rules: list[UrlRule] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` and the number of candidates whose expression ran."""
    rules = default_rules() if rules is None else rules
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; MAX_RULES is {MAX_RULES}")
    if any(not r.tokens for r in rules):
        raise ValueError("a rule without a literal token cannot be indexed")
    spark = pages.sparkSession
    urls = pages.select(F.col(id_col).alias(id_col), url_host(F.col(url_col).cast("string")).alias("host"), url_path(F.col(url_col).cast("string")).alias("path"))
    urls = urls.withColumn("_tokens", _tokens(F.col("host"), F.col("path")))
    listed = spark.createDataFrame([(r.text, r.verdict, r.kind, r.pattern, list(r.tokens)) for r in rules], "rule string, verdict string, kind string, pattern string, tokens array<string>")
    every = listed.select("rule", "verdict", "kind", "pattern", F.explode("tokens").alias("token"))
    vocabulary = F.broadcast(every.select("token").distinct())  # MAX_RULES rules' tokens
    seen = urls.select(F.explode("_tokens").alias("token")).join(vocabulary, "token").groupBy("token").agg(F.count("*").alias("n"))
    filed = every.join(seen, "token", "left").groupBy("rule", "verdict", "kind", "pattern")
    filed = filed.agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest"))
    entry = F.struct((F.col("kind") == "pattern").cast("int").alias("later"), (-F.length("rule")).alias("short"), "rule", "verdict", "pattern", F.col("rarest.token").alias("token"))
    buckets = max(1, len(rules) // BUCKET_TOKENS)
    bucket = lambda token: F.pmod(F.xxhash64(token), F.lit(buckets))
    filed = filed.select(bucket(F.col("rarest.token")).alias("bucket"), entry.alias("rule")).groupBy("bucket").agg(F.collect_list("rule").alias("rules"))
    filled = spark.range(buckets).select(F.col("id").alias("bucket")).join(filed, "bucket", "left")
    index = filled.agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "rules"))), lambda x: x["rules"]).alias("index")).scalar()
    fetched = F.transform("_tokens", lambda t: F.filter(F.element_at("_index", (bucket(t) + 1).cast("int")), lambda r: r["token"] == t))
    found = F.flatten(F.filter(fetched, lambda rules: rules.isNotNull()))
    urls = urls.withColumn("_index", index).withColumn("_candidates", F.array_sort(found))
    fits = F.filter("_candidates", lambda c: F.regexp_like(F.concat("host", "path"), c["pattern"]))
    urls = urls.withColumn("_fit", F.try_element_at(fits, F.lit(1)))
    return urls.select(
        id_col, "host", "path",
        F.when(F.col("_fit.later") == 0, F.col("_fit.rule")).alias("rule"),
        F.coalesce(F.col("_fit.verdict"), F.lit("allow")).alias("verdict"),
        F.when(F.col("_fit.later") == 1, F.col("_fit.rule")).alias("pattern_rule"),
        F.size("_candidates").cast("long").alias("n_candidates"),
    )


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).drop("n_candidates")


def _oracle() -> str:
    sites = ", ".join(f"('{t}', '{v}', '{t.partition('/')[0]}', '/{t.partition('/')[2]}')" for t, v in SITE_RULES)
    labels = ", ".join(f"('{x}')" for x in BLOCKED_LABELS)
    return f"""
WITH r(rule, verdict, rhost, rpath) AS (VALUES {sites}), b(label) AS (VALUES {labels}),
u AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN instr(url, '://') > 0 THEN regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) ELSE '' END AS h,
             CASE WHEN instr(url, '://') > 0 THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
v AS (SELECT k, page_id, translate(coalesce(h, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(path, '') AS path FROM u),
s AS (SELECT k, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM v JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY k),
p AS (SELECT k, arg_min(label, (-length(label), label)) AS label FROM v JOIN b ON regexp_matches(host || path, '^(?:[^/]*[.])?' || label || '(?:[.:/]|$)') GROUP BY k)
SELECT page_id, host, path, s.rule AS rule, CASE WHEN s.rule IS NOT NULL THEN s.verdict WHEN p.label IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN s.rule IS NULL THEN p.label END AS pattern_rule
FROM v LEFT JOIN s USING (k) LEFT JOIN p USING (k)
"""


ORACLE_SQL = _oracle()
