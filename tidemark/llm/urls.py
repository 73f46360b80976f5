"""URL filters: host-suffix and path-prefix expressions against rules, by hash prefix and full digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Hex digits of the digest that make the join key; the full digest is compared afterwards.
PREFIX_DIGITS = 8
#: Rules are broadcast up to this number of rows, which the operator counts; beyond it they are joined.
BROADCAST_RULES = 1_000_000

#: Rules of the registered query: verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and what follows each of its dots."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def path_prefixes(path: Column) -> Column:
    """The empty prefix, and the path up to and with each of its slashes."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1),
                       lambda n: F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))))


def _digest(host: Column, prefix: Column) -> Column:
    # A host never holds a slash, so the expression has one reading.
    return F.sha2(F.concat(host, F.lit(" "), prefix), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: key, host, path, rule, verdict.

    ``rules`` has verdict, host and path. A rule fits its host and all subdomains of it if the path of
    the url starts with the rule's path. Each url becomes one expression per host suffix and directory
    prefix of its path; a rule is filed under the longest directory prefix of its own path, found by the
    first digits of the digest, confirmed by the whole digest and then by the rest of the path. Of the
    rules that fit, the longest wins (host and path together), then the one with the longer host, then
    ``block``, then the smaller text. Without a rule the verdict is ``default`` and the rule is null.

    Missing urls and urls without ``://`` have an empty host and path, which no rule with a host fits.
    Repeated keys are judged row by row. Rules with a missing host or path, and an empty rule table, fit
    nothing. The join never multiplies pages: the fitting rules of a row are reduced to one in the same
    grouping as its expressions.
    """
    spark = pages.sparkSession
    filed = (rules.where("verdict is not null and host is not null and path is not null")
             .select(F.translate("host", _UPPER, _LOWER).alias("r_host"), F.col("path").alias("r_path"), "verdict")
             .groupBy("r_host", "r_path").agg(F.max("verdict").alias("r_verdict"))
             .withColumn("r_digest", _digest(F.col("r_host"), F.regexp_extract("r_path", r"(?s)^(.*/)?", 0)))
             .withColumn("prefix", F.substring("r_digest", 1, PREFIX_DIGITS)))
    if filed.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        filed = F.broadcast(filed)
    rows = pages.select(F.col(key).alias("__key"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"),
                        F.monotonically_increasing_id().alias("__row"))
    expressions = (rows.withColumn("h", F.explode(host_suffixes(F.col("host"))))
                   .withColumn("p", F.explode(path_prefixes(F.col("path"))))
                   .withColumn("digest", _digest(F.col("h"), F.col("p")))
                   .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS)))
    fits = (F.col("digest") == F.col("r_digest")) & F.col("path").startswith(F.col("r_path"))
    order = F.struct((F.length("r_host") + F.length("r_path")).alias("size"), F.length("r_host").alias("host_size"),
                     (F.col("r_verdict") == "block").alias("blocks"), F.concat("r_host", "r_path").alias("rule"),
                     F.col("r_verdict").alias("verdict"))
    best = (expressions.join(filed, "prefix", "left")
            .groupBy("__row", "__key", "host", "path").agg(F.max(F.when(fits, order)).alias("best")))
    return best.select(F.col("__key").alias(key), "host", "path", F.col("best.rule").alias("rule"),
                       F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP5_SQL = """
WITH rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
    ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id, regexp_extract(r, '^[^/?#]*', 0, 's') AS h, r FROM rest),
parts AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(r, length(h) + 1), '^[^?#]*', 0, 's') AS path FROM cut),
fit AS (SELECT page_id, arg_max(rules.host || rules.path, length(rules.host) + length(rules.path)) AS rule,
    arg_max(verdict, length(rules.host) + length(rules.path)) AS verdict
  FROM parts JOIN rules ON (parts.host = rules.host OR ends_with(parts.host, '.' || rules.host)) AND starts_with(parts.path, rules.path)
  GROUP BY page_id)
SELECT page_id, host, path, fit.rule, coalesce(fit.verdict, 'allow') AS verdict FROM parts LEFT JOIN fit USING (page_id)
"""
