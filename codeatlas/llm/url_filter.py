"""URL allow and block rules by hashed host-suffix and path-prefix expressions (DataFrame functions only).

A rule is a host and a path. It fits a URL when the URL's host is the rule's host or a subdomain of
it and the URL's path starts with the rule's path; of the rules that fit, the longest expression
(host and path together, then the longer host, then allow before block) decides.

Each URL is expanded into host suffixes (at label borders, of the label counts that occur among the
rules) times path prefixes (of the lengths that occur among them), each expression is hashed with SHA-256, URL and rule meet by equality of the
first PREFIX hex digits, and the full digests and the expression itself are compared afterwards.
The driver reads only the distinct label counts and path lengths of the rules.

A null URL or one without `://` has an empty host and path and fits no rule; it gets the default
verdict, as does every URL that no rule fits. Rules with a null or empty host are ignored, a null
path is empty, and repeated rules count once. Repeated URLs each give a row; an empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.llm.common import ascii_lower, maybe_broadcast, table

PREFIX = 8


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """(host, path) of a URL; both empty for null or without `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with expression, digest and short prefix."""
    clean = rules.select(ascii_lower(F.col("host")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict")
    clean = clean.where("rule_host <> '' AND verdict IS NOT NULL").groupBy("rule_host", "rule_path").agg(F.min("verdict").alias("rule_verdict"))
    expression = F.concat("rule_host", "rule_path")
    return clean.withColumns({"rule": expression, "rule_digest": F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256)}).withColumn(
        "short", F.substring("rule_digest", 1, PREFIX)
    )


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, rule, verdict."""
    known = rule_table(rules)
    lengths = sorted(r.n for r in known.select(F.length("rule_path").alias("n")).distinct().collect())
    host, path = split_url(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    labels = sorted(r.n for r in known.select(F.size(F.split("rule_host", r"\.")).alias("n")).distinct().collect())
    counts = F.filter(F.array(*[F.lit(n) for n in labels]).cast("array<int>"), lambda n: n <= F.size(F.split("host", r"\.")))
    suffixes = F.transform(counts, lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    prefixes = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    expanded = (
        urls.where("host <> ''")
        .withColumn("suffix", F.explode(suffixes))
        .withColumn("prefix", F.explode(F.transform(prefixes, lambda n: F.substring(F.col("path"), F.lit(1), n))))
        .where("suffix <> ''")
        .withColumn("digest", F.sha2(F.concat_ws("\n", "suffix", "prefix"), 256))
        .withColumn("short", F.substring("digest", 1, PREFIX))
    )
    fits = expanded.join(maybe_broadcast(known), "short").where((F.col("digest") == F.col("rule_digest")) & (F.col("suffix") == F.col("rule_host")) & (F.col("prefix") == F.col("rule_path")))
    order = F.struct(F.length("rule"), F.length("rule_host"), (F.col("rule_verdict") == "allow").alias("allow"), F.col("rule"), F.col("rule_verdict").alias("v"))
    best = fits.groupBy("id", "host", "path").agg(F.max(order).alias("best"))
    hit = best.select(F.col("id").alias("hit_id"), F.col("host").alias("hit_host"), F.col("path").alias("hit_path"), F.col("best.rule").alias("rule"), F.col("best.v").alias("v"))
    # null ids meet as well
    same = F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("host") == F.col("hit_host")) & (F.col("path") == F.col("hit_path"))
    return urls.join(hit, same, "left").select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("v", F.lit(default)).alias("verdict")
    )


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


OP7_SQL = r"""
WITH rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                               ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u0 AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS rawhost, rest FROM r),
u AS (SELECT page_id, translate(rawhost, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(rawhost) + 1), '^[^?#]*') AS path FROM u0),
m AS (SELECT page_id, h || p AS rule, v,
             row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC, v) AS k
      FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT u.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN m ON m.page_id = u.page_id AND k = 1
"""
