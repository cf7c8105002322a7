"""URL filters by hashed host-suffix and path-prefix expressions, native SQL only.

Every URL yields the expressions a rule could have: each suffix of its host that has as many
labels as some rule's host, joined with each prefix of its path that is as long as some
rule's path. So a URL has at most one expression for each such pair of sizes, however long it is. Expressions meet rules on the first 32 bits of their SHA-256; the
full digest then confirms, and the longest rule wins.

Null URLs and URLs without ``://`` have an empty host and path and match no rule.
Ties in length are broken in favour of the longer host, then block. Repeated rows are judged
one by one with one result; an empty table gives no rows, an empty rule table the default
verdict. Only the id and the URL are read, whatever other columns are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules as (host, path, verdict).
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
DEFAULT_VERDICT = "allow"


def host_and_path(url) -> tuple:
    """Columns with the URL's host (A-Z lower-cased) and path, empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, upper, lower), path


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """Judge every row's URL by rules ``(host, path, verdict)``.

    Returns ``id, host, path, rule, verdict``. Rows with equal host and path are
    judged once, so a URL that fills a third of the table is expanded once per map
    task. Rules are matched by a hash equi-join, which Spark broadcasts or shuffles
    by their size.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule = F.concat("host", "path")
    digests = rules.select(
        rule.alias("rule"), "verdict", F.length("host").alias("host_length"),
        F.sha2(F.concat("host", F.lit("\n"), "path"), 256).alias("digest"), F.length("path").alias("path_length"), F.size(F.split("host", r"\.")).alias("labels"),
    )
    sizes = digests.agg(F.collect_set("path_length").alias("paths"), F.collect_set("labels").alias("hosts")).first()  # one for each size a rule has
    known, counts = (F.array(*[F.lit(n) for n in sorted(x)]).cast("array<int>") for x in (sizes["paths"], sizes["hosts"]))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.filter(counts, lambda n: n <= F.size(labels)), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    prefixes = F.transform(F.filter(known, lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))
    urls = rows.select("host", "path").where(F.col("host") != "").distinct()
    expressions = (
        urls.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
        .select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
        .select("host", "path", F.sha2(F.concat("suffix", F.lit("\n"), "prefix"), 256).alias("digest"))
    )
    short = F.substring("digest", 1, 8)
    met = expressions.withColumn("short", short).join(
        digests.select("rule", "verdict", "host_length", F.col("digest").alias("full"), F.substring("digest", 1, 8).alias("short")), "short"
    )
    confirmed = met.where(F.col("digest") == F.col("full"))
    best = F.max(F.struct(F.length("rule").alias("n"), "host_length", F.col("verdict").alias("v"), F.col("rule").alias("r")))
    judged = confirmed.groupBy("host", "path").agg(best.alias("best"))
    return rows.join(judged, ["host", "path"], "left").select(
        id_col, "host", "path", F.col("best.r").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict")
    )


def url_filter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: judge every page's URL by the four rules."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS t(host, path, verdict)")
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


URL_FILTER_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
urls AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
rules(rhost, rpath, verdict) AS (VALUES
  ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT u.page_id, u.host, u.path, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY u.host, u.path, u.page_id ORDER BY length(r.rhost || r.rpath) DESC, length(r.rhost) DESC) AS n
  FROM urls u JOIN rules r ON (u.host = r.rhost OR ends_with(u.host, '.' || r.rhost)) AND starts_with(u.path, r.rpath))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM urls u LEFT JOIN (SELECT DISTINCT host, path, rule, verdict FROM fits WHERE n = 1) f USING (host, path)
"""
