"""Governance metrics and business figures over golden records."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import config
from tessera.config import ENTITIES, Settings
from tessera.functions import text
from tessera.functions.scoring import quality_band, revenue_bucket, share, size_bucket


def _spine(spark: SparkSession, values: list[str], name: str) -> DataFrame:
    return spark.createDataFrame([(v, i) for i, v in enumerate(values, 1)], f"{name} string, place int")


# Governance


def quality_bands(quality: dict[str, DataFrame]) -> DataFrame:
    """Records in each of four bands; empty bands show zero."""
    scores = reduce(DataFrame.unionByName, [df.select("record_quality_score") for df in quality.values()]).where("record_quality_score IS NOT NULL")
    counts = scores.groupBy(quality_band(F.col("record_quality_score")).alias("quality_band")).agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    rows = _spine(scores.sparkSession, ["Excellent", "Good", "Fair", "Poor"], "quality_band").join(counts, "quality_band", "left").join(F.broadcast(total))
    n = F.coalesce("n", F.lit(0))
    return rows.select("quality_band", n.alias("record_count"), share(n, F.col("total"), 0.0).alias("percentage"))


def source_ids(golden: DataFrame, column: str) -> DataFrame:
    """Distinct source records named by golden records."""
    ids = golden.select(F.explode(F.split(column, ",")).alias("id")).select(text.strip(F.col("id")).alias("id"))
    return ids.where("id <> ''").distinct()


def golden_coverage(golden: dict[str, DataFrame]) -> DataFrame:
    """Golden records by source records for each entity and overall."""
    parts = []
    for name, df in golden.items():
        total = source_ids(df, f"source_{ENTITIES[name].id_col}s").agg(F.count("*").alias("total_records"))
        parts.append(df.agg(F.count("*").alias("golden_records")).join(total).select(F.lit(name.capitalize()).alias("entity_type"), "total_records", "golden_records"))
    rows = reduce(DataFrame.unionByName, parts)
    sums = rows.groupingSets([["entity_type"], []], "entity_type").agg(F.sum("total_records").alias("total_records"), F.sum("golden_records").alias("golden_records"))
    return sums.select(F.coalesce("entity_type", F.lit("Overall")).alias("entity_type"), "total_records", "golden_records", share(F.col("golden_records"), F.col("total_records"), 0.0).alias("coverage_pct"))


def governance_metrics(dq_scores: DataFrame, quality: dict[str, DataFrame], golden: dict[str, DataFrame], clusters: dict[str, DataFrame], stewardship: DataFrame, settings: Settings) -> DataFrame:
    """Fifteen metrics: ``metric_name, metric_value, metric_category, reporting_date``."""

    def metric(df: DataFrame, name: Column | str, value: Column, category: str) -> DataFrame:
        label = F.lit(name) if isinstance(name, str) else name
        return df.select(label.alias("metric_name"), value.cast("double").alias("metric_value"), F.lit(category).alias("metric_category"), F.lit(settings.as_of.isoformat()).alias("reporting_date"))

    out = [metric(dq_scores.where("entity = 'CRM HEALTH SCORE'"), "CRM Health Score", F.round("score", 2), "Overall")]
    means = dq_scores.where(F.col("entity").isin("ACCOUNTS", "CONTACTS", "LEADS")).groupBy("dimension").agg(F.round(F.avg("score"), 2).alias("score"))
    out.append(metric(means, F.concat(F.lit("Data "), "dimension", F.lit(" %")), F.col("score"), "Data Quality"))
    out.append(metric(golden_coverage(golden), F.concat(F.lit("Golden Record Coverage % - "), "entity_type"), F.col("coverage_pct"), "Golden Records"))
    counts = [df.agg(F.count_distinct("record_id").alias("before"), F.count_distinct("canonical_id").alias("after")) for df in clusters.values()]
    total = reduce(DataFrame.unionByName, counts).agg(F.sum("before").alias("before"), F.sum(F.greatest(F.col("before") - F.col("after"), F.lit(0))).alias("merged"))
    out.append(metric(total, "Duplicate Rate", share(F.col("merged"), F.col("before"), 0.0), "Deduplication"))
    is_open = text.one_of(F.col("dq_issue_status"), config.OPEN_ISSUE_STATUSES)
    out.append(metric(stewardship.agg(F.count_if(is_open).alias("n")), "Records Under Stewardship", F.col("n"), "Governance Issues"))
    score = F.col("record_quality_score")
    records = reduce(DataFrame.unionByName, [df.select("record_quality_score") for df in quality.values()]).agg(F.count_if(score < 75).alias("review"), F.count_if(score >= 90).alias("excellent"), F.count_if(score < 60).alias("poor"))
    for name, c, category in (("Records Requiring Review", "review", "Governance Issues"), ("Excellent Records", "excellent", "Data Quality"), ("Poor Quality Records", "poor", "Governance Issues")):
        out.append(metric(records, name, F.col(c), category))
    return reduce(DataFrame.unionByName, out)


# Business


def lead_funnel(leads: DataFrame) -> DataFrame:
    """Leads in each status: the known ones in funnel order, zero or not, then others by name."""
    status = text.strip(F.coalesce(F.col("status"), F.lit("Unknown")))
    counts = leads.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    rows = _spine(leads.sparkSession, config.LEAD_STATUSES, "status").join(counts, "status", "full_outer").join(F.broadcast(total))
    n = F.coalesce("n", F.lit(0))
    from pyspark.sql import Window

    order = F.row_number().over(Window.orderBy(F.col("place").asc_nulls_last(), "status"))  # a row a status
    return rows.select("status", n.alias("lead_count"), share(n, F.col("total"), 0.0).alias("percentage"), order.alias("funnel_order"))


def lead_source_performance(leads: DataFrame) -> DataFrame:
    """Leads, qualified and converted leads and the conversion rate of each source that has leads."""
    rows = leads.select(text.named(F.col("source")).alias("source"), text.named(F.col("status")).alias("status"))
    counts = rows.groupBy("source").agg(F.count("*").alias("lead_count"), F.count_if(F.col("status") == "Qualified").alias("qualified_leads"), F.count_if(F.col("status") == "Converted").alias("converted_leads"))
    place = F.array_position(F.array(*[F.lit(s) for s in config.SOURCE_ORDER]), F.col("source"))
    ordered = counts.orderBy(F.when(place > 0, place).otherwise(len(config.SOURCE_ORDER) + 1), "source")
    return ordered.withColumn("conversion_rate", share(F.col("converted_leads"), F.col("lead_count"), 0.0))


def distribution(df: DataFrame, column: Column, label: str, count: str) -> DataFrame:
    """Counts and shares by value, most frequent first."""
    counts = df.groupBy(column.alias(label)).agg(F.count("*").alias(count))
    total = counts.agg(F.sum(count).alias("total"))
    return counts.join(F.broadcast(total)).select(label, count, share(F.col(count), F.col("total"), 0.0).alias("percentage")).orderBy(F.desc(count), label)


def _buckets(accounts: DataFrame, bucket: Column, label: str, order: list[str]) -> DataFrame:
    counts = accounts.groupBy(bucket.alias(label)).agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).where("total > 0")
    n = F.coalesce("n", F.lit(0))
    rows = _spine(accounts.sparkSession, order, label).join(counts, label, "left").join(F.broadcast(total))
    return rows.where((F.col(label) != "Unknown") | (n > 0)).orderBy("place").select(label, n.alias("account_count"), share(n, F.col("total"), 0.0).alias("percentage"))


def account_sizes(accounts: DataFrame) -> DataFrame:
    return _buckets(accounts, size_bucket(F.col("employee_count")), "account_size", ["Small", "Medium", "Large", "Unknown"])


def revenue_buckets(accounts: DataFrame) -> DataFrame:
    return _buckets(accounts, revenue_bucket(F.col("annual_revenue")), "revenue_bucket", ["< 1M", "1M - 10M", "10M - 100M", "100M+", "Unknown"])


def account_industries(accounts: DataFrame) -> DataFrame:
    """Industry by any id of a golden account; of several the last golden id's."""
    ids = F.flatten(F.array(F.array("golden_account_id", "surviving_account_id"), F.split("source_account_ids", ",")))
    rows = accounts.select("golden_account_id", text.named(F.col("industry")).alias("industry"), F.explode(ids).alias("id")).withColumn("id", text.clean(F.col("id"))).where("id <> ''")
    return rows.groupBy("id").agg(F.max_by("industry", F.struct("golden_account_id", "industry")).alias("industry"))


def leads_by_industry(leads: DataFrame, accounts: DataFrame) -> DataFrame:
    """Leads by the industry of their account; Unknown where leads name no account."""
    join_col = next((c for c in ("account_id", "surviving_account_id", "golden_account_id") if c in leads.columns), None)
    if "industry" in leads.columns:
        rows = leads
    elif join_col:
        rows = leads.join(account_industries(accounts), text.strip(F.col(join_col).cast("string")) == F.col("id"), "left")
    else:
        rows = leads.withColumn("industry", F.lit(None).cast("string"))
    return distribution(rows, text.named(F.col("industry")), "industry", "lead_count")


#: Business figures by name, from golden records by entity.
BUSINESS: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = {
    "lead_funnel": lambda g: lead_funnel(g["leads"]), "lead_source_performance": lambda g: lead_source_performance(g["leads"]),
    "industry_distribution": lambda g: distribution(g["accounts"], text.named(F.col("industry")), "industry", "account_count"),
    "country_distribution": lambda g: distribution(g["accounts"], text.named(F.col("country")), "country", "account_count"),
    "account_size_distribution": lambda g: account_sizes(g["accounts"]), "revenue_distribution": lambda g: revenue_buckets(g["accounts"]),
    "job_title_distribution": lambda g: distribution(g["contacts"], text.named(F.col("job_title")), "job_title", "contact_count"),
    "leads_by_industry": lambda g: leads_by_industry(g["leads"], g["accounts"]),
}


def business_tables(golden: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: make(golden) for name, make in BUSINESS.items()}


def executive_summary(golden: dict[str, DataFrame], tables: dict[str, DataFrame]) -> DataFrame:
    """Eight rows of ``metric_name, metric_value`` (text)."""
    counts = [df.agg(F.lit(f"Total {name.capitalize()}").alias("metric_name"), F.count("*").cast("string").alias("metric_value")) for name, df in golden.items()]
    converted = F.count_if(F.col("status") == "Converted")
    of_leads = golden["leads"].agg(converted.cast("string").alias("Converted Leads"), share(converted, F.count("*"), 0.0).cast("string").alias("Conversion Rate"))

    def top(name: str, df: DataFrame, column: str, best: Column) -> DataFrame:
        return df.agg(F.coalesce(F.min_by(column, best), F.lit("Unknown")).alias("metric_value")).select(F.lit(name).alias("metric_name"), "metric_value")

    return reduce(DataFrame.unionByName, [
        *counts, of_leads.unpivot([], ["Converted Leads", "Conversion Rate"], "metric_name", "metric_value"),
        top("Top Lead Source", tables["lead_source_performance"], "source", F.struct(-F.col("converted_leads"), -F.col("lead_count"), "source")),
        top("Top Industry", tables["industry_distribution"], "industry", F.struct(-F.col("account_count"), "industry")),
        top("Top Country", tables["country_distribution"], "country", F.struct(-F.col("account_count"), "country")),
    ])


#: Result table, category, label column, dimension, and the columns that become metrics.
MELTED = [
    ("lead_funnel", "Lead Funnel", "status", "Status", ["lead_count", "percentage"]),
    ("lead_source_performance", "Lead Source", "source", "Source", ["lead_count", "qualified_leads", "converted_leads", "conversion_rate"]),
    ("industry_distribution", "Industry Distribution", "industry", "Industry", ["account_count", "percentage"]),
    ("country_distribution", "Country Distribution", "country", "Country", ["account_count", "percentage"]),
    ("account_size_distribution", "Account Size", "account_size", "Account Size", ["account_count", "percentage"]),
    ("revenue_distribution", "Revenue Distribution", "revenue_bucket", "Revenue Bucket", ["account_count", "percentage"]),
    ("job_title_distribution", "Contact Job Title", "job_title", "Job Title", ["contact_count", "percentage"]),
    ("leads_by_industry", "Top Industries by Leads", "industry", "Industry", ["lead_count", "percentage"]),
]


def business_dataset(golden: dict[str, DataFrame], tables: dict[str, DataFrame], settings: Settings) -> DataFrame:
    """All business figures as rows of category, metric, value (text) and dimension."""
    summary = executive_summary(golden, tables)
    out = [summary.select(F.lit("Executive Summary").alias("metric_category"), "metric_name", "metric_value", F.lit("Overall").alias("dimension"), F.lit("Overall").alias("dimension_value"))]
    for name, category, label, dimension, columns in MELTED:
        texts = tables[name].select(label, *[F.col(c).cast("string").alias(c.replace("_", " ").title()) for c in columns])
        long = texts.unpivot([label], [c.replace("_", " ").title() for c in columns], "metric_name", "metric_value")
        out.append(long.select(F.lit(category).alias("metric_category"), "metric_name", "metric_value", F.lit(dimension).alias("dimension"), F.col(label).alias("dimension_value")))
    return reduce(DataFrame.unionByName, out).withColumn("reporting_date", F.lit(settings.as_of.isoformat()))


def segmentation(tables: dict[str, DataFrame]) -> DataFrame:
    """Account sizes, revenue buckets and job titles as segments."""
    parts = [("Account Size", "account_size_distribution", "account_size", "account_count"), ("Revenue", "revenue_distribution", "revenue_bucket", "account_count"), ("Job Title", "job_title_distribution", "job_title", "contact_count")]
    return reduce(DataFrame.unionByName, [tables[t].select(F.lit(kind).alias("segment_type"), F.col(label).alias("segment"), F.col(n).alias("record_count"), "percentage") for kind, t, label, n in parts])
