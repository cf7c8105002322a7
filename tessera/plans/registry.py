"""All queries over the driver's tables, by name."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import ENTITIES, Settings
from tessera.functions import text
from tessera.operators import analytics, clusters, golden, ingest, matching, quality, standardize
from tessera.plans.adapter import LEAD_ACCOUNT, base_table, base_tables
from tessera.plans.pipeline import Pipeline

Query = Callable[[SparkSession, str], DataFrame]

#: Lead dates of the test tables lie around this day's freshness limit.
AS_OF = date(2026, 1, 15)

#: Stands for a missing id, which is one record and sorts last as in the SQL.
NO_ID = "\U0010ffff"


def pipeline(spark: SparkSession, sf_dir: str, **settings) -> Pipeline:
    """A run over the adapter's tables; without fuzzy matches unless asked, so that SQL can express it."""
    return Pipeline(spark, base_tables(spark, sf_dir), Settings(**({"as_of": AS_OF, "fuzzy": False} | settings)))


def _of(make: Callable[[Pipeline], DataFrame], **settings) -> Query:
    return lambda spark, sf_dir: make(pipeline(spark, sf_dir, **settings))


def _dimension(name: str, fuzzy: bool) -> Query:
    def make(p: Pipeline) -> DataFrame:
        rows = None
        for entity in ENTITIES:
            own = p.issues[entity].where(F.col("dimension") == name.capitalize())
            rows = own if rows is None else rows.unionByName(own)
        return rows

    return _of(make, fuzzy=fuzzy)


def _all_issues(p: Pipeline) -> DataFrame:
    return p.issues["accounts"].unionByName(p.issues["contacts"]).unionByName(p.issues["leads"])


def survivor_pool(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines of orders as records of clusters, with many ties at every tier; of a repeated line the first in the order of the table."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    record = F.concat(F.lit("R"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), F.lit("-"), F.col("l_linenumber").cast("string"))
    rows = lines.select(
        F.coalesce(F.concat(F.lit("C"), F.col("l_orderkey").cast("string")), F.lit(NO_ID)).alias("canonical_id"), F.coalesce(record, F.lit(NO_ID)).alias("record_id"),
        (F.floor(F.col("l_quantity") / 25) * 10.0 + 70).alias("record_quality_score"), F.when(F.col("l_tax") < 0.04, 0.0).otherwise(100.0).alias("completeness_score"),
        (F.floor(F.col("l_discount") * 50)).cast("long").alias("issue_count"), F.unix_date(F.trunc("l_shipdate", "month")).cast("long").alias("month"), F.lit("B").alias("quality_grade"),
        F.struct("_metadata.file_path", "_metadata.row_index").alias("_at"),
    )
    own = [c for c in rows.columns if c not in ("record_id", "_at")]
    rows = rows.groupBy("record_id").agg(F.min_by(F.struct(*own), "_at").alias("_row")).select("record_id", "_row.*")
    return rows.select("canonical_id", "record_id"), rows.drop("canonical_id")


def _raw_check_summary(p: Pipeline, sf_dir: str) -> DataFrame:
    """Issues by check of records that nobody has standardised."""
    raw = {n: base_table(p.spark, sf_dir, f"raw_{n}") for n in ENTITIES}
    rows = [quality.issues(quality.checked(n, df, p.settings, raw["accounts"].select("account_id"), p.std["stewardship"]), ENTITIES[n]) for n, df in raw.items()]
    return quality.check_summary(reduce(DataFrame.unionByName, rows))


def _leads_by_account(p: Pipeline) -> DataFrame:
    leads = p.golden["leads"].withColumn("account_id", F.expr(LEAD_ACCOUNT))
    return analytics.leads_by_industry(leads, p.golden["accounts"])


def _survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, pool = survivor_pool(spark, sf_dir)
    found = golden.survivors(members, pool, "record_id", dated=F.col("month")).drop("mapped_golden_id")
    return found.withColumns({c: F.nullif(F.col(c), F.lit(NO_ID)) for c in ("canonical_id", "survivor_id")})


def _exact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id"), F.sha2("text", 256).alias("digest"))
    return matching.star_matches(docs, "doc_id", "digest", "DOCUMENT", "EXACT").select("source_record_id", "matched_record_id")


def _unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source")
    return docs.join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id"), "doc_id", "left_anti")


def _page_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    secure, query = text.matches(F.col("url"), "^https://"), text.matches(F.col("url"), r"[?]")
    return pages.agg(F.count("*").alias("total_rows"), F.count_if(text.blank(F.col("url"))).alias("blank_urls"), F.count_if(secure).alias("secure_urls"), F.count_if(query).alias("query_urls"))


def _turn_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.groupBy("role").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.count_if(text.blank(F.col("text"))).alias("blank_turns"))


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {f"std_{t}": _of(lambda p, t=t: p.std[t]) for t in standardize.STANDARDS}
    out |= {
        "std_change_summary": _of(lambda p: standardize.change_summary(p.staged)),
        "schema_validation_summary": _of(lambda p: ingest.schema_summary(p.spark, p.staged)),
        "ingest_null_profile": _of(lambda p: ingest.null_profile(p.staged)),
        "match_keys_accounts": _of(lambda p: matching.with_keys(p.std)["accounts"].select("account_id", "match_key_name")),
        "match_keys_contacts": _of(lambda p: matching.with_keys(p.std)["contacts"].select("contact_id", "match_key_email", "match_key_name")),
        "exact_matches_accounts": _of(lambda p: matching.star_matches(matching.with_keys(p.std)["accounts"], "account_id", "match_key_name", "ACCOUNT", "EXACT")),
        "exact_matches_contacts": _of(lambda p: matching.star_matches(matching.with_keys(p.std)["contacts"], "contact_id", "match_key_email", "CONTACT", "EXACT")),
        "exact_matches_leads": _of(lambda p: matching.star_matches(matching.with_keys(p.std)["leads"], "lead_id", "match_key_name", "LEAD", "EXACT")),
        "golden_matches": _of(lambda p: matching.golden_matches(p.std["golden_map"])),
        "fuzzy_candidate_pairs": _of(_candidates), "fuzzy_levenshtein_pairs": _of(lambda p: matching.edit_distance_pairs(matching.with_keys(p.std)["accounts"], "account_id", "match_key_name", p.settings)),
        "fuzzy_matches_accounts": _of(lambda p: _fuzzy(p, "accounts", "match_key_name")), "fuzzy_matches_contacts": _of(lambda p: _fuzzy(p, "contacts", "match_key_email")),
        "survivorship_tiers": _survivors, "exact_documents": _exact_documents, "unlabelled_documents": _unlabelled, "page_formats": _page_formats, "conversation_roles": _turn_counts,
        "full_run_governance": _of(lambda p: p.governance, fuzzy=True), "schema_validation_details": _of(lambda p: ingest.schema_details(p.spark, p.staged)),
        "dq_raw_check_summary": lambda spark, sf_dir: _raw_check_summary(pipeline(spark, sf_dir), sf_dir), "leads_by_account_industry": _of(_leads_by_account),
    }
    whole = {f"full_{name}": query for name, query in _matched(fuzzy=True).items() if name != "governance_metrics"}
    return out | _matched(fuzzy=False) | whole


def _matched(fuzzy: bool) -> dict[str, Query]:
    """The queries that read match edges, of the whole job or without the fuzzy edges that SQL cannot express."""
    of = partial(_of, fuzzy=fuzzy)
    out: dict[str, Query] = {
        "match_table": of(lambda p: p.matches), "match_summary": of(lambda p: matching.match_summary(p.matches)),
        "dedup_kpis": of(lambda p: clusters.dedup_kpis({n: p.std[n] for n in ENTITIES}, p.each(p.dedup), {n: e.kind for n, e in ENTITIES.items()})),
    }
    for name in ENTITIES:
        out |= {
            f"cluster_map_{name}": of(lambda p, n=name: p.clusters(n)), f"dedup_{name}": of(lambda p, n=name: p.dedup[n]),
            f"record_quality_{name}": of(lambda p, n=name: p.record_quality[n]), f"golden_{name}": of(lambda p, n=name: p.golden[n]),
        }
    out |= {f"dq_issues_{d}": _dimension(d, fuzzy) for d in Settings().weights}
    out |= {
        "dq_scores": of(lambda p: p.scores), "crm_health": of(lambda p: p.scores.where("entity = 'CRM HEALTH SCORE'").select("score")),
        "dq_check_summary": of(lambda p: quality.check_summary(_all_issues(p))),
        "dq_issues_all_known_accounts": of(lambda p: p.issues["contacts"].where("dq_check = 'consistency_orphan_contact_account_id'"), orphan_scope="all"),
        "golden_summary": of(lambda p: golden.golden_summary(p.each(p.golden))), "golden_coverage": of(lambda p: analytics.golden_coverage(p.each(p.golden))),
        "governance_metrics": of(lambda p: p.governance), "quality_bands": of(lambda p: analytics.quality_bands(p.each(p.record_quality))),
        "executive_summary": of(lambda p: analytics.executive_summary(p.each(p.golden), p.business)),
        "business_analytics_dataset": of(lambda p: analytics.business_dataset(p.each(p.golden), p.business, p.settings)),
        "segmentation": of(lambda p: analytics.segmentation(p.business)),
    }
    for name in ("lead_funnel", "lead_source_performance", "industry_distribution", "country_distribution", "account_size_distribution", "revenue_distribution", "job_title_distribution", "leads_by_industry"):
        out[name] = of(lambda p, n=name: p.business[n])
    return out


def _candidates(p: Pipeline) -> DataFrame:
    keyed = matching.with_keys(p.std)["accounts"]
    exact = matching.star_matches(keyed, "account_id", "match_key_name", "ACCOUNT", "EXACT")
    return matching.fuzzy_candidates(keyed, "account_id", "match_key_name", matching.matched_ids(exact), p.settings)


def _fuzzy(p: Pipeline, name: str, exact_key: str) -> DataFrame:
    keyed, entity = matching.with_keys(p.std)[name], ENTITIES[name]
    exact = matching.star_matches(keyed, entity.id_col, exact_key, entity.kind, "EXACT")
    return matching.fuzzy_matches(keyed, entity.id_col, "match_key_name", entity.kind, matching.matched_ids(exact), p.settings)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match, merge, score and report: the governance metrics of a run."""
    return pipeline(spark, sf_dir, fuzzy=True).governance
