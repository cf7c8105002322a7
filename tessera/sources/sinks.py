"""Writing tables, logs and reports."""

from __future__ import annotations

import logging
import time
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import ENTITIES
from tessera.operators import analytics, clusters, golden, ingest, matching, quality, standardize
from tessera.plans.pipeline import Pipeline
from tessera.sources.workbook import workbook_bytes
from tessera.storage import scratch_files, write_bytes

log = logging.getLogger("tessera")
#: Rows of long sheets that a report shows, in the order it shows them; the tables beside it are whole.
SHOWN = 10_000
#: Output tables that are split by a column.
SPLIT = {"dq_issues": ["entity_type"]}


def write_table(df: DataFrame, path: str, kind: str = "parquet", single: bool = False, by: list[str] | None = None) -> None:
    """Overwrite one table; ``single`` makes one file of a small result."""
    rows = df.coalesce(1) if single else df
    arrays = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
    if kind == "csv" and arrays:
        rows = rows.withColumns({c: F.array_join(c, ",") for c in arrays})
    writer = rows.write.mode("overwrite").format(kind)
    if kind == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*by) if by else writer).save(path)


def write_run(pipeline: Pipeline, folder: str, kind: str = "parquet") -> list[str]:
    """Write every output table of a run, the ingestion log, all reports and a log of the run; returns the tables' names.

    What the run wrote for itself in the shared folder is deleted at the end.
    """
    spark, folder = pipeline.spark, folder.rstrip("/")
    lines: list[str] = []

    def note(message: str) -> None:
        log.info(message)
        lines.append(f"{datetime.now(timezone.utc).isoformat(timespec='seconds')} INFO {message}")

    small = {"dq_scores", "governance_metrics", "business_analytics_dataset", "ingestion_log", *pipeline.business}
    with scratch_files(spark):
        tables = pipeline.outputs() | {"ingestion_log": ingestion_log(spark, pipeline.base)}
        for name, df in tables.items():
            began = time.time()
            write_table(df, f"{folder}/{name}", kind, single=name in small, by=SPLIT.get(name))
            note(f"wrote {name} in {time.time() - began:.1f} s")
        for name, sheets in reports(pipeline).items():
            began = time.time()
            write_report(sheets, f"{folder}/reports/{name}")
            note(f"wrote report {name} of {len(sheets)} sheets in {time.time() - began:.1f} s")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/logs/run")
    return list(tables)


def ingestion_log(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """What was ingested when: rows, columns and nulls of each table."""
    now = datetime.now(timezone.utc).isoformat(timespec="seconds")
    return ingest.null_profile(tables).withColumns({"status": F.lit("SUCCESS"), "ingested_at": F.lit(now)})


def styled(df: DataFrame, column: str, good: float, fair: float) -> DataFrame:
    """Add the style of a score cell: good, fair or poor."""
    return df.withColumn("style", F.when(F.col(column) >= good, "good").when(F.col(column) >= fair, "fair").otherwise("poor"))


def run_information(spark: SparkSession, **facts: object) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in facts.items()], "item string, value string")


def by_severity(df: DataFrame) -> DataFrame:
    """Add the style of an issue by its severity."""
    return df.withColumn("style", F.when(F.col("severity") == "HIGH", "poor").when(F.col("severity") == "MEDIUM", "fair").otherwise("good"))


def reports(p: Pipeline) -> dict[str, dict[str, DataFrame]]:
    """Every report as an ordered set of sheets, each a lazy table in the order it is shown."""
    info = lambda name, **facts: run_information(p.spark, report=name, as_of=p.settings.as_of, orphan_scope=p.settings.orphan_scope, **facts)
    masters = {n: p.std[n] for n in ENTITIES}
    every = reduce(DataFrame.unionByName, [p.issues[n] for n in ENTITIES])
    first = lambda df, *order: df.orderBy(*order).limit(SHOWN)
    details = ingest.schema_details(p.spark, p.staged).withColumn("style", F.when(F.col("status") == "OK", "good").otherwise("poor"))
    checks = quality.check_summary(every)
    sizes = reduce(DataFrame.unionByName, [df.agg(F.lit(n).alias("table_name"), F.count("*").alias("records")) for n, df in p.each(p.golden).items()])
    headline = ["CRM Health Score", "Golden Record Coverage % - Overall", "Duplicate Rate", "Records Under Stewardship", "Records Requiring Review", "Excellent Records", "Poor Quality Records"]
    headline.append("Data Completeness %")
    kpis = p.governance.where(F.col("metric_name").isin(headline)).select("metric_name", "metric_value", "metric_category").orderBy(F.array_position(F.array(*[F.lit(x) for x in headline]), F.col("metric_name")))
    issues = p.governance.where("metric_category = 'Governance Issues'").select("metric_name", "metric_value").orderBy("metric_name")
    return {
        "schema_validation": {"Summary": ingest.schema_summary(p.spark, p.staged).orderBy("table_name"), "Column Detail": details.orderBy("table_name", "column_name")},
        "standardisation": {"Summary": standardize.change_summary(p.staged).orderBy("table_name", "counter"), "Run Info": info("standardisation")},
        "entity_resolution": {"Summary": matching.match_summary(p.matches).orderBy(F.col("entity_type") == "TOTAL", "entity_type", "match_type"), "Match Table": first(p.matches, "entity_type", F.desc("match_score"), "source_record_id", "matched_record_id"), "Run Info": info("entity_resolution")},
        "deduplication": {"KPI Summary": clusters.dedup_kpis(masters, p.each(p.dedup), {n: e.kind for n, e in ENTITIES.items()}).orderBy(F.col("entity_type") == "TOTAL", "entity_type"),
            **{f"{n.capitalize()} Clusters": first(p.clusters(n).where("cluster_size > 1"), F.desc("cluster_size"), "cluster_id", "record_id") for n in ENTITIES}, "Run Info": info("deduplication")},
        "data_quality": {"Health": p.scores.where("entity = 'CRM HEALTH SCORE'"), "Scores by Entity": styled(p.scores, "score", 90, 75).orderBy("entity", "dimension"), "Check Summary": by_severity(checks).orderBy(F.desc("issue_count"), "entity_type", "dq_check"),
            "Issue Log": first(by_severity(every), "entity_type", "record_id", "dq_check"), **{f"{n.capitalize()} Scores": first(styled(p.record_quality[n], "record_quality_score", 90, 75), "record_quality_score", ENTITIES[n].id_col) for n in ENTITIES}, "Run Info": info("data_quality")},
        "golden_records": {"Summary": golden.golden_summary(p.each(p.golden)), **{f"Golden {n.capitalize()}": first(p.golden[n], f"golden_{ENTITIES[n].id_col}") for n in ENTITIES}, "Run Info": info("golden_records")},
        "governance": {"KPI Summary": kpis, "All Metrics": p.governance.orderBy("metric_category", "metric_name"), "Quality Bands": analytics.quality_bands(p.each(p.record_quality)), "DQ Summary": p.scores.where("entity <> 'OVERALL'").orderBy("entity", "dimension"),
            "Golden Summary": analytics.golden_coverage(p.each(p.golden)).orderBy(F.col("entity_type") == "Overall", "entity_type"), "Governance Issues": issues, "Record Counts": sizes.orderBy("table_name"), "Run Info": info("governance")},
        "business": {"Executive Summary": analytics.executive_summary(p.each(p.golden), p.business), **{n.replace("_", " ").title(): df for n, df in p.business.items()}, "Segmentation": analytics.segmentation(p.business), "Run Info": info("business")},
    }


def write_report(sheets: dict[str, DataFrame], path: str) -> None:
    """One workbook, and a CSV folder for each sheet beside it. Sheets are bounded: figures, or :data:`SHOWN` rows."""
    held = {}
    for name, df in sheets.items():
        rows = df.collect()
        held[name] = (df.columns, [tuple(r) for r in rows])
        spark = df.sparkSession
        write_table(spark.createDataFrame(rows, df.schema).coalesce(1), f"{path}/{name.lower().replace(' ', '_')}", "csv")
    write_bytes(spark, f"{path}.xlsx", workbook_bytes(held))
