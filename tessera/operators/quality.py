"""Data-quality checks, issue log, scores and record quality.

Checks are declared once; one projection of an entity evaluates all of them, so the
entity is scanned once for issues and scores alike. Facts about other rows (repeats,
known accounts, open stewardship) are joined as flags beforehand.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import config
from tessera.config import ENTITIES, Entity, Settings
from tessera.functions import text
from tessera.functions.scoring import grade, share

ISSUE_COLUMNS = ["record_id", "entity_type", "dimension", "dq_check", "field_name", "issue_value", "severity"]


@dataclass(frozen=True)
class Check:
    name: str
    field: str
    severity: str
    fails: Column

    @property
    def dimension(self) -> str:
        return self.name.split("_", 1)[0]


REQUIRED = {
    "accounts": ["account_name", "industry", "country", "annual_revenue", "employee_count"],
    "contacts": ["first_name", "last_name", "email", "job_title", "account_id"],
    "leads": ["lead_name", "source", "status"],
}


def _repeated(df: DataFrame, keys: list[str], flag: str, where: Column | None = None) -> DataFrame:
    """Flag rows whose keys occur more than once; counts are combined before they are joined."""
    own = [F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(f"_{flag}_{i}") for i, k in enumerate(keys)]
    named = [f"_{flag}_{i}" for i in range(len(keys))]
    source = df if where is None else df.where(where)
    counts = source.groupBy(*own).count().where("count > 1").withColumn(flag, F.lit(True)).drop("count")
    out = df.select("*", *own).join(counts, named, "left").drop(*named)
    usable = F.lit(True) if where is None else where
    return out.withColumn(flag, F.coalesce(flag, F.lit(False)) & usable)


def _facts(name: str, df: DataFrame, known: DataFrame | None, stewardship: DataFrame | None) -> DataFrame:
    entity = ENTITIES[name]
    df = _repeated(df, [entity.id_col], "_same_id")
    if name == "accounts" and stewardship is not None:
        open_ids = stewardship.where(text.one_of(F.col("dq_issue_status"), config.OPEN_ISSUE_STATUSES)).select(F.col("account_id").alias("_a")).distinct()
        df = df.join(open_ids.withColumn("_open", F.lit(True)), F.col("account_id") == F.col("_a"), "left").drop("_a")
    if name == "contacts":
        df = _repeated(df, ["email"], "_same_email", ~text.blank(F.col("email")))
        if known is not None:
            ids = known.select(F.col("account_id").alias("_a"))
            some = ids.limit(1).agg((F.count("*") > 0).alias("_some"))  # one row: without any account no contact is an orphan
            df = df.join(ids.where("_a IS NOT NULL").distinct().withColumn("_known", F.lit(True)), F.col("account_id") == F.col("_a"), "left").drop("_a")
            df = df.join(F.broadcast(some))
    if name == "leads":
        df = _repeated(df, ["lead_name", "source"], "_same_lead", ~text.blank(F.col("lead_name")))
    return df


def _stale(df: DataFrame, settings: Settings, otherwise: Column) -> Column:
    """Older than the limit or without a readable date; ``otherwise`` for tables without dates."""
    for c in config.DATE_COLUMNS:
        if c in df.columns:
            dated = df.schema[c].dataType.typeName().startswith(("timestamp", "date"))
            when = (F.col(c) if dated else F.try_to_timestamp(F.col(c))).cast("timestamp_ntz")
            age = F.timestamp_diff("DAY", when, F.lit(settings.as_of).cast("timestamp_ntz"))
            return F.coalesce(age > settings.fresh_days, F.lit(True))
    return otherwise


def _checks(name: str, df: DataFrame, settings: Settings) -> list[Check]:
    has, c = set(df.columns), F.col
    out = [Check(f"completeness_missing_{f}", f, "HIGH", text.blank(c(f)) if f in has else F.lit(True)) for f in REQUIRED[name]]

    def add(check: str, field: str, severity: str, fails: Column, *needs: str) -> None:
        if has.issuperset(needs or (field,)):
            out.append(Check(check, field, severity, F.coalesce(fails, F.lit(False))))

    def lacks(field: str, pattern: str) -> Column:
        return c(field).isNotNull() & ~text.matches(c(field), pattern)

    def number(field: str) -> Column:
        return F.nanvl(c(field), F.lit(None).cast("double")) if df.schema[field].dataType.typeName() == "double" else text.number(c(field))

    if name == "accounts":
        add("validity_invalid_industry", "industry", "MEDIUM", ~text.one_of(c("industry"), list(config.INDUSTRIES)))
        add("validity_invalid_country", "country", "MEDIUM", ~text.one_of(c("country"), list(config.COUNTRIES)))
        for f in config.NUMBERS:
            if f in has:
                add(f"validity_non_numeric_{f}", f, "MEDIUM", c(f).isNotNull() & number(f).isNull())
                add(f"validity_negative_{f}", f, "HIGH", number(f) < 0)
        if has.issuperset(config.NUMBERS):
            add("consistency_revenue_without_employees", "employee_count", "LOW", (number("annual_revenue") > 0) & (number("employee_count") == 0))
        add("uniqueness_open_stewardship_issue", "account_id", "MEDIUM", c("_open"), "_open")
        if has.issuperset(config.NUMBERS):
            add("freshness_stale_account", "", "LOW", _stale(df, settings, text.blank(c("annual_revenue")) & text.blank(c("employee_count"))), "account_id")
    elif name == "contacts":
        bad = ~text.valid_email(c("email"))
        add("validity_invalid_email", "email", "HIGH", bad | (c("email_valid") == "NO") if "email_valid" in has else bad)
        add("validity_invalid_account_id_format", "account_id", "MEDIUM", lacks("account_id", config.ACCOUNT_ID))
        add("validity_invalid_contact_id_format", "contact_id", "MEDIUM", ~text.matches(c("contact_id"), config.CONTACT_ID))
        if "phone" in has:
            add("validity_invalid_phone", "phone", "LOW", ~text.blank(c("phone")) & ~text.matches(text.strip(c("phone")), config.PHONE))
        add("consistency_orphan_contact_account_id", "account_id", "HIGH", c("account_id").isNotNull() & c("_known").isNull() & c("_some") if "_known" in has else F.lit(False), "account_id")
        add("uniqueness_duplicate_email", "email", "HIGH", c("_same_email"), "_same_email")
        add("freshness_stale_contact", "", "LOW", _stale(df, settings, text.blank(c("email")) & text.blank(c("job_title"))), "contact_id")
    else:
        add("validity_invalid_lead_status", "status", "MEDIUM", ~text.one_of(c("status"), config.LEAD_STATUSES))
        add("validity_invalid_lead_source", "source", "MEDIUM", ~text.one_of(c("source"), config.LEAD_SOURCES))
        add("validity_invalid_lead_id_format", "lead_id", "MEDIUM", ~text.matches(c("lead_id"), config.LEAD_ID))
        add("consistency_converted_lead_missing_source", "source", "MEDIUM", (c("status") == "Converted") & text.blank(c("source")), "status", "source")
        add("uniqueness_duplicate_lead_name_source", "lead_name", "MEDIUM", c("_same_lead"), "_same_lead")
        idle = (c("status") == "Unqualified") & text.clean(c("source")).isin("Other", "")
        add("freshness_stale_lead", "", "LOW", _stale(df, settings, idle), "lead_id")
    id_col = ENTITIES[name].id_col
    add(f"uniqueness_duplicate_{id_col}", id_col, "HIGH", c("_same_id"), "_same_id")
    return out


def record_checks(name: str, df: DataFrame, settings: Settings) -> list[Check]:
    """The checks that need nothing but the record itself."""
    return [c for c in _checks(name, df, settings) if c.dimension != "uniqueness" and "orphan" not in c.name]


def checked(name: str, df: DataFrame, settings: Settings, known: DataFrame | None = None, stewardship: DataFrame | None = None) -> DataFrame:
    """The entity's rows with ``_issues``, an array of the checks that they fail."""
    facts = _facts(name, df, known, stewardship)
    found = []
    for check in _checks(name, facts, settings):
        value = text.issue_text(F.col(check.field), df.schema[check.field].dataType.simpleString()) if check.field in df.columns else F.lit("")
        parts = {"dimension": F.lit(check.dimension.capitalize()), "dq_check": F.lit(check.name), "field_name": F.lit(check.field), "issue_value": value, "severity": F.lit(check.severity)}
        found.append(F.when(check.fails, F.struct(*[v.alias(k) for k, v in parts.items()])))
    return facts.select(*df.columns, F.filter(F.array(*found), lambda x: x.isNotNull()).alias("_issues"))


def issues(rows: DataFrame, entity: Entity) -> DataFrame:
    flat = rows.select(F.col(entity.id_col).cast("string").alias("record_id"), F.lit(entity.kind).alias("entity_type"), F.explode("_issues").alias("i"))
    return flat.select("record_id", "entity_type", "i.*").select(*ISSUE_COLUMNS)


def dimension_counts(rows: DataFrame, entity: Entity, settings: Settings) -> DataFrame:
    """``entity, dimension, total, passing``: one aggregate over the checked rows."""
    fails = lambda d: F.exists("_issues", lambda i: i["dimension"] == d.capitalize())
    wide = rows.agg(F.count("*").alias("total"), *[F.sum((~fails(d)).cast("long")).alias(d.capitalize()) for d in settings.weights])
    return wide.fillna(0).unpivot(["total"], [d.capitalize() for d in settings.weights], "dimension", "passing").select(F.lit(entity.table.upper()).alias("entity"), "dimension", "total", "passing")


def scores(checked_rows: dict[str, DataFrame], settings: Settings) -> DataFrame:
    """21 rows: five dimensions of three entities, five overall by size, and the health score."""
    counts = reduce(DataFrame.unionByName, [dimension_counts(df, ENTITIES[name], settings) for name, df in checked_rows.items()])
    weight = F.try_element_at(F.create_map(*[F.lit(x) for d, w in settings.weights.items() for x in (d.capitalize(), w)]), F.col("dimension"))
    own = counts.withColumn("score", share(F.col("passing"), F.col("total"), 100.0)).withColumn("weight", weight)
    every = F.sum("total")
    overall = own.groupBy("dimension", "weight").agg(F.when(every == 0, 100.0).otherwise(F.round(F.sum(F.col("score") * F.col("total")) / F.nullif(every, F.lit(0)), 2)).alias("score"))
    health = overall.agg(F.round(F.sum(F.col("score") * F.col("weight")), 2).alias("score"))
    columns = ["entity", "dimension", "score", "weight"]
    return (
        own.select(*columns)
        .unionByName(overall.select(F.lit("OVERALL").alias("entity"), "dimension", "score", "weight"))
        .unionByName(health.select(F.lit("CRM HEALTH SCORE").alias("entity"), F.lit("Weighted Average").alias("dimension"), "score", F.lit(1.0).alias("weight")))
    )


def check_summary(log: DataFrame) -> DataFrame:
    """Issues by check, most frequent first."""
    counts = log.groupBy("dimension", "entity_type", "dq_check", "severity").agg(F.count("*").alias("issue_count"))
    return counts.orderBy(F.desc("issue_count"), "entity_type", "dq_check")


def quality_by_id(quality: DataFrame, entity: Entity) -> DataFrame:
    """One row for each id; the issues of an id count once for each row that has it."""
    counts = ["issue_count", "high_severity_issues"]
    same = [c for c in quality.columns if c not in (entity.id_col, *counts)]
    return quality.groupBy(entity.id_col).agg(*[F.first(c).alias(c) for c in same], *[F.sum(c).alias(c) for c in counts]).select(*quality.columns)


def record_quality(rows: DataFrame, entity: Entity, settings: Settings) -> DataFrame:
    """Scores, grade, issue counts and eligibility of each record; rows of one id share their issues.

    Only rows that a check found to repeat an id are grouped; all others are judged where they are.
    Rows without an id have no issues of their own.
    """
    own_id, repeats = F.col(entity.id_col).cast("string"), f"uniqueness_duplicate_{entity.id_col}"
    found = F.when(own_id.isNull(), F.expr("filter(_issues, x -> false)")).otherwise(F.col("_issues"))
    counts = {"issue_count": F.size("_i"), "high_severity_issues": F.size(F.filter("_i", lambda i: i["severity"] == "HIGH"))}
    fails = lambda d: F.exists("_i", lambda i: i["dimension"] == d.capitalize())
    flags = {f"_{d}": fails(d).cast("int") for d in settings.weights}
    own = rows.select(own_id.alias(entity.id_col), found.alias("_i")).select(
        entity.id_col, F.exists("_i", lambda i: i["dq_check"] == repeats).alias("_repeats"), *[c.cast("long").alias(k) for k, c in counts.items()], *[c.alias(k) for k, c in flags.items()],
    )
    several = own.where("_repeats")
    shared = several.groupBy(F.col(entity.id_col).alias("_id")).agg(*[F.sum(k).alias(k) for k in counts], *[F.max(k).alias(k) for k in flags])
    together = several.select(entity.id_col).join(shared, F.col(entity.id_col) == F.col("_id")).drop("_id")
    joined = own.where("NOT _repeats").drop("_repeats").unionByName(together)
    score = {f"{d}_score": F.when(F.col(f"_{d}") == 1, 0.0).otherwise(100.0) for d in settings.weights}
    quality = F.round(reduce(lambda a, b: a + b, [F.col(f"{d}_score") * w for d, w in settings.weights.items()]), 2)
    out = joined.withColumns(score).withColumn("record_quality_score", quality)
    eligible = (F.col("record_quality_score") >= 80) & (F.col("high_severity_issues") == 0)
    return out.select(
        entity.id_col, F.lit(entity.kind).alias("entity_type"), *score, "record_quality_score", grade(F.col("record_quality_score")).alias("quality_grade"),
        "issue_count", "high_severity_issues", F.when(eligible, "YES").otherwise("NO").alias("golden_record_eligible"),
    )
