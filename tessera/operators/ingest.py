"""Cleaning of raw tables, schema validation and null profiles."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import config
from tessera.functions import text


def column_name(name: str) -> str:
    return re.sub(r"\s", "_", name.strip().lower())


def clean_table(df: DataFrame, table: str) -> DataFrame:
    """Normal column names, stripped texts, numbers where the schema has them; extra columns stay."""
    df = df.toDF(*[column_name(c) for c in df.columns])
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in config.NUMBERS and f.name in config.SCHEMAS.get(table, []):
            columns.append(text.number(c).alias(f.name))
        else:
            columns.append(text.strip(c).alias(f.name) if isinstance(f.dataType, T.StringType) else c)
    return df.select(*columns)


def null_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns and nulls of each table, one scan a table."""
    rows = []
    for name, df in tables.items():
        nulls = reduce(lambda a, b: a + b, [F.sum(F.col(f"`{c}`").isNull().cast("long")) for c in df.columns])
        rows.append(df.agg(F.count("*").alias("total_rows"), F.coalesce(nulls, F.lit(0)).alias("null_values")).select(F.lit(name).alias("table_name"), "total_rows", F.lit(len(df.columns)).cast("long").alias("total_columns"), "null_values"))
    return reduce(DataFrame.unionByName, rows)


def schema_details(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """One row for each expected or extra column: is it present, and does its type fit.

    Names of missing and extra columns are compared in normal form, presence as the column is spelt.
    """
    rows = []
    for name, df in tables.items():
        kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        found = {c.strip().lower() for c in df.columns}
        for c in config.SCHEMAS[name]:
            want = "double" if c in config.NUMBERS else "string"
            fits = want == "string" or kinds.get(c) == want
            rows.append((name, c, want, kinds.get(c), "YES" if c in kinds else "NO", "OK" if c in kinds and fits else "MISSING" if c not in found else "CHECK"))
        rows += [(name, c, None, kinds.get(c), "YES", "EXTRA") for c in df.columns if c.strip().lower() not in config.SCHEMAS[name]]
    return spark.createDataFrame(rows, "table_name string, column_name string, expected_type string, actual_type string, present string, status string")


def schema_summary(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Expected columns, how many fit, and PASS or FAIL for each table."""
    details = schema_details(spark, tables).where(F.col("status") != "EXTRA")
    missing = F.sum((F.col("status") == "MISSING").cast("long"))
    counts = details.groupBy("table_name").agg(F.count("*").alias("expected_columns"), F.sum((F.col("present") == "YES").cast("long")).alias("present_columns"), missing.alias("missing_columns"))
    return counts.withColumn("status", F.when(F.col("missing_columns") == 0, "PASS").otherwise("FAIL"))
