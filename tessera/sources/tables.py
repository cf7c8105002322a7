"""Reading base tables: a registry of names, formats and schemas."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tessera import config
from tessera.sources.workbook import read_workbook

#: Sheet names of a workbook for each base table.
SHEETS = {"accounts": "Accounts", "contacts": "Contacts", "leads": "Leads", "stewardship": "Data_Stewardship", "golden_map": "Golden_Record_Map"}
READERS = {"parquet": "parquet", "csv": "csv", "json": "json", "orc": "orc"}


def text_schema(table: str) -> T.StructType:
    """The base table with every column as text, as raw files are read."""
    return T.StructType([T.StructField(c, T.StringType()) for c in config.SCHEMAS[table]])


def standard_schema(table: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.DoubleType() if c in config.NUMBERS else T.StringType()) for c in config.SCHEMAS[table]])


def empty_table(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], standard_schema(table))


def read_table(spark: SparkSession, folder: str, table: str, kind: str = "parquet") -> DataFrame | None:
    """One table of a folder, or None where it is missing.

    Files without types are read as text under their own header; nothing is inferred.
    """
    reader = spark.read.option("header", True) if kind == "csv" else spark.read
    path = f"{folder.rstrip('/')}/{table}.{kind}"
    try:
        return reader.format(READERS[kind]).load(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def load_tables(spark: SparkSession, folder: str, kind: str = "parquet") -> dict[str, DataFrame]:
    """All base tables of a folder; missing ones are empty, others in the folder are left alone."""
    found = {t: read_table(spark, folder, t, kind) for t in config.SCHEMAS}
    return {t: df if df is not None else empty_table(spark, t) for t, df in found.items()}


def load_workbook(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Base tables from the sheets of a workbook on the driver, every cell as text.

    Unknown sheets are ignored, missing ones empty.
    """
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    sheets = read_workbook(path)
    out = {}
    for table, sheet in SHEETS.items():
        if sheet not in sheets:
            out[table] = empty_table(spark, table)
        else:
            columns, rows = sheets[sheet]
            out[table] = spark.createDataFrame(rows, T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return out


def resolve(spark: SparkSession, given: dict[str, DataFrame], table: str, folder: str, kind: str = "parquet") -> DataFrame:
    """A table that is given, else a temporary view of its name, else its file, else empty."""
    if given.get(table) is not None:
        return given[table]
    if spark.catalog.tableExists(table):
        return spark.table(table)
    found = read_table(spark, folder, table, kind)
    if found is not None:
        return found
    return empty_table(spark, table) if table in config.SCHEMAS else spark.createDataFrame([], T.StructType([]))
