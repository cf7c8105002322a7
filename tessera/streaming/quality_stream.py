"""Data-quality checks on a stream of records, without state.

Checks that look at one record alone (completeness, validity, consistency within
the record, freshness) run on a stream as they do on a table. Checks across records
(repeats, orphans, open stewardship) belong to the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import ENTITIES, Settings
from tessera.operators import ingest, quality, standardize


def stream_issues(records: DataFrame, name: str, settings: Settings | None = None) -> DataFrame:
    """Issues of each record of a stream (or table) of raw records of one entity."""
    settings, entity = settings or Settings(), ENTITIES[name]
    std = standardize.STANDARDS[name](ingest.clean_table(records, name))
    found = []
    for check in quality.record_checks(name, std, settings):
        found.append(F.when(check.fails, F.struct(F.lit(check.dimension.capitalize()).alias("dimension"), F.lit(check.name).alias("dq_check"), F.lit(check.field).alias("field_name"), F.lit(check.severity).alias("severity"))))
    issues = F.filter(F.array(*found), lambda x: x.isNotNull())
    return std.select(F.col(entity.id_col).cast("string").alias("record_id"), F.lit(entity.kind).alias("entity_type"), F.explode(issues).alias("i")).select("record_id", "entity_type", "i.*")
