"""Grades, bands, buckets and shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _steps(c: Column, steps: list[tuple[float, str]], last: str) -> Column:
    out = F.when(c >= steps[0][0], steps[0][1])
    for least, name in steps[1:]:
        out = out.when(c >= least, name)
    return out.otherwise(last)


def grade(c: Column) -> Column:
    return _steps(c, [(90, "A"), (80, "B"), (70, "C")], "D")


def quality_band(c: Column) -> Column:
    return _steps(c, [(90, "Excellent"), (75, "Good"), (60, "Fair")], "Poor")


def revenue_bucket(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c) | (c < 0), "Unknown").otherwise(_steps(c, [(1e8, "100M+"), (1e7, "10M - 100M"), (1e6, "1M - 10M")], "< 1M"))


def size_bucket(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c) | (c <= 0), "Unknown").when(c <= 100, "Small").when(c <= 1000, "Medium").otherwise("Large")


def confidence(score: Column, kind: Column, high: float, medium: float) -> Column:
    return F.when(kind.isin("EXACT", "GOLDEN") | (score >= high), "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")


def share(part: Column, total: Column, of_nothing: float) -> Column:
    """Percentage to two places; ``of_nothing`` when there is nothing to share."""
    return F.when(total == 0, F.lit(of_nothing)).otherwise(F.round(part.cast("double") / F.nullif(total, F.lit(0)).cast("double") * 100, 2))
