"""One command for a whole run: ``python -m tessera.run IN OUT [--kind parquet|csv|json|orc|xlsx] [--as-of DAY]``."""

from __future__ import annotations

import argparse
import logging
from datetime import date

from tessera.config import Settings
from tessera.plans.pipeline import Pipeline
from tessera.sources.sinks import write_run
from tessera.sources.tables import load_tables, load_workbook
from tessera.storage import build_session


def main(arguments: list[str] | None = None) -> list[str]:
    """Load the base tables, make every derived table, and write tables, logs and reports."""
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("source", help="folder of base tables, or a workbook")
    parser.add_argument("target", help="folder for tables, logs and reports")
    parser.add_argument("--kind", default="parquet", choices=["parquet", "csv", "json", "orc", "xlsx"])
    parser.add_argument("--as-of", type=date.fromisoformat, default=Settings().as_of)
    parser.add_argument("--orphan-scope", default="canonical", choices=["canonical", "all"])
    given = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    spark = build_session()
    base = load_workbook(spark, given.source) if given.kind == "xlsx" else load_tables(spark, given.source, given.kind)
    return write_run(Pipeline(spark, base, Settings(as_of=given.as_of, orphan_scope=given.orphan_scope)), given.target)


if __name__ == "__main__":
    main()
