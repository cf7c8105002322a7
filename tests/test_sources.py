import zipfile

from pyspark.sql import functions as F

from tessera import run
from tessera.plans.adapter import base_tables
from tessera.plans.pipeline import Pipeline
from tessera.sources import sinks, tables, workbook
from tessera.streaming.quality_stream import stream_issues

FOLDER = "/root/testdata/sf0.001"


def test_missing_tables_are_empty(spark, tmp_path):
    base_tables(spark, FOLDER)["leads"].write.parquet(f"{tmp_path}/leads.parquet")
    loaded = tables.load_tables(spark, str(tmp_path))
    assert loaded["accounts"].count() == 0 and loaded["leads"].count() == 1000
    assert tables.resolve(spark, {}, "accounts", str(tmp_path)).columns == loaded["accounts"].columns


def test_csv_round_trip(spark, tmp_path):
    accounts = base_tables(spark, FOLDER)["accounts"]
    sinks.write_table(accounts, f"{tmp_path}/accounts.csv", "csv")
    p = Pipeline(spark, tables.load_tables(spark, str(tmp_path), "csv"))
    assert p.std["accounts"].agg(F.sum("annual_revenue")).first()[0] is not None and p.staged["accounts"].count() == 150


def test_whole_run_is_written(spark, tmp_path):
    base_tables(spark, FOLDER)["accounts"].coalesce(1).write.parquet(f"{tmp_path}/in/accounts.parquet")
    for name in ("contacts", "leads", "stewardship", "golden_map"):
        base_tables(spark, FOLDER)[name].limit(200).write.parquet(f"{tmp_path}/in/{name}.parquet")
    names = run.main([f"{tmp_path}/in", f"{tmp_path}/out", "--as-of", "2026-01-15"])
    assert {"ingestion_log", "governance_metrics", "dq_issues", "golden_leads", "dedup_map_accounts", "quality_scores_contacts", "entity_match_table", "std_golden_map"} <= set(names)
    read = lambda name: spark.read.parquet(f"{tmp_path}/out/{name}")
    assert all(read(name).columns for name in names)
    assert {r["entity_type"] for r in read("dq_issues").select("entity_type").distinct().collect()} == {"ACCOUNT", "CONTACT", "LEAD"}
    assert (tmp_path / "out/dq_issues/entity_type=LEAD").is_dir() and read("governance_metrics").count() == 15
    assert {r["table_name"]: r["total_rows"] for r in read("ingestion_log").collect()} == {"accounts": 150, "contacts": 200, "leads": 200, "stewardship": 150, "golden_map": 30}
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/out/logs/run").collect()]
    assert len(lines) == len(names) + 8 and all(" INFO wrote " in x for x in lines)
    books = {p.stem: workbook.read_workbook(str(p)) for p in (tmp_path / "out/reports").glob("*.xlsx")}
    assert sorted(books) == ["business", "data_quality", "deduplication", "entity_resolution", "golden_records", "governance", "schema_validation", "standardisation"]
    assert len(books["governance"]["KPI Summary"][1]) == 8 and len(books["governance"]["Governance Issues"][1]) == 3 and len(books["business"]["Executive Summary"][1]) == 8
    for book in books.values():
        assert all(columns and "style" not in columns for columns, _ in book.values())
    column = lambda book, sheet, name: [r[books[book][sheet][0].index(name)] for r in books[book][sheet][1]]
    counts = [float(x) for x in column("data_quality", "Check Summary", "issue_count")]
    assert counts == sorted(counts, reverse=True) and len(counts) > 8
    assert column("business", "Lead Funnel", "status")[:6] == ["New", "Working", "Qualified", "Converted", "Unqualified", "Nurturing"]
    sizes = [float(x) for x in column("deduplication", "Contacts Clusters", "cluster_size")]
    assert sizes == sorted(sizes, reverse=True)
    ids = column("data_quality", "Issue Log", "record_id")
    kinds = column("data_quality", "Issue Log", "entity_type")
    assert list(zip(kinds, ids, strict=True)) == sorted(zip(kinds, ids, strict=True))


def test_workbooks(spark, tmp_path):
    sheets = {"Accounts": (["account_id", "annual_revenue", "style"], [("ACC<1>", 1.5, "good"), ("ü \n", None, "poor"), (None, 3, None)]), "Leads": (["lead_id"], [])}
    path = tmp_path / "book.xlsx"
    path.write_bytes(workbook.workbook_bytes(sheets))
    assert workbook.read_workbook(str(path)) == {"Accounts": (["account_id", "annual_revenue"], [["ACC<1>", "1.5"], ["ü \n", None], [None, "3"]]), "Leads": (["lead_id"], [])}
    with zipfile.ZipFile(path) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert 's="1"' in sheet and 's="2"' in sheet and 's="4"' in sheet  # header, good, poor
    tables_ = tables.load_workbook(spark, str(path))
    assert [tuple(r) for r in tables_["accounts"].collect()] == [("ACC<1>", "1.5"), ("ü \n", None), (None, "3")]
    assert tables_["leads"].columns == ["lead_id"] and tables_["contacts"].count() == 0
    assert Pipeline(spark, {"accounts": tables_["accounts"].withColumns({c: F.lit(None).cast("string") for c in ("account_name", "industry", "country", "employee_count")})}).staged["accounts"].agg(F.sum("annual_revenue")).first()[0] == 4.5


def test_stream(spark, tmp_path):
    leads = base_tables(spark, FOLDER)["leads"]
    leads.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(leads.schema).parquet(f"{tmp_path}/in")
    query = stream_issues(stream, "leads").writeStream.format("memory").queryName("lead_issues").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("lead_issues").count() == stream_issues(leads, "leads").count() > 0
