import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from tessera.config import ENTITIES, Settings
from tessera.operators import analytics, clusters, components, golden, matching, ordering, quality
from tessera.operators.components import connected_components


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("n,m", [(60, 40), (60, 90), (1, 0)])
def test_components(spark, n, m):
    draw = random.Random(n * 100 + m)
    edges = [(draw.randrange(n), draw.randrange(n)) for _ in range(m)] + [(1000 + i, 1001 + i) for i in range(30 * (m > 0))]
    df = spark.createDataFrame(edges + [(None, 3)], "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: c for x, c in union_find(edges).items() if x in linked}


@pytest.mark.parametrize("few", [0, 100, 1 << 18])
def test_components_by_either_way(spark, few):
    draw = random.Random(few)
    edges = [(f"n{draw.randrange(300)}", f"n{draw.randrange(300)}") for _ in range(200)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src string, dst string"), few=few).collect()}
    assert got == {x: c for x, c in union_find((a, b) for a, b in edges if a != b).items()}


@pytest.mark.parametrize("large", [True, False])
def test_few_edges_are_no_shuffle(spark, large):
    edges = spark.range(20).repartition(5).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    plan = lambda one: components._star(edges, large, one).distinct()._jdf.queryExecution().executedPlan().toString()
    assert plan(True).count("Exchange hashpartitioning") == 0 < plan(False).count("Exchange hashpartitioning")


def test_neighbours(spark):
    rows = [(f"id{i:03d}", f"k{(i * 37) % 50:02d}") for i in range(90)]
    pairs = ordering.neighbour_pairs(spark.createDataFrame(rows, "id string, key string"), "key", "id", 10, block=16)
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    want = {(order[i][0], order[j][0]) for i in range(90) for j in range(i + 1, min(i + 11, 90))}
    got = [(r["a_id"], r["b_id"]) for r in pairs.collect()]
    assert len(got) == len(want) and set(got) == want


def test_numbers_are_consecutive(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert all(r["rn"] == r["x"] + 1 for r in ordering.numbered(df, ["x"]).collect())


def test_fuzzy_scores(spark):
    keys = [("A1", "company 1"), ("A2", "company 10"), ("B1", "abcd"), ("B2", "bcde"), ("C1", "abc"), ("C2", "abd"), ("D1", "acme"), ("D2", "acme holdings"), ("E1", "diet"), ("E2", "tide"), ("F", ""), ("G", None)]
    df = spark.createDataFrame(keys, "id string, k string")
    none = spark.createDataFrame([], "id string").withColumnRenamed("id", "id")
    out = matching.fuzzy_matches(df.withColumnRenamed("id", "rid"), "rid", "k", "ACCOUNT", none, Settings())
    got = {(r["matched_record_id"], r["source_record_id"]): (r["match_score"], r["confidence_level"]) for r in out.collect()}
    assert got[("A1", "A2")] == (0.9474, "HIGH") and got[("B1", "B2")] == (0.75, "MEDIUM")
    assert not {("C1", "C2"), ("D1", "D2"), ("E1", "E2")} & set(got)


def edges(spark, pairs, kind="ACCOUNT"):
    return spark.createDataFrame([(a, b, kind, "EXACT") for a, b in pairs], "source_record_id string, matched_record_id string, entity_type string, match_type string")


def test_clusters(spark):
    master = spark.createDataFrame([(x,) for x in "ABCDEF"], "account_id string")
    gold = spark.createDataFrame([("C",)], "id string")
    found = clusters.cluster_map(edges(spark, [("B", "A"), ("C", "B"), ("E", "D")]), ENTITIES["accounts"], master, gold)
    rows = {r["record_id"]: r for r in found.collect()}
    assert {x: rows[x]["canonical_id"] for x in rows} == {"A": "C", "B": "C", "C": "C", "D": "D", "E": "D", "F": "F"}
    assert rows["F"]["match_type_used"] == "NONE" and rows["F"]["cluster_size"] == 1 and rows["A"]["cluster_id"] == "CLU_ACC_C"
    kept = {r["account_id"]: (r["duplicate_count"], r["absorbed_ids"]) for r in clusters.dedup_table(master, ENTITIES["accounts"], found).collect()}
    assert kept == {"C": (2, "A,B"), "D": (1, "E"), "F": (0, "")}


def test_cluster_without_master_row(spark):
    master = spark.createDataFrame([("F",)], "account_id string")
    found = clusters.cluster_map(edges(spark, [("F", "AA")]), ENTITIES["accounts"], master)
    assert clusters.dedup_table(master, ENTITIES["accounts"], found).count() == 0 and found.count() == 2


TIERS = [
    ([("R1", 90.0, 0.0, 5, None), ("R2", 80.0, 100.0, 0, None)], "R1", "Highest record_quality_score"),
    ([("R1", 80.0, 0.0, 0, None), ("R2", 80.0, 100.0, 5, None)], "R2", "Highest completeness_score"),
    ([("R1", 80.0, 100.0, 2, None), ("R2", 80.0, 100.0, 1, None)], "R2", "Fewest DQ issues"),
    ([("R1", 80.0, 100.0, 1, "2024-01-01 00:00:00"), ("R2", 80.0, 100.0, 1, "2025-01-01 00:00:00")], "R2", "Most recent record"),
    ([("R2", 80.0, 100.0, 1, None), ("R1", 80.0, 100.0, 1, None)], "R1", "Lowest ID"),
    ([("R1", 10.0, 0.0, 9, None)], "R1", "Highest record_quality_score"),
]


@pytest.mark.parametrize("rows,survivor,reason", TIERS)
def test_survivor_tiers(spark, rows, survivor, reason):
    pool = spark.createDataFrame(rows, "id string, record_quality_score double, completeness_score double, issue_count long, created_date string")
    members = spark.createDataFrame([("C", r[0]) for r in rows], "canonical_id string, record_id string")
    r = golden.survivors(members, pool, "id").first()
    assert (r["survivor_id"], r["reason"], r["mapped_golden_id"]) == (survivor, reason, None)


def test_curated_survivor(spark):
    pool = spark.createDataFrame([(f"R{i}", 90.0 - i, 0.0, 0) for i in range(1, 4)], "id string, record_quality_score double, completeness_score double, issue_count long")
    members = spark.createDataFrame([("C", f"R{i}") for i in range(1, 4)], "canonical_id string, record_id string")
    lookup = spark.createDataFrame([("R3", "GOLD3"), ("R2", "GOLD2")], "record_id string, golden_id string")
    r = golden.survivors(members, pool, "id", lookup).first()
    assert (r["survivor_id"], r["reason"], r["mapped_golden_id"]) == ("R2", "Golden Record Map", "GOLD2")


def test_freshness_and_empty_tables(spark):
    rows = [("LED000001", "2024-06-06 23:00:00"), ("LED000002", "2024-06-05 00:00:00"), ("LED000003", None), ("LED000004", "soon")]
    leads = spark.createDataFrame(rows, "lead_id string, created_date string").withColumns({"lead_name": F.col("lead_id"), "source": F.lit("Web"), "status": F.lit("New")})
    checked = quality.checked("leads", leads, Settings(as_of=date(2026, 6, 6)))
    assert sorted(r["record_id"] for r in quality.issues(checked, ENTITIES["leads"]).collect()) == ["LED000002", "LED000003", "LED000004"]
    empty = {n: quality.checked(n, spark.createDataFrame([], ", ".join(f"{c} string" for c in [e.id_col, *quality.REQUIRED[n]])), Settings()) for n, e in {k: v for k, v in ENTITIES.items() if k != "accounts"}.items()}
    assert {r["score"] for r in quality.scores(empty, Settings()).collect()} == {100.0}


def test_record_quality(spark):
    rows = [("CON000001", "a@b.co", "ACC000001"), ("CON000002", "bad", "ACC000001"), ("X", "c@d.co", "nope")]
    contacts = spark.createDataFrame(rows, "contact_id string, email string, account_id string").withColumns({c: F.lit("x") for c in ("first_name", "last_name", "job_title")})
    checked = quality.checked("contacts", contacts, Settings())
    got = {r["contact_id"]: (r["record_quality_score"], r["quality_grade"], r["issue_count"], r["golden_record_eligible"]) for r in quality.record_quality(checked, ENTITIES["contacts"], Settings()).collect()}
    assert got == {"CON000001": (100.0, "A", 0, "YES"), "CON000002": (75.0, "C", 1, "NO"), "X": (75.0, "C", 2, "NO")}


def test_rows_of_one_id_share_their_issues(spark):
    rows = [("CON000001", "a@b.co"), ("CON000001", "bad"), (None, "bad"), (None, "bad"), ("CON000002", "bad")]
    contacts = spark.createDataFrame(rows, "contact_id string, email string").withColumns({c: F.lit("x") for c in ("first_name", "last_name", "job_title")}).withColumn("account_id", F.lit("ACC000001"))
    got = quality.record_quality(quality.checked("contacts", contacts, Settings()), ENTITIES["contacts"], Settings()).collect()
    # both rows repeat the id, one of them has an address that is bad and repeated
    assert sorted((r["contact_id"] or "", r["issue_count"]) for r in got) == [("", 0), ("", 0), ("CON000001", 4), ("CON000001", 4), ("CON000002", 2)]


def test_without_accounts_no_contact_is_an_orphan(spark):
    contacts = spark.createDataFrame([("CON000001", "ACC000009")], "contact_id string, account_id string").withColumns({c: F.lit("x") for c in ("first_name", "last_name", "job_title", "email")})
    for ids, orphans in (([], 0), (["ACC000001"], 1), (["ACC000009"], 0)):
        known = spark.createDataFrame([(x,) for x in ids], "account_id string")
        log = quality.issues(quality.checked("contacts", contacts, Settings(), known), ENTITIES["contacts"])
        assert log.where("dq_check LIKE '%orphan%'").count() == orphans


def test_stars_need_no_loop(spark):
    draw = random.Random(3)
    master = spark.createDataFrame([(f"L{i:03d}", f"name {draw.randrange(40)}") for i in range(120)], "lead_id string, lead_name string")
    found = matching.star_matches(master, "lead_id", "lead_name", "LEAD", "EXACT")
    plain, star = (clusters.cluster_map(found, ENTITIES["leads"], master, stars=s).collect() for s in (False, True))
    assert sorted(plain) == sorted(star) and matching.is_star("leads", Settings()) and not matching.is_star("contacts", Settings())


def test_reports_are_in_order(spark):
    leads = spark.createDataFrame([("Web", "Converted")] * 3 + [("LinkedIn", "New"), ("Odd", "New"), ("Referral", "Qualified")], "source string, status string")
    assert [r["source"] for r in analytics.lead_source_performance(leads).collect()] == ["LinkedIn", "Referral", "Web", "Odd"]
    spread = analytics.distribution(leads, F.col("source"), "source", "n").collect()
    assert [(r["source"], r["n"]) for r in spread] == [("Web", 3), ("LinkedIn", 1), ("Odd", 1), ("Referral", 1)]
    log = spark.createDataFrame([("D", "LEAD", c, "HIGH") for c in "abbccc"], "dimension string, entity_type string, dq_check string, severity string")
    assert [(r["dq_check"], r["issue_count"]) for r in quality.check_summary(log).collect()] == [("c", 3), ("b", 2), ("a", 1)]


def test_the_two_best_of_a_cluster_are_found_before_rows_move(spark):
    pool = spark.createDataFrame([(f"R{i}", 90.0, 0.0, 0) for i in range(30)], "id string, record_quality_score double, completeness_score double, issue_count long")
    plan = golden.survivors(pool.select(F.lit("C").alias("canonical_id"), F.col("id").alias("record_id")), pool, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # one in map tasks, one after the shuffle


def test_stars_that_share_an_id_are_one_cluster(spark):
    master = spark.createDataFrame([("L1", "a"), ("L3", "a"), ("L3", "b"), ("L2", "b"), ("L4", "b"), ("L5", "c")], "lead_id string, lead_name string")
    found = matching.star_matches(master, "lead_id", "lead_name", "LEAD", "EXACT")
    got = {r["record_id"]: (r["canonical_id"], r["cluster_size"]) for r in clusters.cluster_map(found, ENTITIES["leads"], master, stars=True).collect()}
    assert got == {**{f"L{i}": ("L1", 4) for i in range(1, 5)}, "L5": ("L5", 1)}


def test_quality_by_id_has_one_row_an_id(spark):
    rows = [("CON000001", "a@b.co"), ("CON000001", "bad"), (None, "bad"), (None, "bad"), ("CON000002", "bad")]
    contacts = spark.createDataFrame(rows, "contact_id string, email string").withColumns({c: F.lit("x") for c in ("first_name", "last_name", "job_title")}).withColumn("account_id", F.lit("ACC000001"))
    each = quality.record_quality(quality.checked("contacts", contacts, Settings()), ENTITIES["contacts"], Settings())
    got = quality.quality_by_id(each, ENTITIES["contacts"])
    assert sorted((r["contact_id"] or "", r["issue_count"]) for r in got.collect()) == [("", 0), ("CON000001", 8), ("CON000002", 2)] and got.columns == each.columns


def test_a_survivor_keeps_all_its_rows(spark):
    master = spark.createDataFrame([("L1", "a", "Web"), ("L1", "b", "Event"), ("L2", "c", "Web")], "lead_id string, lead_name string, source string")
    maps = spark.createDataFrame([("L1", "L1"), ("L2", "L2")], "record_id string, canonical_id string")
    scores = spark.createDataFrame([("L1", 80.0), ("L2", 90.0)], "lead_id string, record_quality_score double")
    got = golden.golden_records(ENTITIES["leads"], master, maps, scores).collect()
    reason = "Highest record_quality_score"  # a repeat of the survivor's own id is no rival
    assert sorted((r["golden_lead_id"], r["lead_name"], r["source"], r["survivorship_reason"]) for r in got) == [
        ("GOLD_LED_000001", "a", "Web", reason), ("GOLD_LED_000001", "b", "Event", reason), ("GOLD_LED_000002", "c", "Web", reason),
    ]


def test_changes_of_repeated_ids_are_counted_by_pairs(spark):
    from itertools import product

    from tessera.operators import standardize

    rows = [("LED1", "ann", "web", "New"), ("LED1", "Ann", "Web", None), ("LED2", None, "x", "new"), (None, "bo", "web", "new")]
    leads = spark.createDataFrame(rows, "lead_id string, lead_name string, source string, status string")
    after = {"ann": "Ann", "web": "Web", "x": "Other", "new": "New"}
    new = [(r[0], after.get(r[1], r[1]), after.get(r[2], r[2]), after.get(r[3] or "new", r[3])) for r in rows]
    pairs = [(a, b) for a, b in product(rows, new) if a[0] and a[0] == b[0]]
    want = {k: sum((a[i] or "") != (b[i] or "") for a, b in pairs) for i, k in ((1, "name_changes"), (2, "source_changes"), (3, "status_changes"))}
    got = standardize.change_summary({"leads": leads}).collect()
    assert {r["counter"]: r["changes"] for r in got} == want and {r["total_rows"] for r in got} == {len(pairs)}


def test_the_first_of_repeated_lines_counts(spark, tmp_path):
    from tessera.plans import registry

    columns = "l_orderkey long, l_linenumber int, l_quantity double, l_tax double, l_discount double, l_shipdate timestamp_ntz"
    line = lambda key, quantity: (key, 1, quantity, 0.0, 0.0, None)
    # Spark reads the longer file first
    for name, rows in (("part-0", [line(7, 60.0), line(7, 10.0)]), ("part-1", [line(k, 30.0) for k in (7, *range(100, 3000))])):
        spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{tmp_path}/{name}")
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        next((tmp_path / name).glob("*.parquet")).rename(tmp_path / "lineitem.parquet" / f"{name}.parquet")
    pool = registry.survivor_pool(spark, str(tmp_path))[1]
    assert [r["record_quality_score"] for r in pool.where("record_id = 'R000000007-1'").collect()] == [90.0] and pool.count() == 2901


def test_survivors_of_odd_lines_equal_the_sql(spark, tmp_path):
    from datetime import datetime

    from compare import same_rows

    from tessera.plans import oracle, registry

    columns = "l_orderkey long, l_linenumber int, l_quantity double, l_tax double, l_discount double, l_shipdate timestamp_ntz"
    old, new = datetime(1935, 5, 9), datetime(1999, 5, 9)
    rows = [
        (1, 1, 30.0, 0.0, None, new), (1, 2, 30.0, 0.0, 0.1, new),  # an unknown count of issues comes last
        (2, 1, 30.0, 0.0, 0.0, None), (2, 2, 30.0, 0.0, 0.0, new),  # an unknown date is last, and no date to beat
        (3, 1, 30.0, 0.0, 0.0, old), (3, 2, 30.0, 0.0, 0.0, datetime(1936, 1, 1)),  # days before 1970 are dates
        (4, 1, 30.0, 0.0, 0.0, new), (4, None, 60.0, 0.0, 0.0, new), (5, 1, None, None, None, None), (5, 2, None, None, None, None),
    ]
    for name, own in (("a", rows), ("b", [(None, 1, None, 0.0, 0.0, new), *rows[:2]])):
        (tmp_path / name).mkdir()
        spark.createDataFrame(own, columns).coalesce(1).write.parquet(f"{tmp_path}/{name}/rows")
        next((tmp_path / name / "rows").glob("*.parquet")).rename(tmp_path / name / "lineitem.parquet")
        for left in (tmp_path / name / "rows").iterdir():
            left.unlink()
        (tmp_path / name / "rows").rmdir()
        same_rows(registry.queries()["survivorship_tiers"](spark, f"{tmp_path}/{name}"), oracle.oracle_sql()["survivorship_tiers"], f"{tmp_path}/{name}")
