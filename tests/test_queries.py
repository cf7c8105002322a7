import importlib

import pytest
from compare import FOLDER, same_rows

from tessera.plans import oracle, registry

QUERIES, SQL = registry.queries(), oracle.oracle_sql()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    same_rows(QUERIES[name](spark, FOLDER), SQL[name])


@pytest.mark.parametrize("name,exact", [("accounts", "match_key_name"), ("contacts", "match_key_email")])
def test_fuzzy_matches(spark, name, exact):
    import difflib
    from collections import Counter

    key, id_col = "match_key_name", f"{name[:-1]}_id"
    rows = QUERIES[f"match_keys_{name}"](spark, FOLDER).collect()
    shared = Counter(r[exact] for r in rows if r[exact])
    left = sorted((r[key], r[id_col]) for r in rows if r[key] and shared[r[exact]] < 2)
    want = {}
    for i, (a, a_id) in enumerate(left):
        for b, b_id in left[i + 1 : i + 11]:
            ratio = difflib.SequenceMatcher(None, a, b).ratio()
            if ratio >= 0.75:
                want[b_id, a_id] = (round(ratio, 4), "HIGH" if ratio >= 0.9 else "MEDIUM")
    got = QUERIES[f"fuzzy_matches_{name}"](spark, FOLDER).collect()
    assert {(r["source_record_id"], r["matched_record_id"]): (r["match_score"], r["confidence_level"]) for r in got} == want and len(got) == len(want) > 0


def test_every_check_finds_something(spark):
    rows = QUERIES["dq_raw_check_summary"](spark, "/root/testdata/sf0.01").collect()
    assert len({r["dq_check"] for r in rows}) == 38 and [r["issue_count"] for r in rows] == sorted((r["issue_count"] for r in rows), reverse=True)


def test_leads_have_industries(spark):
    rows = QUERIES["leads_by_account_industry"](spark, FOLDER).collect()
    assert len(rows) > 3 and {"Unknown", "Manufacturing", "Retail"} <= {r["industry"] for r in rows}


def test_whole_matches_clusters_and_masters(spark):
    import difflib

    from test_operators import union_find

    from tessera.config import ENTITIES

    rows = lambda name: QUERIES[name](spark, FOLDER).collect()
    edges, kinds = {}, {"accounts": "ACCOUNT", "contacts": "CONTACT", "leads": "LEAD"}
    for rank, names in enumerate((["golden_matches"], [f"exact_matches_{n}" for n in kinds])):
        for r in (r for name in names for r in rows(name)):
            edges.setdefault((r["entity_type"], r["source_record_id"], r["matched_record_id"]), (rank, 1.0))
    for name, own in (("accounts", "match_key_name"), ("contacts", "match_key_name")):
        matched = {x for r in rows(f"exact_matches_{name}") for x in (r["source_record_id"], r["matched_record_id"])}
        keys = sorted((r[own], r[f"{name[:-1]}_id"]) for r in rows(f"match_keys_{name}") if r[own] and r[f"{name[:-1]}_id"] not in matched)
        for i, (a, a_id) in enumerate(keys):
            for b, b_id in keys[i + 1 : i + 11]:
                ratio = difflib.SequenceMatcher(None, a, b).ratio()
                if ratio >= 0.75:
                    edges.setdefault((kinds[name], b_id, a_id), (2, round(ratio, 4)))
    got = {(r["entity_type"], r["source_record_id"], r["matched_record_id"]): (["GOLDEN", "EXACT", "FUZZY"].index(r["match_type"]), r["match_score"]) for r in rows("full_match_table")}
    assert got == edges and {("ACCOUNT", 2), ("CONTACT", 2)} <= {(k[0], v[0]) for k, v in got.items()}
    first = {}
    for r in rows("std_golden_map"):
        if r["golden_record_id"] is not None and r["account_id"] is not None:
            first[r["golden_record_id"]] = min(first.get(r["golden_record_id"], r["account_id"]), r["account_id"])
    for name, kind in kinds.items():
        root = union_find((a, b) for k, a, b in edges if k == kind)
        master = {r[ENTITIES[name].id_col] for r in rows(f"std_{name}")}
        members = {}
        for x in master | set(root):
            members.setdefault(root.get(x, x), set()).add(x)
        heads = {min(m & set(first.values()) if name == "accounts" and m & set(first.values()) else m): m for m in members.values()}
        assert {r["record_id"]: (r["canonical_id"], r["cluster_size"]) for r in rows(f"full_cluster_map_{name}")} == {x: (h, len(m)) for h, m in heads.items() for x in m}
        kept = {r[ENTITIES[name].id_col]: r["absorbed_ids"] for r in rows(f"full_dedup_{name}")}
        assert kept == {h: ",".join(sorted(m - {h})) for h, m in heads.items() if h in master}
        assert {r[f"surviving_{ENTITIES[name].id_col}"] for r in rows(f"full_golden_{name}")} <= master


def test_entry_imports():
    entry = importlib.import_module("__spark_entry__")
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_lead_figures_with_repeated_ids(spark, tmp_path):
    import duckdb

    with duckdb.connect() as c:  # test ids beyond six digits are cut, so ten events share an id
        c.execute(f"COPY (SELECT e.* REPLACE (event_id % 50 + k * 500000 AS event_id) FROM '{FOLDER}/events.parquet' e CROSS JOIN range(4) r(k) WHERE event_id < 50) TO '{tmp_path}/events.parquet'")
        for t in ("customer", "nation", "orders"):
            c.execute(f"COPY (SELECT * FROM '{FOLDER}/{t}.parquet') TO '{tmp_path}/{t}.parquet'")
    for name in ("lead_funnel", "lead_source_performance", "leads_by_account_industry"):
        same_rows(QUERIES[name](spark, str(tmp_path)), SQL[name], str(tmp_path))


@pytest.mark.parametrize("name,read", [("lead_funnel", {"leads"}), ("lead_source_performance", {"leads"}), ("leads_by_industry", {"leads", "accounts"})])
def test_lead_figures_make_what_they_read(spark, name, read):
    from tessera.config import ENTITIES
    from tessera.plans.pipeline import _Lazy

    run = registry.pipeline(spark, FOLDER)
    columns = lambda n: ", ".join(f"'' AS {c}" for c in (f"golden_{n[:-1]}_id", f"surviving_{n[:-1]}_id", f"source_{n[:-1]}_ids", *ENTITIES[n].business))
    run.golden = _Lazy(lambda n: spark.sql(f"SELECT {columns(n)}"))
    assert run.business[name].columns and set(run.golden) == read
