"""The five base tables, derived from order-and-customer tables with noise that the checks can find.

The expressions are valid in Spark SQL and in ANSI dialects alike, so the same text
serves the queries and their oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _digits(prefix: str, expression: str, width: int = 6) -> str:
    return f"'{prefix}' || lpad(cast({expression} as string), {width}, '0')"


def _whole(a: str, b: int) -> str:
    return f"cast(floor({a} / {b}) as bigint)"


#: For each base table the FROM clause and its columns.
BASE = {
    "accounts": ("customer JOIN nation ON c_nationkey = n_nationkey", {
        "account_id": _digits("ACC", "c_custkey"),
        "account_name": f"CASE c_custkey % 4 WHEN 0 THEN ' firm ' || cast({_whole('c_custkey', 8)} as string) || ' Ltd. '"
                        f" WHEN 1 THEN 'FIRM ' || cast({_whole('c_custkey', 8)} as string) || ', Inc' ELSE 'Company ' || cast(c_custkey as string) || ' LLC' END",
        "industry": "CASE c_mktsegment WHEN 'MACHINERY' THEN 'mfg' WHEN 'HOUSEHOLD' THEN ' Retail ' WHEN 'BUILDING' THEN 'realty' WHEN 'AUTOMOBILE' THEN 'Auto' ELSE 'IT' END",
        "country": "CASE n_nationkey % 6 WHEN 0 THEN 'us' WHEN 1 THEN 'U.K.' WHEN 2 THEN 'India' WHEN 3 THEN 'de' WHEN 4 THEN 'usa' ELSE NULL END",
        "annual_revenue": "c_acctbal * 100000",
        "employee_count": "CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE cast(c_custkey % 2000 as double) END",
    }),
    "contacts": ("orders", {
        "contact_id": _digits("CON", "o_orderkey"),
        "first_name": "'fn' || cast(o_orderkey % 613 as string)",
        "last_name": "CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE 'LN-' || cast(o_orderkey % 89 as string) END",
        "email": f"CASE WHEN o_orderkey % 17 = 0 THEN 'bad@' ELSE 'User' || cast({_whole('o_orderkey', 2)} as string) || '@Example.com' END",
        "job_title": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'vp' WHEN '2' THEN 'Director ' WHEN '3' THEN 'analyst' WHEN '4' THEN 'MANAGER' ELSE 'Chief Wizard' END",
        "account_id": f"CASE WHEN o_orderkey % 97 = 0 THEN 'ACC999999' ELSE {_digits('ACC', 'o_custkey')} END",
    }),
    "leads": ("events", {
        "lead_id": f"CASE WHEN event_id % 29 = 0 THEN {_digits('LEAD', 'event_id')} ELSE {_digits('LED', 'event_id')} END",
        "lead_name": "'lead ' || cast(user_id * 1000 + event_id % 1000 as string)",
        "source": "CASE event_type WHEN 'click' THEN 'web' WHEN 'view' THEN 'LINKEDIN' WHEN 'signup' THEN 'Referral' WHEN 'purchase' THEN 'event' ELSE NULL END",
        "status": "CASE event_id % 7 WHEN 0 THEN 'new' WHEN 1 THEN 'Working' WHEN 2 THEN 'qualified' WHEN 3 THEN 'Converted' WHEN 4 THEN 'unqualified' WHEN 5 THEN 'bogus' ELSE NULL END",
        "created_date": "ts",
    }),
    "stewardship": ("customer", {
        "account_id": _digits("ACC", "c_custkey"),
        "steward": "'steward ' || cast(c_nationkey as string)",
        "dq_issue_status": "CASE c_custkey % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'Resolved' WHEN 2 THEN 'in review' WHEN 3 THEN 'escalated' ELSE NULL END",
    }),
    "golden_map": ("customer WHERE c_custkey % 10 < 2", {
        "source_record": _digits("dup", "c_custkey", 5),
        "account_id": _digits("acc", "c_custkey"),
        "golden_record_id": f"' gold' || lpad(cast({_whole('c_custkey', 10)} as string), 5, '0')",
    }),
}


#: Rows as they could come from outside, as text: each check finds some of them.
RAW = {
    "raw_accounts": ("customer", {
        "account_id": f"CASE WHEN c_custkey % 37 = 0 THEN 'ACC000001' ELSE {_digits('ACC', 'c_custkey')} END",
        "account_name": "CASE c_custkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE 'Company ' || cast(c_custkey as string) END",
        "industry": "CASE c_custkey % 5 WHEN 0 THEN 'Technology' WHEN 1 THEN NULL WHEN 2 THEN 'Gardening' ELSE 'Retail' END",
        "country": "CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Atlantis' ELSE 'India' END",
        "annual_revenue": "CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' WHEN 2 THEN '-25.5' ELSE cast(c_custkey * 1000 as string) END",
        "employee_count": "CASE c_custkey % 8 WHEN 0 THEN NULL WHEN 4 THEN NULL WHEN 1 THEN 'many' WHEN 2 THEN '-3' WHEN 3 THEN '0' ELSE cast(c_custkey % 900 + 1 as string) END",
    }),
    "raw_contacts": ("orders", {
        "contact_id": f"CASE WHEN o_orderkey % 29 = 0 THEN 'CON000001' WHEN o_orderkey % 31 = 0 THEN 'X' || cast(o_orderkey as string) ELSE {_digits('CON', 'o_orderkey')} END",
        "first_name": "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE 'Ada' END",
        "last_name": "CASE WHEN o_orderkey % 23 = 0 THEN ' ' ELSE 'Byron' END",
        "email": "CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'bad@' WHEN 2 THEN 'same@example.com' ELSE 'user' || cast(o_orderkey as string) || '@example.com' END",
        "job_title": "CASE WHEN o_orderkey % 9 = 0 OR o_orderkey % 8 = 0 THEN NULL ELSE 'VP' END",
        "account_id": f"CASE o_orderkey % 10 WHEN 0 THEN NULL WHEN 1 THEN 'acc1' WHEN 2 THEN 'ACC999999' ELSE {_digits('ACC', 'o_custkey')} END",
        "phone": "CASE o_orderkey % 14 WHEN 0 THEN 'call me' WHEN 1 THEN '12' WHEN 2 THEN NULL ELSE '5550100200' END",
    }),
    "raw_leads": ("events", {
        "lead_id": f"CASE WHEN event_id % 29 = 0 THEN {_digits('LEAD', 'event_id')} WHEN event_id % 41 = 0 THEN 'LED000001' ELSE {_digits('LED', 'event_id')} END",
        "lead_name": "CASE event_id % 12 WHEN 0 THEN NULL WHEN 1 THEN 'same lead' ELSE 'lead ' || cast(event_id as string) END",
        "source": "CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 'Billboard' ELSE 'Web' END",
        "status": "CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Paused' WHEN 2 THEN 'Converted' ELSE 'New' END",
        "created_date": "ts",
    }),
}
#: An account for each golden lead, to read leads by their account's industry.
LEAD_ACCOUNT = "'ACC' || lpad(cast(cast(right(surviving_lead_id, 4) as bigint) % 180 as string), 6, '0')"


def base_sql(table: str) -> str:
    source, columns = (BASE | RAW)[table]
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {source}"


def base_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One base table over the parquet files in ``sf_dir``."""
    source, columns = (BASE | RAW)[table]
    first, _, where = source.partition(" WHERE ")
    left, _, rest = first.partition(" JOIN ")
    df = spark.read.parquet(f"{sf_dir}/{left}.parquet")
    if rest:
        right, _, on = rest.partition(" ON ")
        a, _, b = on.partition(" = ")
        other = spark.read.parquet(f"{sf_dir}/{right}.parquet")
        df = df.join(other, df[a] == other[b])
    if where:
        df = df.where(where)
    return df.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def base_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: base_table(spark, sf_dir, t) for t in BASE}
