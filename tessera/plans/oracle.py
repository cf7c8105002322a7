"""SQL for the queries, written independently of the operators as one chain of common table expressions.

Each query names the expressions that it needs; :func:`oracle_sql` puts them, with
what they need in turn, before its SELECT. The base tables are the adapter's text.
"""

from __future__ import annotations

import re

from tessera import config
from tessera.plans.adapter import BASE, LEAD_ACCOUNT, RAW, base_sql
from tessera.plans.registry import AS_OF


def _values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def _in(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _title(c: str) -> str:
    """Runs of letters get a capital; the adapter's words are ASCII."""
    return f"array_to_string(list_transform(regexp_extract_all(lower(trim({c})), '[a-z]+|[^a-z]+'), lambda x: upper(x[1]) || x[2:]), '')"


def _listed(c: str, values: list[str], default: str) -> str:
    cases = " ".join(f"WHEN '{v.lower()}' THEN '{v}'" for v in values)
    return f"coalesce(CASE lower(trim({c})) {cases} END, '{default}')"


def _mapped(c: str, names: dict[str, list[str]]) -> str:
    cases = " ".join(f"WHEN '{s}' THEN '{n}'" for n, all_ in names.items() for s in all_)
    return f"coalesce(CASE lower(trim({c})) {cases} END, trim({c}))"


def _re(pattern: str) -> str:
    return pattern.replace(r"\z", "$")


def _name_key(c: str) -> str:
    out = f"lower(trim({c}))"
    for s in config.LEGAL_SUFFIXES:
        out = f"regexp_replace({out}, '{s}', '', 'g')"
    return f"coalesce(trim(regexp_replace(regexp_replace({out}, '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '')"


def _share(part: str, total: str, of_nothing: float) -> str:
    return f"CASE WHEN {total} = 0 THEN {of_nothing} ELSE round(cast({part} AS double) / cast({total} AS double) * 100, 2) END"


def _star(table: str, id_col: str, key: str, entity: str, kind: str) -> str:
    return f"""
      SELECT source_record_id, matched_record_id, '{entity}' AS entity_type, '{kind}' AS match_type, '{key}' AS match_field, 1.0::double AS match_score, 'HIGH' AS confidence_level
      FROM (SELECT {id_col} AS source_record_id, min({id_col}) OVER (PARTITION BY {key}) AS matched_record_id,
                   row_number() OVER (PARTITION BY {key} ORDER BY {id_col}) AS n
            FROM {table} WHERE {key} IS NOT NULL AND {key} <> '') WHERE n > 1"""


def _grade(c: str) -> str:
    return f"CASE WHEN {c} >= 90 THEN 'A' WHEN {c} >= 80 THEN 'B' WHEN {c} >= 70 THEN 'C' ELSE 'D' END"


CTE: dict[str, str] = {t: base_sql(t) for t in BASE | RAW}

CTE["std_accounts"] = f"""
  SELECT account_id, {_title('account_name')} AS account_name, {_mapped('industry', config.INDUSTRIES)} AS industry, {_mapped('country', config.COUNTRIES)} AS country,
         annual_revenue, employee_count,
         CASE WHEN coalesce({_mapped('industry', config.INDUSTRIES)} IN {_in(list(config.INDUSTRIES))}, false)
               AND coalesce({_mapped('country', config.COUNTRIES)} IN {_in(list(config.COUNTRIES))}, false) THEN 'OK' ELSE 'REVIEW' END AS std_flag
  FROM accounts"""
CTE["std_contacts"] = f"""
  SELECT contact_id, {_title('first_name')} AS first_name, {_title('last_name')} AS last_name, trim(email) AS email, {_listed('job_title', config.JOB_TITLES, 'Other')} AS job_title, account_id,
         trim(coalesce({_title('first_name')}, '') || ' ' || coalesce({_title('last_name')}, '')) AS full_name,
         CASE WHEN coalesce(regexp_matches(trim(email), '{_re(config.EMAIL)}'), false) THEN 'YES' ELSE 'NO' END AS email_valid
  FROM contacts"""
CTE["std_leads"] = f"""
  SELECT lead_id, {_title('lead_name')} AS lead_name, {_listed('source', config.LEAD_SOURCES, 'Other')} AS source, {_listed('status', config.LEAD_STATUSES, 'New')} AS status, created_date
  FROM leads"""
CTE["std_stewardship"] = f"""
  SELECT account_id, {_title('steward')} AS steward, {_listed('dq_issue_status', config.ISSUE_STATUSES, 'Open')} AS dq_issue_status FROM stewardship"""
CTE["std_golden_map"] = f"""
  SELECT source_record, account_id, golden_record_id,
         CASE WHEN regexp_matches(account_id, '{_re(config.ACCOUNT_ID)}') AND regexp_matches(source_record, '{_re(config.DUPLICATE_ID)}')
               AND regexp_matches(golden_record_id, '{_re(config.GOLDEN_ID)}') THEN 'VALID' ELSE 'INVALID' END AS id_format_valid
  FROM (SELECT upper(trim(source_record)) AS source_record, upper(trim(account_id)) AS account_id, upper(trim(golden_record_id)) AS golden_record_id FROM golden_map)"""
CTE["keys_accounts"] = f"SELECT *, {_name_key('account_name')} AS match_key_name FROM std_accounts"
CTE["keys_contacts"] = f"""
  SELECT *, coalesce(lower(trim(email)), '') AS match_key_email, {_name_key("(coalesce(first_name, '') || ' ' || coalesce(last_name, ''))")} AS match_key_name FROM std_contacts"""
CTE["keys_leads"] = f"SELECT *, {_name_key('lead_name')} AS match_key_name FROM std_leads"
CTE["exact_accounts"] = _star("keys_accounts", "account_id", "match_key_name", "ACCOUNT", "EXACT")
CTE["exact_contacts"] = _star("keys_contacts", "contact_id", "match_key_email", "CONTACT", "EXACT")
CTE["exact_leads"] = _star("keys_leads", "lead_id", "match_key_name", "LEAD", "EXACT")
CTE["golden_pairs"] = _star("std_golden_map", "account_id", "golden_record_id", "ACCOUNT", "GOLDEN")
CTE["matches"] = """
  SELECT * EXCLUDE (n) FROM (
    SELECT *, row_number() OVER (PARTITION BY source_record_id, matched_record_id ORDER BY CASE match_type WHEN 'GOLDEN' THEN 0 WHEN 'EXACT' THEN 1 ELSE 2 END, -match_score, match_field) AS n
    FROM (SELECT * FROM exact_accounts UNION ALL SELECT * FROM exact_contacts UNION ALL SELECT * FROM exact_leads UNION ALL SELECT * FROM golden_pairs)) WHERE n = 1"""
CTE["golden_heads"] = "SELECT DISTINCT id FROM (SELECT min(account_id) AS id FROM std_golden_map WHERE golden_record_id IS NOT NULL GROUP BY golden_record_id)"


def _clusters(name: str) -> None:
    entity = config.ENTITIES[name]
    golden = "EXISTS (SELECT 1 FROM golden_heads g WHERE g.id = l.a)" if name == "accounts" else "false"
    CTE[f"ends_{name}"] = f"""
      SELECT source_record_id AS a, matched_record_id AS b, match_type FROM matches WHERE entity_type = '{entity.kind}'
      UNION ALL SELECT matched_record_id, source_record_id, match_type FROM matches WHERE entity_type = '{entity.kind}'"""
    CTE[f"reach_{name}"] = f"SELECT a, a AS b FROM ends_{name} UNION SELECT r.a, e.b FROM reach_{name} r JOIN ends_{name} e ON r.b = e.a"
    CTE[f"label_{name}"] = f"""
      SELECT a, min(b) AS root FROM (SELECT a, b FROM reach_{name} UNION ALL SELECT {entity.id_col}, {entity.id_col} FROM std_{name} WHERE {entity.id_col} IS NOT NULL) GROUP BY a"""
    CTE[f"map_{name}"] = f"""
      SELECT l.a AS record_id, '{entity.kind}' AS entity_type, 'CLU_{entity.kind[:3]}_' || c.canonical_id AS cluster_id, c.canonical_id,
             CASE WHEN l.a = c.canonical_id THEN 'NO' ELSE 'YES' END AS is_duplicate, c.cluster_size, coalesce(t.used, 'NONE') AS match_type_used
      FROM label_{name} l
      JOIN (SELECT root, coalesce(min(CASE WHEN {golden} THEN a END), min(a)) AS canonical_id, count(*) AS cluster_size FROM label_{name} l GROUP BY root) c USING (root)
      LEFT JOIN (SELECT a, array_to_string(list_sort(list(DISTINCT match_type)), ',') AS used FROM ends_{name} GROUP BY a) t ON t.a = l.a"""
    CTE[f"dedup_{name}"] = f"""
      SELECT s.*, coalesce(d.n, 0) AS duplicate_count, coalesce(d.ids, '') AS absorbed_ids FROM std_{name} s
      LEFT JOIN (SELECT canonical_id, count(*) AS n, string_agg(record_id, ',' ORDER BY record_id) AS ids FROM map_{name} WHERE is_duplicate = 'YES' GROUP BY canonical_id) d
        ON d.canonical_id = s.{entity.id_col}
      WHERE s.{entity.id_col} IN (SELECT record_id FROM map_{name} WHERE is_duplicate = 'NO')"""


for _name in config.ENTITIES:
    _clusters(_name)

CTE["known_accounts"] = "SELECT DISTINCT account_id FROM dedup_accounts"
CTE["open_accounts"] = f"SELECT DISTINCT account_id FROM std_stewardship WHERE dq_issue_status IN {_in(config.OPEN_ISSUE_STATUSES)}"


def _number_text(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '' WHEN {c} = floor({c}) THEN cast(cast({c} AS decimal(38, 0)) AS varchar) || '.0' ELSE cast({c} AS varchar) END"


def _check(name: str, check: str, field: str, severity: str, fails: str, source: str = "") -> str:
    entity = config.ENTITIES[name]
    value = "''" if not field else _number_text(field) if field in config.NUMBERS else f"coalesce(trim({field}), '')"
    return f"""SELECT {entity.id_col} AS record_id, '{entity.kind}' AS entity_type, '{check.split('_')[0].capitalize()}' AS dimension, '{check}' AS dq_check, '{field}' AS field_name,
      {value} AS issue_value, '{severity}' AS severity FROM {source or f'dedup_{name}'} WHERE {fails}"""


def _blank(c: str) -> str:
    return f"({c} IS NULL OR trim(cast({c} AS varchar)) = '')"


def _repeated(c: str, table: str) -> str:
    return f"{c} IN (SELECT {c} FROM {table} WHERE NOT {_blank(c)} GROUP BY {c} HAVING count(*) > 1)"


_stale = f"date_sub('day', created_date, TIMESTAMP '{AS_OF.isoformat()} 00:00:00') > 730"
_required = {"accounts": ["account_name", "industry", "country", "annual_revenue", "employee_count"], "contacts": ["first_name", "last_name", "email", "job_title", "account_id"], "leads": ["lead_name", "source", "status"]}
CHECKS = {name: [_check(name, f"completeness_missing_{c}", c, "HIGH", _blank(c)) for c in columns] for name, columns in _required.items()}
CHECKS["accounts"] += [
    _check("accounts", "validity_invalid_industry", "industry", "MEDIUM", f"NOT coalesce(industry IN {_in(list(config.INDUSTRIES))}, false)"),
    _check("accounts", "validity_invalid_country", "country", "MEDIUM", f"NOT coalesce(country IN {_in(list(config.COUNTRIES))}, false)"),
    _check("accounts", "validity_negative_annual_revenue", "annual_revenue", "HIGH", "annual_revenue < 0"),
    _check("accounts", "validity_negative_employee_count", "employee_count", "HIGH", "employee_count < 0"),
    _check("accounts", "consistency_revenue_without_employees", "employee_count", "LOW", "annual_revenue > 0 AND employee_count = 0"),
    _check("accounts", "uniqueness_duplicate_account_id", "account_id", "HIGH", _repeated("account_id", "dedup_accounts")),
    _check("accounts", "uniqueness_open_stewardship_issue", "account_id", "MEDIUM", "account_id IN (SELECT account_id FROM open_accounts)"),
    _check("accounts", "freshness_stale_account", "", "LOW", f"{_blank('annual_revenue')} AND {_blank('employee_count')}"),
]
CHECKS["contacts"] += [
    _check("contacts", "validity_invalid_email", "email", "HIGH", "email_valid = 'NO'"),
    _check("contacts", "validity_invalid_account_id_format", "account_id", "MEDIUM", f"account_id IS NOT NULL AND NOT regexp_matches(account_id, '{_re(config.ACCOUNT_ID)}')"),
    _check("contacts", "validity_invalid_contact_id_format", "contact_id", "MEDIUM", f"NOT regexp_matches(contact_id, '{_re(config.CONTACT_ID)}')"),
    _check("contacts", "consistency_orphan_contact_account_id", "account_id", "HIGH", "account_id IS NOT NULL AND account_id NOT IN (SELECT account_id FROM known_accounts)"),
    _check("contacts", "uniqueness_duplicate_contact_id", "contact_id", "HIGH", _repeated("contact_id", "dedup_contacts")),
    _check("contacts", "uniqueness_duplicate_email", "email", "HIGH", _repeated("email", "dedup_contacts")),
    _check("contacts", "freshness_stale_contact", "", "LOW", f"{_blank('email')} AND {_blank('job_title')}"),
]
CHECKS["leads"] += [
    _check("leads", "validity_invalid_lead_status", "status", "MEDIUM", f"status NOT IN {_in(config.LEAD_STATUSES)}"),
    _check("leads", "validity_invalid_lead_source", "source", "MEDIUM", f"source NOT IN {_in(config.LEAD_SOURCES)}"),
    _check("leads", "validity_invalid_lead_id_format", "lead_id", "MEDIUM", f"NOT regexp_matches(lead_id, '{_re(config.LEAD_ID)}')"),
    _check("leads", "consistency_converted_lead_missing_source", "source", "MEDIUM", f"status = 'Converted' AND {_blank('source')}"),
    _check("leads", "uniqueness_duplicate_lead_id", "lead_id", "HIGH", _repeated("lead_id", "dedup_leads")),
    _check("leads", "uniqueness_duplicate_lead_name_source", "lead_name", "MEDIUM", "(lead_name, source) IN (SELECT (lead_name, source) FROM dedup_leads GROUP BY lead_name, source HAVING count(*) > 1)"),
    _check("leads", "freshness_stale_lead", "", "LOW", _stale),
]
for _name, _checks in CHECKS.items():
    CTE[f"issues_{_name}"] = "\n UNION ALL ".join(_checks)
CTE["issues"] = "SELECT * FROM issues_accounts UNION ALL SELECT * FROM issues_contacts UNION ALL SELECT * FROM issues_leads"


def _one_of(c: str, values: list[str]) -> str:
    return f"coalesce({c} IN {_in(values)}, false)"


def _fits(c: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({c}, '{_re(pattern)}'), false)"


_revenue, _staff = "try_cast(annual_revenue AS double)", "try_cast(employee_count AS double)"
RAW_CHECKS = {name: [(f"completeness_missing_{c}", "HIGH", _blank(c)) for c in columns] for name, columns in _required.items()}
RAW_CHECKS["accounts"] += [
    ("validity_invalid_industry", "MEDIUM", "NOT " + _one_of("industry", list(config.INDUSTRIES))), ("validity_invalid_country", "MEDIUM", "NOT " + _one_of("country", list(config.COUNTRIES))),
    ("validity_non_numeric_annual_revenue", "MEDIUM", f"annual_revenue IS NOT NULL AND {_revenue} IS NULL"), ("validity_non_numeric_employee_count", "MEDIUM", f"employee_count IS NOT NULL AND {_staff} IS NULL"),
    ("validity_negative_annual_revenue", "HIGH", f"{_revenue} < 0"), ("validity_negative_employee_count", "HIGH", f"{_staff} < 0"),
    ("consistency_revenue_without_employees", "LOW", f"{_revenue} > 0 AND {_staff} = 0"), ("uniqueness_duplicate_account_id", "HIGH", _repeated("account_id", "raw_accounts")),
    ("uniqueness_open_stewardship_issue", "MEDIUM", "account_id IN (SELECT account_id FROM open_accounts)"), ("freshness_stale_account", "LOW", f"{_blank('annual_revenue')} AND {_blank('employee_count')}"),
]
RAW_CHECKS["contacts"] += [
    ("validity_invalid_email", "HIGH", "NOT " + _fits("trim(email)", config.EMAIL)), ("validity_invalid_account_id_format", "MEDIUM", "account_id IS NOT NULL AND NOT " + _fits("account_id", config.ACCOUNT_ID)),
    ("validity_invalid_contact_id_format", "MEDIUM", "NOT " + _fits("contact_id", config.CONTACT_ID)), ("validity_invalid_phone", "LOW", f"NOT {_blank('phone')} AND NOT " + _fits("trim(phone)", config.PHONE)),
    ("consistency_orphan_contact_account_id", "HIGH", "account_id IS NOT NULL AND account_id NOT IN (SELECT account_id FROM raw_accounts)"),
    ("uniqueness_duplicate_contact_id", "HIGH", _repeated("contact_id", "raw_contacts")), ("uniqueness_duplicate_email", "HIGH", _repeated("email", "raw_contacts")),
    ("freshness_stale_contact", "LOW", f"{_blank('email')} AND {_blank('job_title')}"),
]
RAW_CHECKS["leads"] += [
    ("validity_invalid_lead_status", "MEDIUM", "NOT " + _one_of("status", config.LEAD_STATUSES)), ("validity_invalid_lead_source", "MEDIUM", "NOT " + _one_of("source", config.LEAD_SOURCES)),
    ("validity_invalid_lead_id_format", "MEDIUM", "NOT " + _fits("lead_id", config.LEAD_ID)), ("consistency_converted_lead_missing_source", "MEDIUM", f"coalesce(status = 'Converted', false) AND {_blank('source')}"),
    ("uniqueness_duplicate_lead_id", "HIGH", _repeated("lead_id", "raw_leads")),
    ("uniqueness_duplicate_lead_name_source", "MEDIUM", "lead_name IS NOT NULL AND (lead_name, coalesce(source, '')) IN (SELECT (lead_name, coalesce(source, '')) FROM raw_leads GROUP BY lead_name, coalesce(source, '') HAVING count(*) > 1)"),
    ("freshness_stale_lead", "LOW", _stale),
]
CTE["raw_issues"] = "\n UNION ALL ".join(
    f"SELECT '{check.split('_')[0].capitalize()}' AS dimension, '{config.ENTITIES[name].kind}' AS entity_type, '{check}' AS dq_check, '{severity}' AS severity FROM raw_{name} WHERE {fails}"
    for name, checks in RAW_CHECKS.items() for check, severity, fails in checks
)
CTE["weights"] = "SELECT * FROM (" + _values([(d.capitalize(), w) for d, w in config.DIMENSIONS.items()]) + ") AS w(dimension, weight)"
CTE["sizes"] = " UNION ALL ".join(f"SELECT '{n.upper()}' AS entity, '{e.kind}' AS entity_type, count(*) AS total FROM dedup_{n}" for n, e in config.ENTITIES.items())
CTE["entity_scores"] = f"""
  SELECT s.entity, w.dimension, {_share('(s.total - coalesce(f.n, 0))', 's.total', 100.0)} AS score, cast(w.weight AS double) AS weight, s.total
  FROM sizes s CROSS JOIN weights w
  LEFT JOIN (SELECT entity_type, dimension, count(DISTINCT record_id) AS n FROM issues GROUP BY ALL) f ON f.entity_type = s.entity_type AND f.dimension = w.dimension"""
CTE["overall_scores"] = "SELECT dimension, weight, round(sum(score * total) / sum(total), 2) AS score FROM entity_scores GROUP BY dimension, weight"
CTE["scores"] = """
  SELECT entity, dimension, score, weight FROM entity_scores
  UNION ALL SELECT 'OVERALL', dimension, score, weight FROM overall_scores
  UNION ALL SELECT 'CRM HEALTH SCORE', 'Weighted Average', round(sum(score * weight), 2), 1.0 FROM overall_scores"""


def _quality_and_golden(name: str) -> None:
    entity = config.ENTITIES[name]
    id_col = entity.id_col
    score = {d: f"CASE WHEN coalesce(max(CASE WHEN i.dimension = '{d.capitalize()}' THEN 1 END), 0) = 1 THEN 0.0::double ELSE 100.0::double END" for d in config.DIMENSIONS}
    total = " + ".join(f"{d}_score * {w}::double" for d, w in config.DIMENSIONS.items())
    CTE[f"dimension_scores_{name}"] = f"""
      SELECT m.{id_col}, {', '.join(f'{c} AS {d}_score' for d, c in score.items())}, count(i.dq_check) AS issue_count, count(CASE WHEN i.severity = 'HIGH' THEN 1 END) AS high_severity_issues
      FROM dedup_{name} m LEFT JOIN issues_{name} i ON i.record_id = m.{id_col} GROUP BY m.{id_col}"""
    CTE[f"quality_{name}"] = f"""
      SELECT {id_col}, '{entity.kind}' AS entity_type, {', '.join(f'{d}_score' for d in config.DIMENSIONS)}, record_quality_score, {_grade('record_quality_score')} AS quality_grade,
             issue_count, high_severity_issues, CASE WHEN record_quality_score >= 80 AND high_severity_issues = 0 THEN 'YES' ELSE 'NO' END AS golden_record_eligible
      FROM (SELECT *, round({total}, 2) AS record_quality_score FROM dimension_scores_{name})"""
    lookup = "SELECT account_id AS record_id, max_by(golden_record_id, source_record) AS golden_id FROM std_golden_map GROUP BY account_id" if name == "accounts" else "SELECT '' AS record_id, '' AS golden_id WHERE false"
    CTE[f"curated_{name}"] = lookup
    CTE[f"groups_{name}"] = f"""
      SELECT canonical_id, string_agg(record_id, ',' ORDER BY record_id) AS source_ids, count(*) AS merged, row_number() OVER (ORDER BY canonical_id) AS n
      FROM (SELECT DISTINCT canonical_id, record_id FROM map_{name}) GROUP BY canonical_id"""
    CTE[f"chosen_{name}"] = f"""
      SELECT g.canonical_id, coalesce(min(CASE WHEN c.golden_id IS NOT NULL THEN p.record_id END), any_value(g.canonical_id)) AS survivor_id,
             min_by(c.golden_id, p.record_id) FILTER (c.golden_id IS NOT NULL) AS golden_id
      FROM groups_{name} g LEFT JOIN (SELECT m.canonical_id, m.record_id FROM map_{name} m JOIN dedup_{name} d ON d.{id_col} = m.record_id) p USING (canonical_id)
      LEFT JOIN curated_{name} c ON c.record_id = p.record_id GROUP BY g.canonical_id"""
    value = lambda c: f"coalesce(d.{c}, '') AS {c}" if c not in ("phone", *config.NUMBERS) else f"d.{c}" if c in config.NUMBERS else "'' AS phone"
    CTE[f"golden_{name}"] = f"""
      SELECT coalesce(c.golden_id, '{entity.golden_prefix}_' || CASE WHEN g.n < 1000000 THEN lpad(cast(g.n AS varchar), 6, '0') ELSE cast(g.n AS varchar) END) AS golden_{id_col}, c.survivor_id AS surviving_{id_col},
             g.source_ids AS source_{id_col}s, {', '.join(value(x) for x in entity.business)}, coalesce(q.record_quality_score, 0.0) AS record_quality_score, coalesce(q.quality_grade, 'D') AS quality_grade,
             CASE WHEN c.golden_id IS NOT NULL THEN 'Golden Record Map' ELSE 'Highest record_quality_score' END AS survivorship_reason, g.merged AS records_merged_count
      FROM groups_{name} g JOIN chosen_{name} c USING (canonical_id) LEFT JOIN dedup_{name} d ON d.{id_col} = c.survivor_id LEFT JOIN quality_{name} q ON q.{id_col} = c.survivor_id"""


for _name in config.ENTITIES:
    _quality_and_golden(_name)

CTE["all_quality"] = " UNION ALL ".join(f"SELECT record_quality_score AS score FROM quality_{n}" for n in config.ENTITIES)
CTE["coverage_parts"] = " UNION ALL ".join(f"SELECT '{n.capitalize()}' AS entity_type, (SELECT count(DISTINCT record_id) FROM map_{n}) AS total_records, count(*) AS golden_records FROM golden_{n}" for n in config.ENTITIES)
CTE["coverage"] = f"""
  SELECT entity_type, total_records, golden_records, {_share('golden_records', 'total_records', 0.0)} AS coverage_pct
  FROM (SELECT * FROM coverage_parts UNION ALL SELECT 'Overall', sum(total_records)::bigint, sum(golden_records)::bigint FROM coverage_parts)"""
CTE["band_names"] = "SELECT * FROM (" + _values([("Excellent",), ("Good",), ("Fair",), ("Poor",)]) + ") AS b(quality_band)"
_band = "CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good' WHEN score >= 60 THEN 'Fair' ELSE 'Poor' END"


def _spread(table: str, column: str, label: str, count: str) -> str:
    value = f"CASE WHEN coalesce(trim({column}), '') = '' THEN 'Unknown' ELSE trim({column}) END"
    return f"SELECT {label}, {count}, {_share(count, f'sum({count}) OVER ()', 0.0)} AS percentage FROM (SELECT {value} AS {label}, count(*) AS {count} FROM {table} GROUP BY 1)"


def _bucketed(bucket: str, label: str, names: list[str]) -> str:
    spine = "SELECT * FROM (" + _values([(n,) for n in names]) + f") AS s({label})"
    return f"""SELECT {label}, coalesce(n, 0) AS account_count, {_share('coalesce(n, 0)', '(SELECT count(*) FROM golden_accounts)', 0.0)} AS percentage
      FROM ({spine}) LEFT JOIN (SELECT {bucket} AS {label}, count(*) AS n FROM golden_accounts GROUP BY 1) USING ({label}) WHERE {label} <> 'Unknown' OR n > 0"""


CTE["lead_funnel"] = f"""
  SELECT s.status, coalesce(n, 0) AS lead_count, {_share('coalesce(n, 0)', '(SELECT count(*) FROM golden_leads)', 0.0)} AS percentage, cast(place AS integer) AS funnel_order
  FROM (SELECT * FROM ({_values([(s, i) for i, s in enumerate(config.LEAD_STATUSES, 1)])}) AS s(status, place)) s LEFT JOIN (SELECT status, count(*) AS n FROM golden_leads GROUP BY 1) USING (status)"""
CTE["lead_source_performance"] = f"""
  SELECT source, lead_count, qualified_leads, converted_leads, {_share('converted_leads', 'lead_count', 0.0)} AS conversion_rate
  FROM (SELECT source, count(*) AS lead_count, count(*) FILTER (status = 'Qualified') AS qualified_leads, count(*) FILTER (status = 'Converted') AS converted_leads FROM golden_leads GROUP BY source)"""
CTE["industry_distribution"] = _spread("golden_accounts", "industry", "industry", "account_count")
CTE["country_distribution"] = _spread("golden_accounts", "country", "country", "account_count")
CTE["job_title_distribution"] = _spread("golden_contacts", "job_title", "job_title", "contact_count")
CTE["account_size_distribution"] = _bucketed("CASE WHEN employee_count IS NULL OR employee_count <= 0 THEN 'Unknown' WHEN employee_count <= 100 THEN 'Small' WHEN employee_count <= 1000 THEN 'Medium' ELSE 'Large' END", "account_size", ["Small", "Medium", "Large", "Unknown"])
CTE["revenue_distribution"] = _bucketed("CASE WHEN annual_revenue IS NULL OR annual_revenue < 0 THEN 'Unknown' WHEN annual_revenue < 1e6 THEN '< 1M' WHEN annual_revenue < 1e7 THEN '1M - 10M' WHEN annual_revenue < 1e8 THEN '10M - 100M' ELSE '100M+' END", "revenue_bucket", ["< 1M", "1M - 10M", "10M - 100M", "100M+", "Unknown"])
CTE["leads_by_industry"] = "SELECT 'Unknown' AS industry, count(*) AS lead_count, 100.0::double AS percentage FROM golden_leads HAVING count(*) > 0"
CTE["account_ids"] = """
  SELECT id, max_by(industry, golden_account_id) AS industry FROM (
    SELECT golden_account_id, CASE WHEN trim(industry) = '' THEN 'Unknown' ELSE trim(industry) END AS industry,
           unnest(list_concat([golden_account_id, surviving_account_id], string_split(source_account_ids, ','))) AS id FROM golden_accounts) GROUP BY id"""
CTE["placed_leads"] = f"SELECT a.industry FROM (SELECT *, {LEAD_ACCOUNT} AS account_id FROM golden_leads) l LEFT JOIN account_ids a ON a.id = l.account_id"
CTE["summary_rows"] = f"""
  SELECT 'Total Accounts' AS metric_name, cast(count(*) AS varchar) AS metric_value FROM golden_accounts
  UNION ALL SELECT 'Total Contacts', cast(count(*) AS varchar) FROM golden_contacts
  UNION ALL SELECT 'Total Leads', cast(count(*) AS varchar) FROM golden_leads
  UNION ALL SELECT 'Converted Leads', cast(count(*) FILTER (status = 'Converted') AS varchar) FROM golden_leads
  UNION ALL SELECT 'Conversion Rate', cast({_share("count(*) FILTER (status = 'Converted')", 'count(*)', 0.0)} AS varchar) FROM golden_leads
  UNION ALL (SELECT 'Top Lead Source', source FROM lead_source_performance ORDER BY converted_leads DESC, lead_count DESC, source LIMIT 1)
  UNION ALL (SELECT 'Top Industry', industry FROM industry_distribution ORDER BY account_count DESC, industry LIMIT 1)
  UNION ALL (SELECT 'Top Country', country FROM country_distribution ORDER BY account_count DESC, country LIMIT 1)"""


def _melt() -> str:
    from tessera.operators.analytics import MELTED

    parts = ["SELECT 'Executive Summary' AS metric_category, metric_name, metric_value, 'Overall' AS dimension, 'Overall' AS dimension_value FROM summary_rows"]
    for table, category, label, dimension, columns in MELTED:
        parts += [f"SELECT '{category}', '{c.replace('_', ' ').title()}', cast({c} AS varchar), '{dimension}', {label} FROM {table}" for c in columns]
    return f"SELECT *, '{AS_OF.isoformat()}' AS reporting_date FROM (" + " UNION ALL ".join(parts) + ")"


def _governance() -> str:
    row = lambda name, value, category, table: f"SELECT {name} AS metric_name, cast({value} AS double) AS metric_value, '{category}' AS metric_category FROM {table}"
    before = " + ".join(f"(SELECT count(DISTINCT record_id) FROM map_{n})" for n in config.ENTITIES)
    after = " + ".join(f"(SELECT count(DISTINCT canonical_id) FROM map_{n})" for n in config.ENTITIES)
    parts = [
        row("'CRM Health Score'", "score", "Overall", "scores WHERE entity = 'CRM HEALTH SCORE'"),
        row("'Data ' || dimension || ' %'", "round(avg(score), 2)", "Data Quality", "entity_scores GROUP BY dimension"),
        row("'Golden Record Coverage % - ' || entity_type", "coverage_pct", "Golden Records", "coverage"),
        row("'Duplicate Rate'", _share(f"(({before}) - ({after}))", f"({before})", 0.0), "Deduplication", "(SELECT 1)"),
        row("'Records Under Stewardship'", "count(*)", "Governance Issues", f"std_stewardship WHERE dq_issue_status IN {_in(config.OPEN_ISSUE_STATUSES)}"),
        row("'Records Requiring Review'", "count(*)", "Governance Issues", "all_quality WHERE score < 75"),
        row("'Excellent Records'", "count(*)", "Data Quality", "all_quality WHERE score >= 90"),
        row("'Poor Quality Records'", "count(*)", "Governance Issues", "all_quality WHERE score < 60"),
    ]
    return f"SELECT *, '{AS_OF.isoformat()}' AS reporting_date FROM (" + " UNION ALL ".join(parts) + ")"


def _changes() -> str:
    from tessera.operators.standardize import COUNTERS

    def differs(c: str) -> str:
        return f"(coalesce(cast(a.{c} AS varchar), '') <> coalesce(cast(b.{c} AS varchar), ''))::int"

    keys = {"accounts": "account_id", "contacts": "contact_id", "leads": "lead_id", "stewardship": "account_id", "golden_map": "source_record"}
    parts = []
    for table, (columns, flags) in COUNTERS.items():
        own = f"(SELECT {', '.join(f'trim({c}) AS {c}' if c in config.SCHEMAS[table] and c not in config.NUMBERS else c for c in BASE[table][1])} FROM {table})"
        for counter, names in columns.items():
            parts.append(f"SELECT 'std_{table}' AS table_name, '{counter}' AS counter, cast(sum({' + '.join(map(differs, names))}) AS bigint) AS changes, count(*) AS total_rows FROM {own} a JOIN std_{table} b USING ({keys[table]})")
        for counter, (column, value) in flags.items():
            parts.append(f"SELECT 'std_{table}', '{counter}', count(*) FILTER ({column} = '{value}'), count(*) FROM std_{table}")
    return " UNION ALL ".join(parts)


def _nulls() -> str:
    parts = []
    for table, (_, columns) in BASE.items():
        nulls = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in columns)
        parts.append(f"SELECT '{table}' AS table_name, count(*) AS total_rows, {len(columns)}::bigint AS total_columns, {nulls} AS null_values FROM {table}")
    return " UNION ALL ".join(parts)


_neighbours = """
  SELECT a.match_key_name AS a_key, a.account_id AS a_id, b.match_key_name AS b_key, b.account_id AS b_id
  FROM {t} a JOIN {t} b ON b.rn > a.rn AND b.rn <= a.rn + 10"""
CTE["unmatched_accounts"] = """
  SELECT account_id, match_key_name, row_number() OVER (ORDER BY match_key_name, account_id) AS rn FROM keys_accounts
  WHERE match_key_name <> '' AND account_id NOT IN (SELECT source_record_id FROM exact_accounts UNION SELECT matched_record_id FROM exact_accounts)"""
CTE["ordered_accounts"] = "SELECT account_id, match_key_name, row_number() OVER (ORDER BY match_key_name, account_id) AS rn FROM keys_accounts WHERE match_key_name <> ''"
CTE["lines"] = """
  SELECT DISTINCT ON (record_id) * FROM (SELECT 'C' || cast(l_orderkey AS varchar) AS canonical_id, 'R' || lpad(cast(l_orderkey AS varchar), 9, '0') || '-' || cast(l_linenumber AS varchar) AS record_id,
    floor(l_quantity / 25) * 10.0 + 70 AS q, CASE WHEN l_tax < 0.04 THEN 0.0 ELSE 100.0 END AS c, cast(floor(l_discount * 50) AS bigint) AS i, date_trunc('month', l_shipdate) AS d FROM lineitem)"""
CTE["ranked_lines"] = """
  SELECT canonical_id, list(struct_pack(r := record_id, q := q, c := c, i := i, d := d) ORDER BY q DESC, c DESC, i, d DESC, record_id)[1:2] AS two FROM lines GROUP BY canonical_id"""

SELECTS: dict[str, str] = {f"std_{t}": f"SELECT * FROM std_{t}" for t in BASE}
SELECTS |= {
    "std_change_summary": _changes(), "ingest_null_profile": _nulls(),
    "schema_validation_summary": "SELECT table_name, n::bigint AS expected_columns, n::bigint AS present_columns, 0::bigint AS missing_columns, 'PASS' AS status FROM (" + _values([(t, len(c)) for t, c in config.SCHEMAS.items()]) + ") AS s(table_name, n)",
    "match_keys_accounts": "SELECT account_id, match_key_name FROM keys_accounts", "match_keys_contacts": "SELECT contact_id, match_key_email, match_key_name FROM keys_contacts",
    "exact_matches_accounts": "SELECT * FROM exact_accounts", "exact_matches_contacts": "SELECT * FROM exact_contacts", "exact_matches_leads": "SELECT * FROM exact_leads", "golden_matches": "SELECT * FROM golden_pairs",
    "fuzzy_candidate_pairs": "SELECT * FROM (" + _neighbours.format(t="unmatched_accounts") + ") WHERE 2.0 * least(length(a_key), length(b_key)) / (length(a_key) + length(b_key)) >= 0.75",
    "fuzzy_levenshtein_pairs": "SELECT * FROM (SELECT *, round(1 - levenshtein(a_key, b_key) / greatest(length(a_key), length(b_key)), 4) AS similarity FROM (" + _neighbours.format(t="ordered_accounts") + ")) WHERE similarity >= 0.75",
    "match_table": "SELECT * FROM matches",
    "match_summary": "SELECT coalesce(entity_type, 'TOTAL') AS entity_type, coalesce(match_type, 'ALL') AS match_type, count(*) AS total_matches, count(*) FILTER (confidence_level = 'HIGH') AS high_confidence, count(*) FILTER (confidence_level = 'MEDIUM') AS medium_confidence, count(*) FILTER (confidence_level = 'LOW') AS low_confidence, round(avg(match_score), 4) AS avg_score FROM matches GROUP BY GROUPING SETS ((entity_type, match_type), ())",
    "dedup_kpis": f"SELECT coalesce(entity_type, 'TOTAL') AS entity_type, sum(a)::bigint AS total_records, sum(b)::bigint AS canonical_records, sum(a - b)::bigint AS duplicate_count, {_share('sum(a - b)', 'sum(a)', 0.0)} AS duplicate_rate FROM (" + " UNION ALL ".join(f"SELECT '{e.kind}' AS entity_type, (SELECT count(*) FROM std_{n}) AS a, (SELECT count(*) FROM dedup_{n}) AS b" for n, e in config.ENTITIES.items()) + ") GROUP BY GROUPING SETS ((entity_type), ())",
    "dq_scores": "SELECT * FROM scores", "crm_health": "SELECT score FROM scores WHERE entity = 'CRM HEALTH SCORE'",
    "dq_raw_check_summary": "SELECT dimension, entity_type, dq_check, severity, count(*) AS issue_count FROM raw_issues GROUP BY ALL",
    "leads_by_account_industry": _spread("placed_leads", "industry", "industry", "lead_count"),
    "schema_validation_details": "SELECT * FROM (" + _values([(t, c, k := "double" if c in config.NUMBERS else "string", k, "YES", "OK") for t, columns in config.SCHEMAS.items() for c in columns])
        + ", ('leads', 'created_date', NULL, 'timestamp_ntz', 'YES', 'EXTRA')) AS d(table_name, column_name, expected_type, actual_type, present, status)",
    "dq_check_summary": "SELECT dimension, entity_type, dq_check, severity, count(*) AS issue_count FROM issues GROUP BY ALL",
    "dq_issues_all_known_accounts": "SELECT * FROM issues_contacts WHERE dq_check = 'consistency_orphan_contact_account_id' AND record_id IN (SELECT contact_id FROM dedup_contacts WHERE account_id NOT IN (SELECT record_id FROM map_accounts))",
    "survivorship_tiers": """SELECT canonical_id, two[1].r AS survivor_id, CASE WHEN len(two) = 1 OR two[1].q <> two[2].q THEN 'Highest record_quality_score' WHEN two[1].c <> two[2].c THEN 'Highest completeness_score'
        WHEN two[1].i <> two[2].i THEN 'Fewest DQ issues' WHEN two[1].d <> two[2].d THEN 'Most recent record' ELSE 'Lowest ID' END AS reason FROM ranked_lines""",
    "golden_coverage": "SELECT * FROM coverage", "governance_metrics": _governance(),
    "quality_bands": f"SELECT quality_band, coalesce(n, 0) AS record_count, {_share('coalesce(n, 0)', '(SELECT count(*) FROM all_quality)', 0.0)} AS percentage FROM band_names LEFT JOIN (SELECT {_band} AS quality_band, count(*) AS n FROM all_quality GROUP BY 1) USING (quality_band)",
    "executive_summary": "SELECT * FROM summary_rows", "business_analytics_dataset": _melt(),
    "segmentation": "SELECT 'Account Size' AS segment_type, account_size AS segment, account_count AS record_count, percentage FROM account_size_distribution UNION ALL SELECT 'Revenue', revenue_bucket, account_count, percentage FROM revenue_distribution UNION ALL SELECT 'Job Title', job_title, contact_count, percentage FROM job_title_distribution",
    "golden_summary": "SELECT 'Total ' || entity_type AS kpi, cast(total_records AS varchar) AS value FROM coverage_parts UNION ALL SELECT 'Golden ' || entity_type, cast(golden_records AS varchar) FROM coverage_parts"
        " UNION ALL SELECT 'Records Merged', cast(cast(sum(total_records) - sum(golden_records) AS bigint) AS varchar) FROM coverage_parts"
        f" UNION ALL SELECT 'Merge Rate', printf('%.2f%%', {_share('(sum(total_records) - sum(golden_records))', 'sum(total_records)', 0.0)}) FROM coverage_parts"
        " UNION ALL SELECT 'Average Quality Score', printf('%.2f%%', round(avg(record_quality_score), 2)) FROM (" + " UNION ALL ".join(f"SELECT record_quality_score FROM golden_{n}" for n in config.ENTITIES) + ")",
    "exact_documents": "SELECT doc_id AS source_record_id, head AS matched_record_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS head FROM documents) WHERE doc_id <> head",
    "unlabelled_documents": "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "page_formats": "SELECT count(*) AS total_rows, count(*) FILTER (url IS NULL OR trim(url) = '') AS blank_urls, count(*) FILTER (url LIKE 'https://%') AS secure_urls, count(*) FILTER (contains(url, '?')) AS query_urls FROM pages",
    "conversation_roles": "SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, count(*) FILTER (text IS NULL OR trim(text) = '') AS blank_turns FROM conversations GROUP BY role",
}
for _name in config.ENTITIES:
    SELECTS |= {f"cluster_map_{_name}": f"SELECT * FROM map_{_name}", f"dedup_{_name}": f"SELECT * FROM dedup_{_name}", f"record_quality_{_name}": f"SELECT * FROM quality_{_name}", f"golden_{_name}": f"SELECT * FROM golden_{_name}"}
for _d in config.DIMENSIONS:
    SELECTS[f"dq_issues_{_d}"] = f"SELECT * FROM issues WHERE dimension = '{_d.capitalize()}'"
for _name in ("lead_funnel", "lead_source_performance", "industry_distribution", "country_distribution", "account_size_distribution", "revenue_distribution", "job_title_distribution", "leads_by_industry"):
    SELECTS[_name] = f"SELECT * FROM {_name}"


def _needs(sql: str) -> list[str]:
    return [w for w in dict.fromkeys(re.findall(r"[a-z_]+", sql)) if w in CTE]


def _text(select: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for other in _needs(CTE[name]):
                if other != name:
                    add(other)
            if name not in order:
                order.append(name)

    for name in _needs(select):
        add(name)
    if not order:
        return select
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({CTE[name]})" for name in order) + "\n" + select


def oracle_sql() -> dict[str, str]:
    """SQL for every query that SQL can express."""
    return {name: _text(select) for name, select in SELECTS.items()}
