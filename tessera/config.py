"""Rules and thresholds of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

# Canonical names and the spellings that stand for them.
INDUSTRIES = {
    "Technology": ["tech", "it", "information technology", "software", "technology"],
    "Healthcare": ["healthcare", "health care", "pharma", "pharmaceutical"],
    "Finance": ["finance", "financial services", "banking", "fintech"],
    "Retail": ["retail", "e-commerce", "ecommerce"],
    "Manufacturing": ["manufacturing", "mfg"],
    "Education": ["education", "edtech"],
    "Media & Entertainment": ["media", "entertainment"],
    "Real Estate": ["real estate", "realty"],
    "Consulting": ["consulting", "professional services"],
    "Logistics & Supply Chain": ["logistics", "supply chain"],
    "Energy": ["energy", "oil & gas", "utilities"],
}
COUNTRIES = {
    "USA": ["us", "u.s.", "u.s.a.", "united states", "united states of america"],
    "United Kingdom": ["uk", "u.k.", "great britain", "england"],
    "India": ["in", "ind"],
    "Germany": ["de", "deu"],
    "Australia": ["au", "aus"],
    "Canada": ["ca", "can"],
    "Singapore": ["sg", "sin"],
    "UAE": ["ae", "united arab emirates"],
    "France": ["fr", "fra"],
    "Japan": ["jp", "jpn"],
    "China": ["cn", "chn"],
    "Brazil": ["br", "bra"],
}
LEAD_SOURCES = ["Web", "Referral", "Event", "LinkedIn", "Cold Call", "Partner", "Advertisement", "Other"]
LEAD_STATUSES = ["New", "Working", "Qualified", "Converted", "Unqualified", "Nurturing"]
JOB_TITLES = ["VP", "Director", "Analyst", "Manager", "Engineer", "Consultant", "Executive", "Associate", "Intern", "Other"]
ISSUE_STATUSES = ["Open", "In Review", "Resolved", "Escalated"]
OPEN_ISSUE_STATUSES = ["Open", "In Review", "Escalated"]
#: The order in which lead sources are reported.
SOURCE_ORDER = ["LinkedIn", "Referral", "Event", "Web", "Partner", "Advertisement", "Cold Call", "Other"]

# Patterns. Legal suffixes are removed in this order.
EMAIL = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\z"
LEGAL_SUFFIXES = [
    r"\bprivate limited\b", r"\bpvt\.?\s*ltd\.?\b", r"\bpvt\b", r"\bltd\.?\b", r"\blimited\b",
    r"\bllc\.?\b", r"\binc\.?\b", r"\bcorp\.?\b", r"\bplc\.?\b", r"\bco\.?\b",
]
ACCOUNT_ID, CONTACT_ID, LEAD_ID = r"^ACC\d{6}\z", r"^CON\d{6}\z", r"^LED\d{6}\z"
DUPLICATE_ID, GOLDEN_ID, PHONE = r"^DUP\d{5}\z", r"^GOLD\d{5}\z", r"^\d{7,15}\z"

# Columns that show a record's age, the first one present counts.
DATE_COLUMNS = ["last_modified_date", "last_activity_date", "created_date", "last_modified", "modified_date", "created"]
SURVIVOR_DATES = ["last_modified_date", "last_activity_date", "created_date"]

#: Columns of the five base tables; revenue and head count are numbers, all else text.
SCHEMAS = {
    "accounts": ["account_id", "account_name", "industry", "country", "annual_revenue", "employee_count"],
    "contacts": ["contact_id", "first_name", "last_name", "email", "job_title", "account_id"],
    "leads": ["lead_id", "lead_name", "source", "status"],
    "stewardship": ["account_id", "steward", "dq_issue_status"],
    "golden_map": ["source_record", "account_id", "golden_record_id"],
}
NUMBERS = ["annual_revenue", "employee_count"]
DIMENSIONS = {"completeness": 0.35, "validity": 0.25, "consistency": 0.20, "uniqueness": 0.10, "freshness": 0.10}


@dataclass(frozen=True)
class Entity:
    """How one kind of record is named through the stages."""

    table: str
    kind: str
    id_col: str
    golden_prefix: str
    business: tuple[str, ...]

    @property
    def noun(self) -> str:
        return self.table[:-1]


ENTITIES = {
    "accounts": Entity("accounts", "ACCOUNT", "account_id", "GOLD_ACC", ("account_name", "industry", "country", "annual_revenue", "employee_count")),
    "contacts": Entity("contacts", "CONTACT", "contact_id", "GOLD_CON", ("full_name", "email", "phone", "job_title")),
    "leads": Entity("leads", "LEAD", "lead_id", "GOLD_LED", ("lead_name", "source", "status")),
}


@dataclass(frozen=True)
class Settings:
    """What a run may vary."""

    as_of: date = date(2026, 6, 6)
    fresh_days: int = 730
    fuzzy: bool = True
    fuzzy_window: int = 10
    fuzzy_medium: float = 0.75
    fuzzy_high: float = 0.90
    #: "canonical": contacts of merged accounts count as orphans; "all": they do not.
    orphan_scope: str = "canonical"
    weights: dict[str, float] = field(default_factory=lambda: dict(DIMENSIONS))
