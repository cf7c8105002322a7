"""Column expressions over text. All are native and keep nulls unless they say otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import config


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean(c: Column, default: str = "") -> Column:
    """Stripped text, ``default`` for null."""
    return F.coalesce(strip(c.cast("string")), F.lit(default))


def named(c: Column, default: str = "Unknown") -> Column:
    """Stripped text, ``default`` for null and blank."""
    text = clean(c)
    return F.when(text == "", default).otherwise(text)


def blank(c: Column) -> Column:
    return F.coalesce(strip(c.cast("string")) == "", F.lit(True))


def title_case(c: Column) -> Column:
    """A capital after every character that is no letter, all other letters small."""
    parts = F.split(F.lower(strip(c)), r"(?<=[^\p{L}])")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x)))), "")


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def canonical(c: Column, spellings: dict[str, list[str]]) -> Column:
    """The canonical name of a known spelling; any other text as it is, stripped."""
    known = {s: name for name, all_ in spellings.items() for s in all_}
    return F.coalesce(F.try_element_at(_literal_map(known), F.lower(strip(c))), strip(c))


def from_list(c: Column, allowed: list[str], default: str) -> Column:
    """The allowed value that equals the text without regard to case, else ``default``."""
    return F.coalesce(F.try_element_at(_literal_map({x.lower(): x for x in allowed}), F.lower(strip(c))), F.lit(default))


def valid_email(c: Column) -> Column:
    return matches(strip(c), config.EMAIL)


def matches(c: Column, pattern: str) -> Column:
    """True or False; False for null."""
    return F.coalesce(c.rlike(pattern), F.lit(False))


def one_of(c: Column, values: list[str]) -> Column:
    """Membership that is False, not null, for null."""
    return F.coalesce(c.isin(values), F.lit(False))


def phone_digits(c: Column) -> Column:
    """The digits of a phone number; null for fewer than seven."""
    digits = F.regexp_replace(c, r"\D", "")
    return F.when(F.length(digits) >= 7, digits)


def name_key(c: Column) -> Column:
    """Key on which names are matched: no case, legal suffixes, marks or doubled spaces; "" for null."""
    key = strip(F.lower(c))
    for suffix in config.LEGAL_SUFFIXES:
        key = F.regexp_replace(key, suffix, "")
    key = F.regexp_replace(F.regexp_replace(key, r"[^a-z0-9\s]", " "), r"\s+", " ")
    return F.coalesce(strip(key), F.lit(""))


def email_key(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)), F.lit(""))


def number(c: Column) -> Column:
    """A double; null for what is no plain decimal number and for NaN."""
    text = strip(c.cast("string"))
    value = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"), text.try_cast("double"))
    return F.nanvl(value, F.lit(None).cast("double"))


def issue_text(c: Column, kind: str) -> Column:
    """A value as an issue shows it: numbers as decimals with one digit at least."""
    if kind in ("double", "float"):
        whole = F.concat(c.cast("decimal(38,0)").cast("string"), F.lit(".0"))
        digits = c.cast("string")  # shortest digits, with an exponent beyond 10**7
        plain = F.regexp_replace(digits.try_cast("decimal(38,12)").cast("string"), "0+$", "")
        return F.coalesce(F.when(c == F.floor(c), whole).otherwise(F.coalesce(plain, digits)), F.lit(""))
    return clean(c)
