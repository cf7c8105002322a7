"""Pairs of records that stand for one entity: exact, by curated map, and fuzzy."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import ENTITIES, Settings
from tessera.functions import text
from tessera.functions.scoring import confidence
from tessera.operators.ordering import neighbour_pairs

MATCH_COLUMNS = ["source_record_id", "matched_record_id", "entity_type", "match_type", "match_field", "match_score", "confidence_level"]


def with_keys(std: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Add the columns that records are matched on."""
    empty = F.lit("")
    full = F.concat(F.coalesce("first_name", empty), F.lit(" "), F.coalesce("last_name", empty))
    return {
        "accounts": std["accounts"].withColumn("match_key_name", text.name_key(F.col("account_name"))),
        "contacts": std["contacts"].withColumns({"match_key_email": text.email_key(F.col("email")), "match_key_name": text.name_key(full)}),
        "leads": std["leads"].withColumn("match_key_name", text.name_key(F.col("lead_name"))),
    }


def _edges(pairs: DataFrame, entity: str, kind: str, field: str, score: Column, level: Column) -> DataFrame:
    return pairs.select(
        "source_record_id", "matched_record_id", F.lit(entity).alias("entity_type"), F.lit(kind).alias("match_type"),
        F.lit(field).alias("match_field"), score.alias("match_score"), level.alias("confidence_level"),
    )


def star_matches(df: DataFrame, id_col: str, key: str, entity: str, kind: str) -> DataFrame:
    """Records that share a key, each matched to the smallest id of its key.

    Minima are combined in map tasks and joined back, so a common key is no hot group.
    A repeat of the smallest id itself gives a self match, as every repeat does.
    """
    keyed = df.where(F.coalesce(F.col(key) != "", F.lit(False))).select(F.col(id_col).alias("id"), F.col(key).alias("key"))
    own = keyed.groupBy("key", "id").agg(F.count("*").alias("times"))
    heads = own.groupBy("key").agg(F.min("id").alias("head"), F.sum("times").alias("n")).where("n >= 2")
    members = own.join(heads, "key")
    others = members.withColumn("times", F.col("times") - (F.col("id") == F.col("head")).cast("long"))
    pairs = others.where("times > 0").select(F.col("id").alias("source_record_id"), F.col("head").alias("matched_record_id"), F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))))
    return _edges(pairs, entity, kind, key, F.lit(1.0), F.lit("HIGH"))


def matched_ids(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source_record_id", "matched_record_id")).alias("id")).distinct()


def fuzzy_candidates(df: DataFrame, id_col: str, key: str, already: DataFrame, settings: Settings) -> DataFrame:
    """Neighbours in key order among records not matched yet, if their lengths allow the score."""
    left = df.where(F.coalesce(F.col(key) != "", F.lit(False))).join(already, F.col(id_col) == F.col("id"), "left_anti").select(id_col, key)
    pairs = neighbour_pairs(left, key, id_col, settings.fuzzy_window)
    short, long = F.least(F.length("a_key"), F.length("b_key")), F.length("a_key") + F.length("b_key")
    return pairs.where(2.0 * short / long >= settings.fuzzy_medium)


def _similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def fuzzy_matches(df: DataFrame, id_col: str, key: str, entity: str, already: DataFrame, settings: Settings) -> DataFrame:
    """Candidates whose matching-block similarity reaches the threshold; the later key is the source."""
    ratio = F.pandas_udf(_similarity, "double")
    scored = fuzzy_candidates(df, id_col, key, already, settings).withColumn("score", ratio("a_key", "b_key")).where(F.col("score") >= settings.fuzzy_medium)
    pairs = scored.select(F.col("b_id").alias("source_record_id"), F.col("a_id").alias("matched_record_id"), "score")
    return _edges(pairs, entity, "FUZZY", key, F.round("score", 4), confidence(F.col("score"), F.lit("FUZZY"), settings.fuzzy_high, settings.fuzzy_medium))


def edit_distance_pairs(df: DataFrame, id_col: str, key: str, settings: Settings) -> DataFrame:
    """The neighbourhood join with a native edit similarity instead of matching blocks."""
    pairs = neighbour_pairs(df.where(F.col(key) != "").select(id_col, key), key, id_col, settings.fuzzy_window)
    similarity = F.round(1 - F.levenshtein("a_key", "b_key") / F.greatest(F.length("a_key"), F.length("b_key")), 4)
    return pairs.withColumn("similarity", similarity).where(F.col("similarity") >= settings.fuzzy_medium)


def golden_matches(std_golden: DataFrame) -> DataFrame:
    """Accounts that a curated map gives one golden id."""
    return star_matches(std_golden.where("account_id IS NOT NULL"), "account_id", "golden_record_id", "ACCOUNT", "GOLDEN")


def best_matches(edges: DataFrame) -> DataFrame:
    """One edge a pair: curated before exact before fuzzy, then the better score."""
    rank = F.when(F.col("match_type") == "GOLDEN", 0).when(F.col("match_type") == "EXACT", 1).otherwise(2)
    rest = [c for c in MATCH_COLUMNS if c not in ("source_record_id", "matched_record_id")]
    best = F.min_by(F.struct(*rest), F.struct(rank, -F.col("match_score"), "match_field")).alias("best")
    return edges.groupBy("source_record_id", "matched_record_id").agg(best).select("source_record_id", "matched_record_id", "best.*")


#: For each entity the key of exact matches, and whether names are matched fuzzily too.
KEYS = {"accounts": ("match_key_name", True), "contacts": ("match_key_email", True), "leads": ("match_key_name", False)}


def entity_matches(name: str, std: dict[str, DataFrame], settings: Settings) -> DataFrame:
    """All matches of one entity, one a pair."""
    keyed, entity = with_keys(std)[name], ENTITIES[name]
    key, fuzzy = KEYS[name]
    exact = star_matches(keyed, entity.id_col, key, entity.kind, "EXACT")
    parts = [exact, golden_matches(std["golden_map"])] if name == "accounts" else [exact]
    if settings.fuzzy and fuzzy:
        parts.append(fuzzy_matches(keyed, entity.id_col, "match_key_name", entity.kind, matched_ids(exact), settings))
    return best_matches(reduce(DataFrame.unionByName, parts))


def match_table(std: dict[str, DataFrame], settings: Settings) -> DataFrame:
    """All matches of all entities."""
    return reduce(DataFrame.unionByName, [entity_matches(name, std, settings) for name in KEYS])


def is_star(name: str, settings: Settings) -> bool:
    """Whether an entity's matches all lead from a record to the smallest id of its one key."""
    return name != "accounts" and not (settings.fuzzy and KEYS[name][1])


def match_summary(edges: DataFrame) -> DataFrame:
    """Counts by entity and match type with a grand total, in one pass by grouping sets."""
    level = lambda x: F.sum((F.col("confidence_level") == x).cast("long"))
    rolled = edges.groupingSets([["entity_type", "match_type"], []], "entity_type", "match_type").agg(
        F.grouping_id().alias("g"), F.count("*").alias("total_matches"), level("HIGH").alias("high_confidence"), level("MEDIUM").alias("medium_confidence"),
        level("LOW").alias("low_confidence"), F.round(F.avg("match_score"), 4).alias("avg_score"),
    )
    total = F.col("g") != 0
    return rolled.where("total_matches > 0").select(
        F.when(total, "TOTAL").otherwise(F.col("entity_type")).alias("entity_type"), F.when(total, "ALL").otherwise(F.col("match_type")).alias("match_type"),
        "total_matches", "high_confidence", "medium_confidence", "low_confidence", "avg_score",
    )
