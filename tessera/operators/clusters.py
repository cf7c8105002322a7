"""Clusters of matched records, their canonical members, and deduplicated tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import Entity
from tessera.functions.scoring import share
from tessera.operators.components import connected_components


def golden_ids(std_golden: DataFrame) -> DataFrame:
    """The smallest account of each golden id, single ones too."""
    heads = std_golden.where("golden_record_id IS NOT NULL").groupBy("golden_record_id").agg(F.min("account_id").alias("id"))
    return heads.select("id").where("id IS NOT NULL").distinct()


def _stars(edges: DataFrame) -> DataFrame:
    """``node, component`` of edges that all lead to the smallest id of their component."""
    own = edges.where("source_record_id <> matched_record_id")
    return own.select(F.col("source_record_id").alias("node"), F.col("matched_record_id").alias("component")).unionByName(
        own.select(F.col("matched_record_id").alias("node"), F.col("matched_record_id").alias("component"))
    ).distinct()


def _settled(labels: DataFrame) -> bool:
    """Whether every node has one component: a repeated id that comes with several keys joins their stars."""
    return labels.groupBy("node").count().where("count > 1").isEmpty()


def cluster_map(edges: DataFrame, entity: Entity, master: DataFrame, golden: DataFrame | None = None, stars: bool = False) -> DataFrame:
    """One row per record that is in the master or in an edge; ``stars`` says that all edges lead to the smallest id of their one key.

    The canonical member is the smallest golden id of the cluster, else its smallest
    id. Repeated ids of the master have one row. Stars that share an id are one cluster, so they go through the components loop.
    """
    own = edges.where(F.col("entity_type") == entity.kind)
    ends = own.select(F.explode(F.array("source_record_id", "matched_record_id")).alias("record_id"), "match_type")
    types = ends.groupBy("record_id").agg(F.array_join(F.array_sort(F.collect_set("match_type")), ",").alias("match_type_used"))  # three types at most
    labels = _stars(own) if stars else None
    if labels is None or not _settled(labels):
        labels = connected_components(own, "source_record_id", "matched_record_id")
    ids = master.select(F.col(entity.id_col).cast("string").alias("record_id")).union(types.select("record_id")).where("record_id IS NOT NULL").distinct()
    members = ids.join(labels, F.col("record_id") == F.col("node"), "left").select("record_id", F.coalesce("component", "record_id").alias("root"))
    if golden is not None:
        members = members.join(golden.withColumn("is_golden", F.lit(True)), F.col("record_id") == F.col("id"), "left").drop("id")
    else:
        members = members.withColumn("is_golden", F.lit(None).cast("boolean"))
    elected = members.groupBy("root").agg(F.coalesce(F.min(F.when(F.col("is_golden"), F.col("record_id"))), F.min("record_id")).alias("canonical_id"), F.count("*").alias("cluster_size"))
    return members.join(elected, "root").join(types, "record_id", "left").select(
        "record_id", F.lit(entity.kind).alias("entity_type"), F.concat(F.lit(f"CLU_{entity.kind[:3]}_"), "canonical_id").alias("cluster_id"), "canonical_id",
        F.when(F.col("record_id") == F.col("canonical_id"), "NO").otherwise("YES").alias("is_duplicate"), "cluster_size",
        F.coalesce("match_type_used", F.lit("NONE")).alias("match_type_used"),
    )


def dedup_table(master: DataFrame, entity: Entity, clusters: DataFrame) -> DataFrame:
    """Canonical rows of the master with what they absorbed.

    A cluster whose canonical id is not in the master has no row here.
    """
    absorbed = clusters.groupBy(F.col("canonical_id").alias("_canonical")).agg(
        F.sum((F.col("is_duplicate") == "YES").cast("long")).alias("duplicate_count"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("is_duplicate") == "YES", F.col("record_id")))), ",").alias("absorbed_ids"),
        F.max(F.col("record_id") == F.col("canonical_id")).alias("_present"),
    )
    return master.join(absorbed.where("_present"), F.col(entity.id_col) == F.col("_canonical")).drop("_canonical", "_present")


def dedup_kpis(masters: dict[str, DataFrame], deduped: dict[str, DataFrame], kinds: dict[str, str]) -> DataFrame:
    """Records before and after for each entity and in total."""
    parts = []
    for name, df in masters.items():
        for frame, before in ((df, 1), (deduped[name], 0)):
            n = frame.agg(F.count("*").alias("n"))
            parts.append(n.select(F.lit(kinds[name]).alias("entity_type"), (F.col("n") * before).alias("total_records"), (F.col("n") * (1 - before)).alias("canonical_records")))
    every = reduce(DataFrame.unionByName, parts)
    sums = every.groupingSets([["entity_type"], []], "entity_type").agg(F.sum("total_records").alias("total_records"), F.sum("canonical_records").alias("canonical_records"))
    removed = F.col("total_records") - F.col("canonical_records")
    return sums.select(F.coalesce("entity_type", F.lit("TOTAL")).alias("entity_type"), "total_records", "canonical_records", removed.alias("duplicate_count"), share(removed, F.col("total_records"), 0.0).alias("duplicate_rate"))
