"""The stages of a run, each a lazy table built from the ones before it."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession

from tessera.config import ENTITIES, Settings
from tessera.operators import analytics, clusters, golden, ingest, matching, quality, standardize
from tessera.storage import materialize


class Pipeline:
    """Base tables in, every derived table out.

    Tables are made when they are first asked for. Standard tables, match edges and clusters, which
    several stages read, are written to the shared folder once, and so are checked rows where a whole run needs them.
    """

    def __init__(self, spark: SparkSession, base: dict[str, DataFrame], settings: Settings | None = None):
        self.spark, self.base, self.settings = spark, base, settings or Settings()

    @classmethod
    def from_tables(cls, spark: SparkSession, folder: str, settings: Settings | None = None) -> Pipeline:
        """From Parquet tables named like the base tables."""
        from tessera.sources.tables import load_tables

        return cls(spark, load_tables(spark, folder), settings)

    @cached_property
    def staged(self) -> dict[str, DataFrame]:
        return {name: ingest.clean_table(df, name) for name, df in self.base.items()}

    @cached_property
    def std(self) -> dict[str, DataFrame]:
        return {name: standardize.STANDARDS[name](df) for name, df in self.staged.items()}

    @cached_property
    def kept(self) -> _Lazy:
        """Standard tables as later stages read them."""
        return _Lazy(lambda name: materialize(self.std[name], f"std-{name}"))

    @cached_property
    def edges(self) -> _Lazy:
        """Match edges of each entity."""

        def make(name: str) -> DataFrame:
            std = {**self.std, name: self.kept[name]}
            return materialize(matching.entity_matches(name, std, self.settings), f"matches-{name}")

        return _Lazy(make)

    @cached_property
    def matches(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.edges[name] for name in ENTITIES])

    @cached_property
    def golden_accounts(self) -> DataFrame:
        return clusters.golden_ids(self.std["golden_map"])

    def clusters(self, name: str) -> DataFrame:
        return self._clusters[name]

    @cached_property
    def _clusters(self) -> _Lazy:
        def make(name: str) -> DataFrame:
            known = self.golden_accounts if name == "accounts" else None
            return materialize(clusters.cluster_map(self.edges[name], ENTITIES[name], self.kept[name], known, matching.is_star(name, self.settings)), f"clusters-{name}")

        return _Lazy(make)

    @cached_property
    def dedup(self) -> _Lazy:
        return _Lazy(lambda name: clusters.dedup_table(self.kept[name], ENTITIES[name], self.clusters(name)))

    @cached_property
    def checked(self) -> _Lazy:
        def make(name: str) -> DataFrame:
            known = None
            if name == "contacts":
                known = self.dedup["accounts"].select("account_id")
                if self.settings.orphan_scope == "all":
                    known = known.union(self.clusters("accounts").select("record_id"))
            return quality.checked(name, self.dedup[name], self.settings, known, self.std["stewardship"])

        return _Lazy(make)

    def write_checked(self, names: Iterable[str] = ENTITIES) -> None:
        """Write the checked rows of entities; stages that are made from now on read them."""
        for name in names:
            if not hasattr(self.checked[name], "_tessera_path"):
                self.checked[name] = materialize(self.checked[name], f"checked-{name}")

    def each(self, lazy: _Lazy) -> dict[str, DataFrame]:
        return {name: lazy[name] for name in ENTITIES}

    @cached_property
    def issues(self) -> _Lazy:
        return _Lazy(lambda name: quality.issues(self.checked[name], ENTITIES[name]))

    @cached_property
    def scores(self) -> DataFrame:
        return quality.scores(self.each(self.checked), self.settings)

    @cached_property
    def record_quality(self) -> _Lazy:
        def make(name: str) -> DataFrame:
            return quality.quality_by_id(quality.record_quality(self.checked[name], ENTITIES[name], self.settings), ENTITIES[name])

        return _Lazy(make)

    @cached_property
    def golden(self) -> _Lazy:
        def make(name: str) -> DataFrame:
            curated = self.std["golden_map"] if name == "accounts" else None
            self.write_checked([name])  # a golden record is put together from several reads of its entity's quality
            judged = materialize(self.record_quality[name], f"quality-{name}")
            return golden.golden_records(ENTITIES[name], self.dedup[name], self.clusters(name), judged, curated)

        return _Lazy(lambda name: materialize(make(name), "golden"))

    @cached_property
    def governance(self) -> DataFrame:
        self.write_checked()
        maps = {name: self.clusters(name) for name in ENTITIES}
        return analytics.governance_metrics(self.scores, self.each(self.record_quality), self.each(self.golden), maps, self.std["stewardship"], self.settings)

    @cached_property
    def business(self) -> _Lazy:
        """Business figures; each makes the golden records that it reads."""
        return _Lazy(lambda name: analytics.BUSINESS[name](self.golden))

    def outputs(self) -> dict[str, DataFrame]:
        """Every table of a full run, by name."""
        self.write_checked()
        out = {f"std_{name}": df for name, df in self.std.items()} | {"entity_match_table": self.matches}
        for name in ENTITIES:
            out |= {f"dedup_{name}": self.dedup[name], f"dedup_map_{name}": self.clusters(name), f"quality_scores_{name}": self.record_quality[name], f"golden_{name}": self.golden[name]}
        out["dq_issues"] = reduce(DataFrame.unionByName, [self.issues[name] for name in ENTITIES])
        out |= {"dq_scores": self.scores, "governance_metrics": self.governance, **{name: self.business[name] for name in analytics.BUSINESS}}
        out["business_analytics_dataset"] = analytics.business_dataset(self.each(self.golden), self.business, self.settings)
        return out


class _Lazy(dict):
    """A dictionary that makes a value when it is first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.make(name)
        return self[name]
