"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosines.

Vectors are normalised; in each of several tables a few quantised random
projections name a bucket, and vectors of equal label that share a bucket are
compared by their exact cosine. The number of tables follows from the projections in each,
so that a pair at the threshold meets in at least one table with probability
``1 - MISSED``, and closer pairs more surely, at every size of the input. The number of projections
grows with the logarithm of the largest label: more of them make chance meetings rarer, so the work grows
slower than the square of the input (:func:`plan_tables`).

Equal vectors of one label are one class with a key of its own. A pair of classes is counted in the first
table where it meets, so no list of pairs is made: tasks return sums of links and
the edges of a spanning forest. Buckets beyond ``block`` classes are cut into
blocks and joined block by block.

Vectors that are null, empty, all zero or hold null or non-finite components, vectors
without a label and rows without an id link with nothing and are kept. Vectors of
different length are never linked. Repeated rows are linked like other equal
vectors, and so are rows that repeat an id with other vectors: each row has the links of its own vector. Empty tables
give no rows. Only the three named columns are read, whatever the others are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.vectors import Projections, matrix, packed, sorted_groups, stored_type, valid_vector
from tessera.operators.components import connected_components
from tessera.llm.words import tidy
from tessera.storage import materialize

COSINE = 0.93
WIDTH, SEED, MISSED = 2.0, 3, 1e-3
BLOCK = 1024
#: Costs of one table entry, and of one comparison, in the same unit (about 5 ns).
ENTRY_COST, COMPARE_COST = 400, 1


def meeting(distance: float, width: float) -> float:
    """Probability that one quantised Gaussian projection of ``width`` puts two points in one cell (Datar et al., 2004)."""
    r = width / max(distance, 1e-9)
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan_tables(classes: int, cosine: float = COSINE, width: float = WIDTH) -> tuple[int, int]:
    """Tables and projections a table for ``classes`` vectors of one label: the cheapest that keep the promise on links."""
    near, far = meeting(math.sqrt(max(0.0, 2 - 2 * cosine)), width), meeting(math.sqrt(2), width)
    options = []
    for per_table in range(4, 33):
        tables = max(1, math.ceil(math.log(MISSED) / math.log1p(-min(near**per_table, 1 - 1e-9))))
        options.append((tables * (ENTRY_COST + classes * far**per_table * COMPARE_COST), tables, per_table))
    _, tables, per_table = min(options)
    return tables, per_table


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_dim(vectors, kind: str):
    """Row numbers and unit rows for each dimension in a column of packed vectors."""
    sizes = np.array([len(x.as_buffer()) for x in vectors])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, _unit(matrix(vectors.take(pa.array(rows)), kind))


def _codes(kind: str, tables: int, per_table: int, width: float):
    made: dict[int, Projections] = {}

    def of(units: np.ndarray) -> np.ndarray:
        dim = units.shape[1]
        if dim not in made:
            made[dim] = Projections(dim, tables, per_table, width, SEED)
        return made[dim].codes(units)

    return of


def _links(kind: str, cosine: float, codes_of):
    """Compare the classes of each ``(label, t, code, pair)``; ``side`` tells the blocks of a pair apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst, links = [], [], []
        for rows in sorted_groups(batches, 4):
            m = rows.num_rows
            if m < 2:
                continue
            table = rows.column(1)[0].as_py()
            ids, count, side = (rows.column(c).to_numpy() for c in (4, 5, 6))
            vectors = rows.column(7).combine_chunks()
            if len({len(x.as_buffer()) for x in vectors}) > 1:
                continue  # keys hold the dimension; this is a clash of hashes
            units = _unit(matrix(vectors, kind))
            hit = units @ units.T >= cosine
            if side.max() > 0:
                hit &= side[:, None] != side[None, :]
            np.fill_diagonal(hit, False)
            a, b = np.nonzero(hit)
            if not len(a):
                continue
            fresh = np.ones(len(a), dtype=bool)
            if table:
                codes = codes_of(units)[:, :table]
                for t in range(table):
                    fresh &= codes[a, t] != codes[b, t]
            total = np.bincount(a[fresh], weights=count[b[fresh]], minlength=m).astype(np.int64)
            label, before = ids.copy(), None
            while before is None or (label != before).any():
                before = label.copy()
                np.minimum.at(label, a, before[b])
            for i in np.flatnonzero((total > 0) | (label != ids)).tolist():
                src.append(ids[i])
                dst.append(label[i])
                links.append(total[i])
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(links, pa.int64())], names=["src", "dst", "links"])

    return run


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE,
    tables: int | None = None, per_table: int | None = None, width: float = WIDTH, block: int = BLOCK,
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    kind = stored_type(vectors, vector_col)
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    usable = valid_vector(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = packed(named.where(usable), "embedding", "vec_id", "label")
    grouped = rows.groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = materialize(grouped.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    if tables is None or per_table is None:
        tables, per_table = plan_tables(classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0, cosine, width)
    codes_of = _codes(kind, tables, per_table, width)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, units in _by_dim(batch.column(3), kind):
                codes = codes_of(units)
                own = batch.take(pa.array(np.repeat(at, tables)))
                t = np.tile(np.arange(tables, dtype=np.int32), len(at))
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(t), pa.array(codes.reshape(-1)), *own.columns[1:]], names=["label", "t", "code", "cid", "copies", "vector"])

    label_type = classes.schema["label"].dataType.simpleString()
    entries = classes.select("label", "cid", "copies", "vector").mapInArrow(tidy(expand), f"label {label_type}, t int, code long, cid long, copies long, vector binary")
    large = entries.groupBy("label", "t", "code").count().where(F.col("count") > block)
    large = large.select("label", "t", "code", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    # block pairs (i, j), i <= j, that hold the row's block; side 0 alone for i = j
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        (F.least(j, own) * F.col("blocks") + F.greatest(j, own)).alias("pair"), F.when(own > j, 1).when(own < j, 2).otherwise(0).alias("side")))
    alone = F.array(F.struct(F.lit(0).alias("pair"), F.lit(0).alias("side")))
    placed = (
        entries.join(large, ["label", "t", "code"], "left")
        .withColumn("place", F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(pairs)))
        .select("label", "t", "code", F.col("place.pair").alias("pair"), "cid", "copies", F.col("place.side").alias("side"), "vector")
    )
    keys = ["label", "t", "code", "pair"]
    found = materialize(
        placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(_links(kind, cosine, codes_of)), "src long, dst long, links long"), "vector-links"
    )
    heads = connected_components(found.where("src <> dst").select("src", "dst").distinct()).select(F.col("node").alias("cid"), F.col("component").alias("head"))
    sums = found.groupBy(F.col("src").alias("cid")).agg(F.sum("links").alias("links"))
    headed = classes.join(sums, "cid", "left").join(heads, "cid", "left").withColumn("head", F.coalesce("head", "cid"))
    judged = headed.join(headed.groupBy("head").agg(F.min("least").alias("component_id")), "head")
    judged = judged.select("label", "vector", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = rows.join(judged, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    apart = named.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(apart).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def near_vectors_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: links and components of near-duplicate embeddings."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
