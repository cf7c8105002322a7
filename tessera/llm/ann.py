"""Approximate nearest neighbours by multiprobe p-stable hashing.

Every distinct vector is stored in one bucket of each table. A query visits, in
each table, its own bucket and then the buckets whose perturbed cells are likeliest
to hold near vectors, in the order of the squared distances to the crossed cell
borders. Candidates of all tables are ranked by their exact distance.

The cell width and the number of probes are fitted on a bounded sample (:data:`SAMPLE` vectors, in the
order of a hash): as many probes as :data:`FITTED` of the sample's near pairs need to meet in
a table. All vectors are indexed. Where near vectors are much nearer than others, few
probes do; random vectors in 64 dimensions leave little contrast, and most of them
are visited (README).

Equal vectors are stored once with their ``k + 1`` smallest ids, all that a result
can use, and equal query vectors are searched once. Only probes of buckets that hold something travel; large
buckets are cut into blocks. A query with fewer than ``k`` results from its probes is compared with all
vectors, in blocks. Vectors that are null, empty, zero or hold null or non-finite
components, and rows without an id, take no part; vectors of another length are no
candidates. Repeated rows are separate candidates only if their ids differ; a query id that comes with
several vectors is searched with the smallest of them in the order of their bytes. Empty tables give no rows. Only
the two named columns are read, whatever the others are called.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.vectors import Projections, matrix, packed, sorted_groups, stored_type, valid_vector
from tessera.llm.words import spread, tidy
from tessera.storage import materialize

TABLES, PER_TABLE, WIDTH, SEED = 4, 10, 2.5, 10
#: Vectors that set the cell width and the probes, the share of near pairs that must meet, and the most probes of a table.
SAMPLE, FITTED, MOST_PROBES = 1000, 0.95, 512
#: Queries whose results a task holds at a time.
HELD = 4096
#: Vectors of one bucket that a task compares at a time, and distances that it estimates at a time.
BLOCK = 4096
CELLS = 1 << 18


def probe_cells(place: np.ndarray, probes: int) -> np.ndarray:
    """Cells to visit for one query in one table, best first (query-directed probing)."""
    cell = np.floor(place)
    inside = place - cell
    moves = sorted([(x * x, j, -1) for j, x in enumerate(inside)] + [((1 - x) ** 2, j, 1) for j, x in enumerate(inside)])
    out, heap = [cell], [(moves[0][0], (0,))]
    while heap and len(out) < probes:
        score, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if len({moves[i][1] for i in chosen}) == len(chosen):
            new = cell.copy()
            for i in chosen:
                new[moves[i][1]] += moves[i][2]
            out.append(new)
        if last + 1 < len(moves):
            heapq.heappush(heap, (score + moves[last + 1][0], (*chosen, last + 1)))
            heapq.heappush(heap, (score - moves[last][0] + moves[last + 1][0], (*chosen[:-1], last + 1)))
    return np.array(out)


def needed_probes(hasher: Projections, x: np.ndarray, near: int, queries: int = 100) -> int:
    """Probes of each table after which :data:`FITTED` of the sample's ``near`` nearest pairs have met."""
    far = np.stack([((x - q) ** 2).sum(axis=1) for q in x[:queries]])  # a query at a time: the driver has little room
    np.fill_diagonal(far, np.inf)
    close = np.argsort(far, axis=1, kind="stable")[:, : min(near, len(x) - 1)]
    places = hasher.places(x)
    codes = hasher.keys(np.floor(places))
    needed = np.full(close.shape, MOST_PROBES)
    for i in range(len(close)):
        for t in range(hasher.tables):
            rank: dict[int, int] = {}
            for n, code in enumerate(hasher.keys(probe_cells(places[i, t], MOST_PROBES)).tolist()):
                rank.setdefault(code, n + 1)
            needed[i] = np.minimum(needed[i], [rank.get(c, MOST_PROBES) for c in codes[close[i], t].tolist()])
    return max(8, int(np.quantile(needed, FITTED, method="higher")))


def _nearest(kind: str, k: int):
    """Best ``k + 1`` of each query over the buckets of a task; rows are ``t, code, block, query, ids, vector``.

    ``compared`` counts the distances taken for a query, in rows of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int]]] = {}
        taken: dict[int, int] = {}

        def flush() -> pa.RecordBatch:
            flat = [(q, d, s, 0) for q, top in best.items() for s, d in top] + [(q, None, None, n) for q, n in taken.items()]
            best.clear()
            taken.clear()
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], kind) for i, kind in enumerate(kinds)], names=["query", "vec_id", "score", "compared"])

        for rows in sorted_groups(batches, 3):
            query = rows.column(3).to_numpy(zero_copy_only=False)
            asks = np.isfinite(query.astype(np.float64))
            if asks.all() or not asks.any():
                continue
            vectors = rows.column(5).combine_chunks()
            size = np.array([len(x.as_buffer()) for x in vectors])
            ids = rows.column(4).combine_chunks()
            for dim in np.unique(size[asks]):
                stored = np.flatnonzero(~asks & (size == dim))
                if not len(stored):
                    continue
                table = matrix(vectors.take(pa.array(stored)), kind)
                own = ids.take(pa.array(stored))
                at = np.flatnonzero(asks & (size == dim))
                long = np.einsum("ij,ij->i", table, table)  # infinite beyond 1e154
                step = max(1, CELLS // len(table))
                for part in (at[i : i + step] for i in range(0, len(at), step)):
                    asked = matrix(vectors.take(pa.array(part)), kind)
                    mine = query[part].astype(np.int64).tolist()
                    short = np.einsum("ij,ij->i", asked, asked)
                    # squares by one matrix product tell what can be near, up to rounding; the distances themselves are taken from the gaps
                    with np.errstate(over="ignore", invalid="ignore"):
                        about = long - 2 * (asked @ table.T) + short[:, None]
                    slack = 1e-10 * (long.max() + short) + 1e-300
                    for q in mine:
                        taken[q] = taken.get(q, 0) + len(table)
                    bound = np.array([best[q][k][0] * best[q][k][0] if len(best.setdefault(q, [])) > k else np.inf for q in mine])
                    about[~np.isfinite(about).all(axis=1)] = 0  # beyond the range of squares everything is looked at
                    for j in np.flatnonzero(about.min(axis=1) <= bound * (1 + 1e-10) + slack):
                        limit = bound[j] * (1 + 1e-10)
                        if len(table) > k + 1:
                            limit = min(limit, np.partition(about[j], k)[k] + slack[j])
                        near = np.flatnonzero(about[j] <= limit + slack[j])
                        gap = table[near] - asked[j]
                        far = np.sqrt(np.einsum("ij,ij->i", gap, gap))
                        seen = set(best[mine[j]])
                        new = {(float(f), d) for f, i in zip(far, near, strict=True) for d in own[int(i)].as_py()} - seen
                        if new:
                            best[mine[j]] = heapq.nsmallest(k + 1, seen | new)
            if len(best) >= HELD:
                yield flush()
        yield flush()

    return run


def _held_buckets(visits: DataFrame, sizes: DataFrame) -> DataFrame:
    """Probes of buckets that hold something; the optimizer takes probes for as few as queries, so it is kept from broadcasting them."""
    return visits.hint("merge").join(sizes, ["t", "code"])


def _sample(vectors: DataFrame, total: int) -> list:
    """The first :data:`SAMPLE` vectors in the order of a hash.

    An ordered limit brings so many rows of every task to the driver; only hashes below a bound, some four times
    as many as are wanted in all, are let through where that is enough.
    """
    order = F.xxhash64("vector")
    if total > 8 * SAMPLE:
        low = vectors.where(order < F.lit(-(2**63) + (2**64 * 4 * SAMPLE) // total)).orderBy(order, "vector").limit(SAMPLE).collect()
        if len(low) == SAMPLE:
            return low
    return vectors.orderBy(order, "vector").limit(SAMPLE).collect()


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    tables: int = TABLES, per_table: int = PER_TABLE, probes: int | None = None, width: float = WIDTH,
) -> DataFrame:
    """``query_id, rank, vec_id, score, compared``: the ``k`` nearest rows of ``vectors`` found for each row of ``queries``.

    ``compared`` is the number of distances taken for the query's vector.
    """
    spark, kind = vectors.sparkSession, stored_type(vectors, vector_col)

    def clean(df: DataFrame) -> DataFrame:
        named = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
        return packed(spread(named).where(valid_vector(F.col("v")) & F.col("id").isNotNull()), "v", "id")

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[bytes, set[int]] = {}
            for v, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(v, set()).add(i)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([heapq.nsmallest(k + 1, x) for x in held.values()], pa.list_(pa.int64()))], names=["vector", "ids"])

    short = clean(vectors).mapInArrow(tidy(shorten), "vector binary, ids array<long>").groupBy("vector").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    stored = materialize(short.select("vector", F.slice(F.array_sort(F.array_distinct("ids")), 1, k + 1).alias("ids")), "ann-vectors")
    total = stored.count()
    sample = _sample(stored.select("vector"), total)
    step = np.dtype(kind).itemsize
    hashers: dict[int, Projections] = {}
    depth = {}

    def hasher(size: int, scale: float = 1.0) -> Projections:
        if size not in hashers:
            hashers[size] = Projections(size // step, tables, per_table, width * scale, SEED)
        return hashers[size]

    for dim in sorted({len(r[0]) for r in sample}):
        x = np.stack([np.frombuffer(r[0], kind) for r in sample if len(r[0]) == dim]).astype(np.float64)
        gaps = np.sqrt(((x[: len(x) // 2, None] - x[None, len(x) // 2 : len(x) // 2 + 50]) ** 2).sum(axis=2))
        own = hasher(dim, float(np.median(gaps[gaps > 0])) / np.sqrt(2) if (gaps > 0).any() else 1.0)
        # of k neighbours among all vectors, so many are expected in the sample
        depth[dim] = probes or (needed_probes(own, x, max(1, round(k * len(sample) / total))) if len(x) > 1 else 8)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array([len(x.as_buffer()) for x in batch.column(0)])
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                own = batch.take(pa.array(np.repeat(at, tables)))
                codes = hasher(dim).codes(matrix(batch.column(0).take(pa.array(at)), kind)).reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(tables, dtype=np.int32), len(at))), pa.array(codes), own.column(1), own.column(0)], names=["t", "code", "ids", "vector"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(0)[i].as_py()
                own = hasher(len(raw))
                places = own.places(np.frombuffer(raw, kind).astype(np.float64)[None])[0]
                codes = [np.unique(own.keys(probe_cells(places[t], depth.get(len(raw), MOST_PROBES)))) for t in range(tables)]
                t = np.repeat(np.arange(tables, dtype=np.int32), [len(c) for c in codes])
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.concatenate(codes)), pa.array([batch.column(1)[i].as_py()] * len(t), pa.int64())], names=["t", "code", "query"])

    none, no_query = F.lit(None).cast("array<long>"), F.lit(None).cast("long")
    # one vector for each query id, one query for each vector
    wanted = clean(queries).groupBy("id").agg(F.min("vector").alias("vector"))
    wanted = materialize(wanted, "ann-queries")
    asked = materialize(wanted.select("vector").distinct().withColumn("query", F.monotonically_increasing_id()), "ann-query-vectors")
    entries = materialize(stored.select("vector", "ids").mapInArrow(tidy(index), "t int, code long, ids array<long>, vector binary"), "ann-entries")
    visits = asked.select("vector", "query").repartition(spark.sparkContext.defaultParallelism).mapInArrow(tidy(visit), "t int, code long, query long")
    sizes = entries.groupBy("t", "code").count().select("t", "code", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    large = sizes.where("blocks > 1")
    held = entries.join(large, ["t", "code"], "left").select("t", "code", F.pmod(F.xxhash64("vector"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block"), no_query.alias("query"), "ids", "vector")
    met = _held_buckets(visits, sizes).join(asked, "query")
    asks = met.select("t", "code", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "query", none.alias("ids"), "vector")

    def compare(rows: DataFrame) -> DataFrame:
        placed = rows.repartition("t", "code", "block").sortWithinPartitions("t", "code", "block")
        return placed.mapInArrow(tidy(_nearest(kind, k)), "query long, vec_id long, score double, compared long")

    found = materialize(compare(held.unionByName(asks)), "ann-found")
    enough = found.where("vec_id IS NOT NULL").select("query", "vec_id").distinct().groupBy("query").count().where(F.col("count") > k)
    short_of = asked.join(enough, "query", "left_anti")
    if not short_of.select("query").isEmpty():
        # too few neighbours in the visited buckets: these queries meet every vector, block by block
        n = max(1, -(-total // BLOCK))
        everything = stored.select(F.lit(0).alias("t"), F.pmod(F.xxhash64("vector"), F.lit(n)).alias("code"), F.lit(0).alias("block"), no_query.alias("query"), "ids", "vector")
        all_asks = short_of.select(F.lit(0).alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("code"), F.lit(0).alias("block"), "query", none.alias("ids"), "vector")
        found = found.unionByName(compare(everything.unionByName(all_asks)))
    # a query's own id is among the k + 1 nearest of its vector
    each = found.groupBy("query", "vec_id").agg(F.min("score").alias("score"), F.sum("compared").alias("compared"))
    each = each.withColumn("compared", F.sum("compared").over(Window.partitionBy("query"))).where("vec_id IS NOT NULL")
    first = each.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("place") <= k + 1)
    named = wanted.join(asked, "vector").select(F.col("id").alias("query_id"), "query").join(first, "query").where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "compared")


def nearest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the ten nearest of every hundredth embedding."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 100 == 0))
