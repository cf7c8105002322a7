import random

import numpy as np
import pyarrow.dataset as ds
import pytest

from tessera.llm import ann, near_vectors

FOLDER = "/root/testdata/sf0.01"


def table():
    t = ds.dataset(f"{FOLDER}/embeddings.parquet").to_table().to_pandas()
    return t.vec_id.to_numpy(), np.array(t.embedding.tolist(), dtype=np.float64), t.label.to_numpy()


def linked(ids, x, label):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hit = (unit @ unit.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(hit, False)
    component, a, b = ids.copy(), *np.nonzero(hit)
    for _ in ids:
        np.minimum.at(component, a, component[b])
    return hit, {int(i): (int(n), int(c), bool(c == i)) for i, n, c in zip(ids, hit.sum(axis=1), component, strict=True)}


@pytest.mark.parametrize("block", [1024, 8])
def test_near_vectors(spark, block):
    ids, x, label = table()
    # beside them, pairs at cosines around the threshold, a chain, and a cluster with exact copies
    rng = np.random.default_rng(1)
    more, wanted = [], np.concatenate((rng.uniform(0.90, 0.93, 60), rng.uniform(0.93, 0.99, 240)))
    for c in wanted:
        a, b = rng.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        more += [a, 3 * (c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b))]
    steps = [rng.standard_normal(64)]
    for _ in range(20):
        steps.append(steps[-1] + 0.03 * rng.standard_normal(64))
    cluster = rng.standard_normal(64) + 0.02 * rng.standard_normal((30, 64))
    more += [*steps, *cluster, *cluster[:9]]
    x = np.concatenate((x, np.array(more).astype(np.float32).astype(np.float64)))
    ids = np.arange(len(x)) * 7 % 100_003
    label = np.concatenate((label, np.full(len(more), 3)))
    hit, want = linked(ids, x, label)
    df = spark.createDataFrame([(int(i), v.tolist(), int(c)) for i, v, c in zip(ids, x, label, strict=True)], "vec_id long, embedding array<float>, label int")
    rows = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_vectors(df, block=block).collect()}
    assert hit.sum() // 2 > 700 and {r: w for r, w in want.items() if not w[0]} == {r: rows[r] for r, w in want.items() if not w[0]}
    assert sum(n for n, _, _ in rows.values()) >= 0.995 * hit.sum() and sum(rows[r] == w for r, w in want.items()) >= 0.995 * len(want)


def test_tables_keep_their_promise():
    rng = np.random.default_rng(2)
    last = 1.0
    for n in (100, 10_000, 1_000_000):
        tables, per_table = near_vectors.plan_tables(n)
        share = tables * near_vectors.meeting(np.sqrt(2), near_vectors.WIDTH) ** per_table  # of unrelated pairs that meet
        assert share < last
        last = share
        met = near_vectors.meeting(np.sqrt(2 - 2 * near_vectors.COSINE), near_vectors.WIDTH) ** per_table
        assert (1 - met) ** tables <= near_vectors.MISSED
    a, b = rng.standard_normal((2, 64))
    a /= np.linalg.norm(a)
    b -= (a @ b) * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b)
    hasher = near_vectors.Projections(64, 4000, 1, near_vectors.WIDTH, 5)
    assert (hasher.codes(np.array([a, b]))[0] == hasher.codes(np.array([a, b]))[1]).mean() == pytest.approx(near_vectors.meeting(np.linalg.norm(a - b), near_vectors.WIDTH), abs=0.02)


ROWS = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [float("nan"), 1.0], 1), (6, [1.0, None], 1), (7, [1.0, 0.01], None), (8, [1.0, 0.02], 2), (9, [1.0, 0.0], 1), (9, [1.0, 0.0], 1), (100, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (200, [1.0, 0.0], 1), (0, [], 1)]


def test_odd_vectors(spark):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in ROWS], "vec_id long, embedding array<double>, label int, vector string, query int, cid int")
    got = near_vectors.near_vectors(df).collect()
    assert len(got) == len(ROWS)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["n_links"]) == [(1, 4, 1), (2, 4, 1), (9, 4, 1), (9, 4, 1), (200, 4, 1)]
    near = ann.nearest_neighbours(df, df.where("vec_id % 100 = 0")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in near] == [(200, 1, 1, 0.0), (200, 2, 9, 0.0), (200, 3, 7, pytest.approx(0.01)), (200, 4, 8, pytest.approx(0.02)), (200, 5, 2, 1.0)]
    empty = df.limit(0)
    assert near_vectors.near_vectors(empty).count() == 0 and ann.nearest_neighbours(empty, empty).count() == 0


def test_ids_that_come_with_several_vectors(spark):
    schema = "vec_id long, embedding array<double>, label int"
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (3, [0.01, 1.0], 1), (4, [0.0, -1.0], 1)], schema)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in near_vectors.near_vectors(df).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)]
    asked = spark.createDataFrame([(0, [1.0, 0.0], 1), (0, [2.0, 0.0], 1)], schema)
    (first,) = [r for r in ann.nearest_neighbours(df, asked, k=1).collect()]
    assert np.array([2.0, 0.0]).tobytes() < np.array([1.0, 0.0]).tobytes()  # so this one is searched
    assert (first["query_id"], first["vec_id"], first["score"]) == (0, 1, 1.0)


def recall(ids, x, rows):
    """Recall at 10, and the distances taken as a share of a full scan's."""
    got: dict = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append(r)
    found = 0
    for q, own in got.items():
        far = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        want = [int(ids[i]) for i in np.lexsort((ids, far)) if ids[i] != q][:10]
        own = sorted(own, key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and [r["score"] for r in own] == sorted(r["score"] for r in own)
        assert all(r["score"] == pytest.approx(far[ids == r["vec_id"]][0], abs=1e-12) for r in own)
        found += len({r["vec_id"] for r in own} & set(want))
    return found / len(got) / 10, np.mean([own[0]["compared"] for own in got.values()]) / len(x)


def test_recall(spark):
    ids, x, _ = table()
    share, compared = recall(ids, x, ann.nearest_query(spark, FOLDER).collect())
    assert share >= 0.9 and compared < 1.5


def test_few_vectors_are_compared_where_they_cluster(spark):
    rng = np.random.default_rng(3)
    x = (np.repeat(rng.standard_normal((100, 64)), 30, axis=0) + 0.1 * rng.standard_normal((3000, 64))).astype(np.float32).astype(np.float64)
    ids = np.array(random.Random(1).sample(range(3000), 3000))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    share, compared = recall(ids, x, ann.nearest_neighbours(df, df.where("vec_id % 100 = 0")).collect())
    assert share >= 0.95 and compared < 0.2


def test_fitting_takes_little_memory_on_the_driver():
    import tracemalloc

    x = np.random.default_rng(1).standard_normal((ann.SAMPLE, 64))
    tracemalloc.start()
    ann.needed_probes(ann.Projections(64, 1, ann.PER_TABLE, 20.0, 1), x, 1, 20)
    tracemalloc.reset_peak()
    ann.needed_probes(ann.Projections(64, 1, ann.PER_TABLE, 20.0, 1), x, 1, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6  # 51 MB for each array of all gaps


def test_the_sample_does_not_bring_rows_of_every_task(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(ann, "SAMPLE", 20)
    rows = spark.range(500).select(F.encode(F.col("id").cast("string"), "utf-8").alias("vector"))
    want = rows.orderBy(F.xxhash64("vector"), "vector").limit(20).collect()
    assert ann._sample(rows, 500) == want and ann._sample(rows, 10**6) == want  # too low a bound falls back


@pytest.mark.parametrize("scale", [1e-170, 1.0, 1e160])
def test_distances_of_any_size_are_exact(scale):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    stored, asked = rng.standard_normal((60, 8)) * scale, rng.standard_normal((5, 8)) * scale
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary())
    rows = [(0, 0, 0, None, [i], v.tobytes()) for i, v in enumerate(stored)] + [(0, 0, 0, q, None, v.tobytes()) for q, v in enumerate(asked)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=list("tcbqiv"))
    with np.errstate(all="ignore"):
        got = [r for b in ann._nearest("<f8", 3)(iter([batch])) for r in b.to_pylist() if r["vec_id"] is not None]
        far = np.sqrt(((stored[None] - asked[:, None]) ** 2).sum(axis=2))
    for q in range(5):
        assert [(r["score"], r["vec_id"]) for r in got if r["query"] == q] == [(pytest.approx(far[q, i]), i) for i in np.lexsort((np.arange(60), far[q]))[:4]]


def test_probes_are_not_collected_on_the_driver(spark):
    def many(batches):
        yield from batches

    visits = spark.range(10).selectExpr("cast(id as int) AS t", "id AS code", "id AS query").mapInArrow(many, "t int, code long, query long")
    sizes = spark.range(10).selectExpr("cast(id as int) AS t", "id AS code", "1 AS blocks").groupBy("t", "code").count()
    met = ann._held_buckets(visits, sizes)
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString() and met.count() == 10
    assert "Broadcast" in visits.join(sizes, ["t", "code"])._jdf.queryExecution().executedPlan().toString()
