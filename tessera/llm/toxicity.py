"""Toxicity: a character n-gram linear classifier scaled by naive Bayes log-count ratios.

A text's features are the distinct character n-grams (4, 6 and 8 characters, A-Z folded,
ASCII marks as spaces, one space at either end) of the whole text, hashed to 2**20
buckets. Each feature is scaled by its naive Bayes log-count ratio between labelled classes
(times the ratio's size, so that features with little evidence count little); logistic
regression on the scaled features, by dual coordinate ascent, gives the weights (Wang and
Manning, 2012). Every bucket that a sampled row has keeps its weight.

The fit uses a bounded sample of labelled rows, :data:`SAMPLE_ROWS` at most, taken in
the order of a hash of the id, whatever the corpus; it runs in one task that holds
four bytes for each feature of these rows. Every text is scored.

Null and empty texts have only the n-grams of the padding and get the score of a
text without evidence. Without labelled rows of both classes every score is the
smoothed share of label 1, and the model says so in ``evidence``. Rows without an id are scored, but not held out or learnt
from; repeated rows are scored one by one; of contradicting labels of an id the
larger counts. Empty tables give no rows. A text is held whole by one task, some 50 bytes for
each of its characters. Other columns are kept; one that has the name of the score is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.words import tidy, whole_texts
from tessera.storage import discard, materialize

ORDERS = (4, 6, 8)
HASH_BITS = 20
#: Labelled rows the fit sees at most.
SAMPLE_ROWS = 10_000
THRESHOLD = 0.3
#: Weight of the squared weights, and the square of the constant feature whose weight is the bias.
PENALTY, BIAS_SQUARE = 2.0, 100.0
#: Pseudo-count of a bucket over both classes, and passes over the sampled rows.
SMOOTHING, PASSES = 30.0, 32
CHUNK_CHARS = 1 << 19

#: ASCII letters in lower case, digits as they are, all else as a space: words end alike before any mark.
_FOLD = np.array([ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(128)], dtype=np.uint32)

_rng = np.random.Generator(np.random.PCG64(4))
_STEP = _rng.integers(1, 2**31, (max(ORDERS) + 1, max(ORDERS)), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, code points, each text's end)`` of padded texts, A-Z folded."""
    held, size, row = [], 0, 0

    def made() -> tuple[int, np.ndarray, np.ndarray]:
        points = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
        ascii_ = points < 128
        points[ascii_] = _FOLD[points[ascii_]]
        return row, points, np.cumsum([len(x) for x in held])

    for text in pc.fill_null(texts.cast(pa.large_string()), "").to_pylist():
        held.append(f" {text} ")
        size += len(text) + 2
        if size >= CHUNK_CHARS:
            yield made()
            row += len(held)
            held, size = [], 0
    if held:
        yield made()


def _features(points: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct buckets of each text of a chunk, in no order."""
    hashes = []
    for n in ORDERS:
        m = max(0, len(points) - n + 1)
        h = points[:m] * _STEP[n, 0]
        for k in range(1, n):
            h += points[k : k + m] * _STEP[n, k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h >>= np.uint32(32 - HASH_BITS)
        hashes.append(h)
    stamp, number = np.empty(1 << HASH_BITS, np.uint32), np.arange(len(ORDERS) * len(points), dtype=np.uint32)
    start = 0
    for end in ends.tolist():
        found = np.concatenate([h[start : max(start, end - n + 1)] for n, h in zip(ORDERS, hashes, strict=True)])
        # of equal buckets the one that stamped last stays
        own = number[: len(found)]
        stamp[found] = own
        yield found[stamp[found] == own]
        start = end


@dataclass(frozen=True)
class ToxicityModel:
    """``score = 1 / (1 + exp(-(bias + sum of weights of the features present)))``."""

    weights: np.ndarray
    bias: float
    evidence: bool = True

    def scores(self, texts: pa.Array) -> np.ndarray:
        sums = [self.weights[found].sum(dtype=np.float64) for _, points, ends in _chunks(texts) for found in _features(points, ends)]
        return 1 / (1 + np.exp(-np.clip(self.bias + np.array(sums, np.float64), -500, 500)))


def log_count_ratios(toxic: np.ndarray, clean: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """Naive Bayes log-count ratio of every bucket, from the rows of either class that have it.

    Pseudo-counts follow the classes' sizes, so a bucket that no row has gets 0.
    """
    every = max(toxic.sum() + clean.sum(), 1.0)
    logs = []
    for own in (toxic, clean):
        pseudo = smoothing * max(own.sum(), 1e-9) / every
        logs.append(np.log(own + pseudo) - np.log(own.sum() + pseudo))
    return logs[0] - logs[1]


def feature_scales(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """What a present bucket counts: the signed square of its ratio."""
    ratio = log_count_ratios(toxic, clean)
    return ratio * np.abs(ratio)


def _dual_step(pull: float, own: float, norm: float, cost: float) -> float:
    """The dual variable in ``(0, cost)`` where ``norm * (a - own) + pull + log(a / (cost - a))`` is zero, by bisection."""
    low, high = -40.0, 40.0
    for _ in range(60):
        u = (low + high) / 2
        if norm * (cost / (1 + math.exp(-u)) - own) + pull + u > 0:
            high = u
        else:
            low = u
    return cost / (1 + math.exp(-u))


def fit(rows: list[tuple[np.ndarray, int]], scale: np.ndarray, penalty: float = PENALTY, passes: int = PASSES, tolerance: float = 1e-3) -> ToxicityModel:
    """Logistic regression on ``(distinct buckets, label)`` rows: ``penalty / 2`` times the squared weights plus the losses."""
    positive = sum(y for _, y in rows)
    prior = (positive + 1) / (len(rows) + 2)
    size, cost = 1 << HASH_BITS, 1 / penalty
    if positive in (0, len(rows)):
        return ToxicityModel(np.zeros(size, np.float32), float(np.log(prior / (1 - prior))), False)
    squares = (scale * scale).astype(np.float64)
    weights, bias = np.zeros(size), 0.0  # weights times scales: what a present feature adds
    dual = [1e-9 * cost] * len(rows)
    norms = [float(squares[x].sum()) + BIAS_SQUARE for x, _ in rows]
    rng = np.random.Generator(np.random.PCG64(4))
    moved = np.ones(len(rows))
    for k in range(passes):
        # rows that have settled are looked at in every fourth pass only
        for i in rng.permutation(len(rows) if k % 4 == 0 else np.flatnonzero(moved > tolerance)).tolist():
            x, y = rows[i][0], 1.0 if rows[i][1] else -1.0
            new = _dual_step(y * (float(weights[x].sum()) + bias), dual[i], norms[i], cost)
            move, dual[i] = new - dual[i], new
            moved[i] = abs(move) / cost
            if move:
                weights[x] += move * y * squares[x]
                bias += move * y * BIAS_SQUARE
        if moved.max() < tolerance:
            break
    return ToxicityModel(weights.astype(np.float32), float(bias))


def held_out(id_col: str):
    """Rows whose labels are never learnt: crc32 of the id's text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on the labelled documents outside the held-out fold."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)  # a bounded table, so it can be broadcast
    rows = whole_texts(docs).select(id_col, F.col(text_col).alias("t")).join(F.broadcast(sample), id_col)

    size, slots = 1 << HASH_BITS, 8

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, size), np.int64)
        for batch in batches:
            toxic = (batch.column(1).to_numpy() > 0).astype(int).tolist()
            for first, points, ends in _chunks(batch.column(0)):
                for i, found in enumerate(_features(points, ends)):
                    counts[toxic[first + i], found] += 1  # distinct buckets
        if counts.any():
            cut = counts.reshape(2, slots, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(slots, dtype=np.int32)), pa.array([cut[:, i].tobytes() for i in range(slots)], pa.binary())], names=["slot", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(raw.as_buffer(), np.int64)
                sums[slot] = sums[slot] + own if slot in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slot", "counts"])

    rows = materialize(rows.select("t", "y"), "labelled")  # bounded by the sample, read twice
    summed = rows.mapInArrow(tidy(count), "slot int, counts binary").repartition(slots, "slot").mapInArrow(tidy(add), "slot int, counts binary").collect()
    total = np.zeros((2, slots, size // slots), np.int64)
    for r in summed:
        total[:, r["slot"]] += np.frombuffer(r["counts"], np.int64).reshape(2, -1)
    clean, toxic = total.reshape(2, size).astype(np.float64)
    shared = docs.sparkSession.sparkContext.broadcast(feature_scales(toxic, clean).astype(np.float32))  # 4 MB, whatever the corpus

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            y = batch.column(1).to_pylist()
            held += [(found, y[first + i]) for first, points, ends in _chunks(batch.column(0)) for i, found in enumerate(_features(points, ends))]
        model = fit(held, shared.value)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias]), pa.array([model.evidence])], names=["weights", "bias", "evidence"])

    # repeated ids are cut to the bound too; the order makes the fit repeatable; the texts of the bounded sample move, not their features
    chosen = rows.withColumn("h", F.xxhash64("t")).orderBy("h", "t", "y").limit(sample_rows).select("t", "y").repartition(1)
    r = chosen.mapInArrow(tidy(solve), "weights binary, bias double, evidence boolean").first()
    shared.destroy()
    discard(rows)
    return ToxicityModel(np.frombuffer(r["weights"], np.float32), r["bias"], r["evidence"]) if r else fit([], np.zeros(size))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add the score of every whole text; all columns are kept."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() == score_col.lower()])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB, whatever the corpus
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(batch.column(place)))], names=[*batch.schema.names, score_col])

    return whole_texts(docs).mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: score all documents by a model that has not seen the held-out labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
