"""What the two vector operators share: valid vectors, p-stable codes, sorted groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.words import tidy


def valid_vector(vector: Column) -> Column:
    """Not null or empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def stored_type(df: DataFrame, column: str) -> str:
    """numpy type of a vector column's components."""
    kind = df.schema[column].dataType
    return "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"


def packed(df: DataFrame, column: str, *others: str) -> DataFrame:
    """Replace a valid vector column by its bytes; ``others`` are kept."""
    kind = stored_type(df, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(0)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind)
            ends = np.cumsum([0, *vectors.value_lengths().to_pylist()]).tolist()
            rows = pa.array([flat[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([rows, *batch.columns[1:]], names=["vector", *others])

    numbers = F.col(column) if kind == "<f4" else F.col(column).cast("array<double>")
    schema = T.StructType([T.StructField("vector", T.BinaryType()), *(df.schema[c] for c in others)])
    return df.select(numbers.alias("vector"), *others).mapInArrow(tidy(run), schema)


def matrix(column, kind: str) -> np.ndarray:
    """Rows of packed vectors of one dimension, in double precision."""
    raw = [x.as_buffer() for x in column]
    return np.concatenate([np.frombuffer(x, kind) for x in raw]).reshape(len(raw), -1).astype(np.float64)


class Projections:
    """Tables of quantised Gaussian projections: ``floor((x . a + b) / width)``."""

    def __init__(self, dim: int, tables: int, per_table: int, width: float, seed: int):
        rng = np.random.Generator(np.random.PCG64([seed, dim]))
        self.tables, self.per_table, self.width = tables, per_table, width
        self.axes = rng.standard_normal((dim, tables * per_table))
        self.shift = rng.uniform(0, width, tables * per_table)
        self.weights = rng.integers(1, 2**62, per_table) * 2 + 1
        self.salt = dim

    def places(self, x: np.ndarray) -> np.ndarray:
        """Real-valued positions, ``(rows, tables, per_table)``."""
        return ((x @ self.axes + self.shift) / self.width).reshape(len(x), self.tables, self.per_table)

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """64-bit bucket keys of integer cells along the last axis."""
        with np.errstate(over="ignore"):
            return (cells.astype(np.int64) * self.weights).sum(axis=-1) + self.salt

    def codes(self, x: np.ndarray) -> np.ndarray:
        return self.keys(np.floor(self.places(x)))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows of equal leading columns from a partition sorted by them."""
    parts, current = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if key != current and parts:
                yield pa.Table.from_batches(parts)
                parts = []
            current = key
            parts.append(batch.slice(a, b - a))
    if parts:
        yield pa.Table.from_batches(parts)
