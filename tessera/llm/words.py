"""Whole-batch word splitting and hashing with numpy.

Words are maximal runs of bytes other than space and 0x09-0x0D. A batch of
texts is one byte buffer; word and n-gram hashes of the whole buffer come from
a handful of vectorised passes, so no Python code runs per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

CHUNK_BYTES = 1 << 20
#: Tables of fewer bytes a core than this are dealt anew if they come in fewer files than there are cores.
SMALL_BYTES = 16 << 20
#: Rows and bytes that a Python worker gets at a time.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_FOLDED = _BYTE.copy()
_BYTE_FOLDED[65:91] = _BYTE[97:123]
_STEPS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, CHUNK_BYTES + 1)
        out = []
        for base in (_BASE, _BASE_INVERSE):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            out.append(np.multiply.accumulate(table))
        _powers[:] = out
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spread(rows: DataFrame) -> DataFrame:
    """Deal the rows of a small table over all cores: a file's row group is never read by several tasks.

    Tables of many files, and large ones, are left as they are read.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(cores) if size < SMALL_BYTES * cores and 0 < len(rows.inputFiles()) < cores else rows


def whole_texts(docs: DataFrame) -> DataFrame:
    """``docs`` for Python stages over whole texts and packed rows: their batches are cut to the bounds above.

    Batches lie outside the heap on both sides, so the session's defaults for short rows cost too much here.
    """
    conf, arrow = docs.sparkSession.conf, "spark.sql.execution.arrow."
    if not 0 < int(conf.get(arrow + "maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set(arrow + "maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set(arrow + "maxBytesPerBatch", f"{BATCH_BYTES}b")
    return spread(docs)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no column of that name."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = "_" + name
    return name


def give_back() -> None:
    """Return freed memory to the system; idle workers would keep it beside the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A Python stage that gives its freed memory back when a task ends."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string array into ``(first_row, row_count, bytes, offsets)``.

    Nulls count as empty texts. A chunk holds whole texts: ``limit`` bytes at
    most, or one longer text.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=n + 1 + texts.offset)[texts.offset :]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end - row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the position of each text's first word (one more entry at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    edge = np.empty(n + 1, dtype=bool)
    edge[0] = edge[n] = True
    edge[1:n] = space[:-1]
    edge[offsets] = True
    solid = ~space
    starts = np.flatnonzero(solid & edge[:n])
    edge[: n - 1] = space[1:]
    edge[n - 1] = True
    inner = offsets[(offsets > 0) & (offsets < n)]
    edge[inner - 1] = True
    ends = np.flatnonzero(solid & edge[:n]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of words; with ``fold`` A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(data))
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((_BYTE_FOLDED if fold else _BYTE)[data] * power[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside texts.

    ``bounds`` gives each text's first word, as from :func:`word_spans`. A text
    with fewer words has its whole sequence as its one gram; one without words
    has none. Returns the hashes in text order and each text's first gram.
    """
    counts = np.diff(bounds)
    grams = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    first = np.concatenate(([0], np.cumsum(grams)))
    out = np.empty(first[-1], dtype=np.uint64)
    if len(words) >= n:
        run = words[: len(words) - n + 1] * _STEPS[0]
        for k in range(1, n):
            run = run + words[k : len(words) - n + 1 + k] * _STEPS[k]
        text = np.repeat(np.arange(len(counts)), grams)
        at = np.arange(first[-1]) - first[text] + bounds[text]
        whole = at < len(run)
        out[whole] = run[at[whole]]
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        own = words[bounds[i] : bounds[i + 1]]
        with np.errstate(over="ignore"):
            out[first[i]] = np.sum(own * _STEPS[: len(own)], dtype=np.uint64) + _STEPS[40 + len(own) % 20]
    return mix(out), first


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges ``starts[i] .. starts[i] + lengths[i] - 1``."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
