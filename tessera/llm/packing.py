"""Best-fit packing by minimum bin slack over the histogram of lengths.

Pieces of one length are interchangeable, so the plan needs only the number of
pieces of each length: at most ``capacity`` counts, however large the corpus. For
each bin the largest remaining length is placed, and a bitset subset-sum (one
big integer, bit ``s`` set when the sum ``s`` is reachable) over the remaining
lengths finds the fullest combination for the rest. The combination is removed
as often as the counts allow. Pieces then find their place from their
length and their rank among pieces of that length.

Null and empty texts are one piece, the end id alone. Rows that repeat a
``doc_id`` are packed as documents of their own, and so are rows without an id. An empty table gives
no rows. Only the id and the text are read. Distinct runs of characters are told apart by 64-bit hashes in a
worker's cache. A text is held whole by one task, some 60 bytes for each of its bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.words import text_chunks, tidy, whole_texts
from tessera.llm.wordtokens import word_tokenizer
from tessera.storage import materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, place long"


def fullest_combination(lengths: list[int], counts: list[int], room: int) -> list[tuple[int, int]]:
    """A multiset of the lengths with the largest sum of at most ``room``.

    ``lengths`` descend; of equal sums the one that uses larger lengths wins.
    Returns ``(index, times)`` pairs.
    """
    mask = (1 << (room + 1)) - 1
    reach, layers = 1, []
    for length, count in zip(lengths, counts, strict=True):
        layers.append(reach)
        left, step = min(count, room // length), 1
        while left:
            take = min(step, left)
            reach |= (reach << (take * length)) & mask
            left -= take
            step <<= 1
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    out = []
    for i in range(len(layers) - 1, -1, -1):
        times = 0
        while not layers[i] >> total & 1:
            total -= lengths[i]
            times += 1
        if times:
            out.append((i, times))
    return out


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """``(repeat, [(length, times), ...])`` patterns that use every piece once."""
    left = dict(histogram)
    order = sorted(left, reverse=True)
    plan = []
    while order:
        top = order[0]
        left[top] -= 1
        usable = [x for x in order if left[x] and x <= capacity - top]
        extra = [(usable[i], t) for i, t in fullest_combination(usable, [left[x] for x in usable], capacity - top)] if usable else []
        left[top] += 1
        pattern: dict[int, int] = {top: 1}
        for length, times in extra:
            pattern[length] = pattern.get(length, 0) + times
        repeat = min(left[x] // t for x, t in pattern.items())
        plan.append((repeat, sorted(pattern.items(), reverse=True)))
        for x, t in pattern.items():
            left[x] -= repeat * t
        order = [x for x in order if left[x]]
    return plan


def plan_table(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length rows of ``(first rank, times, first sequence, offset)``, by rank."""
    used: dict[int, int] = {}
    rows: dict[int, list] = {}
    sequence = 0
    for repeat, pattern in plan:
        offset = 0
        for length, times in pattern:
            rank = used.get(length, 0)
            rows.setdefault(length, []).append((rank, times, sequence, offset))
            used[length] = rank + repeat * times
            offset += length * times
        sequence += repeat
    return {length: np.array(x, dtype=np.int64) for length, x in rows.items()}


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts, close each with ``end_id`` and cut the longer ones at ``capacity``.

    Returns :data:`PIECES`: ``part`` is the task that cut the piece and ``place``
    the piece's rank among that task's pieces of its length.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tokenizer = word_tokenizer(tokenizer_path)
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            own = batch.column(0)
            for row, count, data, offsets in text_chunks(batch.column(1)):
                ids, first = tokenizer.encode(data, offsets)
                ids = np.insert(ids, first[1:], end_id)
                first = first + np.arange(count + 1)
                n = np.diff(first)
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(count), pieces)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * capacity
                length = np.minimum(n[doc] - start, capacity)
                raw = memoryview(ids.astype("<u4").tobytes())
                at = (first[doc] + start) * 4
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                place = np.empty(len(doc), dtype=np.int64)
                place[order] = np.arange(len(doc)) - np.searchsorted(ranked, ranked)
                place += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays([
                    own.slice(row, count).take(pa.array(doc)).cast(pa.int64()),
                    pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                    pa.array([zlib.crc32(raw[a : a + 4 * k]) for a, k in zip(at.tolist(), length.tolist(), strict=True)], pa.int64()),
                    pa.array(np.full(len(doc), part), pa.int64()), pa.array(place, pa.int64()),
                ], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"])

    return whole_texts(docs).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(tidy(cut), PIECES)


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to written pieces with ``length, part, place``.

    The driver sees one count per length (at most ``capacity`` of them) and makes
    the plan; the plan's table is bounded by the number of lengths too. Ranks
    among equal lengths come from per-task counts, so no length, however common,
    is gathered in one task.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("part", "length").count()
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    table = plan_table(plan_bins(total, capacity))
    shared = spark.sparkContext.broadcast(table)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(firsts, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("place")).alias("rank"))

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                rows = plan[int(length[group[0]])]
                use = rows[np.searchsorted(rows[:, 0], rank[group], side="right") - 1]
                at, times = rank[group] - use[:, 0], use[:, 1]
                sequence[group] = use[:, 2] + at // times
                offset[group] = use[:, 3] + at % times * length[group]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(tidy(seat), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Cut whole documents and pack the pieces into sequences of ``capacity`` tokens."""
    return pack_pieces(materialize(cut_pieces(docs, tokenizer_path, end_id, capacity), "pieces"), capacity)


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: pack all documents into sequences of at most 2048 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
