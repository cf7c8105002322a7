"""Token-id files: fixed-width bit packing with block offsets.

File format (little endian)::

    magic "TKB1" | u32 width | u32 block | u32 reserved | u64 docs | u64 ids
    i64 doc_id[docs] | u8 doc_is_null[docs, padded to 8] | u64 doc_start[docs + 1]
    u64 block_offset[blocks + 1] | payload

An id takes ``width`` bits, the least that hold the vocabulary. A block packs
``block`` ids (a multiple of 64; 64 ids fill ``width`` whole 64-bit words), the
last block being padded with zeros. ``block_offset`` counts payload bytes, so any
range of ids is read by seeking to its blocks only.

Null and empty texts hold no ids of their own; repeated ``doc_id`` values keep one
entry per row, in the order of a 64-bit hash of their texts, so a run of one id is split over tasks;
a null ``doc_id`` sorts first and comes back as null. An empty table gives no files and no rows. Only
the id and the text are read. Distinct runs of characters are told apart by 64-bit hashes in a worker's cache.
A text is held whole by one task, some 60 bytes for each of its bytes.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.words import text_chunks, tidy, whole_texts
from tessera.llm.wordtokens import word_tokenizer
from tessera.storage import materialize, scratch_path

MAGIC = b"TKB1"
BLOCK_IDS = 4096
#: A file is closed when it holds this many ids.
FILE_IDS = 8 << 20
_HEAD = struct.Struct("<4sIIIQQ")


def bit_width(vocab_size: int) -> int:
    """Bits that hold every id below ``vocab_size``."""
    return max(1, int(vocab_size - 1).bit_length())


def pack_ids(ids: np.ndarray, width: int) -> np.ndarray:
    """Pack ids into ``width`` bits each; returns 64-bit words (a multiple of ``width`` of them)."""
    rows = -(-len(ids) // 64)
    lanes = np.zeros((rows, 64), dtype=np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((rows, width), dtype=np.uint64)
    for lane in range(64):
        word, shift = divmod(lane * width, 64)
        out[:, word] |= lanes[:, lane] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= lanes[:, lane] >> np.uint64(64 - shift)
    return out.reshape(-1)


def unpack_ids(words: np.ndarray, width: int, n: int) -> np.ndarray:
    """The first ``n`` ids of packed words."""
    table = words.reshape(-1, width)
    out = np.empty((len(table), 64), dtype=np.uint32)
    mask = np.uint64((1 << width) - 1)
    for lane in range(64):
        word, shift = divmod(lane * width, 64)
        value = table[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (table[:, word + 1] << np.uint64(64 - shift))
        out[:, lane] = value & mask
    return out.reshape(-1)[:n]


def file_image(doc_ids: list, starts: np.ndarray, ids: np.ndarray, width: int, block: int = BLOCK_IDS) -> bytes:
    """The bytes of one file: ``starts`` holds each document's first id and the end."""
    n = len(doc_ids)
    blocks = -(-len(ids) // block)
    words = [pack_ids(ids[i * block : (i + 1) * block], width) for i in range(blocks)]
    offsets = np.concatenate(([0], np.cumsum([8 * len(w) for w in words]))).astype("<u8")
    null = np.zeros(-(-n // 8) * 8, dtype=np.uint8)
    null[:n] = [d is None for d in doc_ids]
    return b"".join([
        _HEAD.pack(MAGIC, width, block, 0, n, len(ids)),
        np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes(),
        null.tobytes(),
        np.asarray(starts).astype("<u8").tobytes(),
        offsets.tobytes(),
        *(w.astype("<u8").tobytes() for w in words),
    ])


class TokenFile:
    """Random access to one file through a seekable handle."""

    def __init__(self, handle):
        self.handle = handle
        magic, self.width, self.block, _, self.n_docs, self.n_ids = _HEAD.unpack(handle.read(_HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        take = lambda kind, n: np.frombuffer(handle.read(n * np.dtype(kind).itemsize), dtype=kind)
        self.doc_ids = take("<i8", self.n_docs)
        self.null = take("u1", -(-self.n_docs // 8) * 8)[: self.n_docs].astype(bool)
        self.starts = take("<u8", self.n_docs + 1).astype(np.int64)
        self.offsets = take("<u8", -(-self.n_ids // self.block) + 1).astype(np.int64)
        self.payload = handle.tell()

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` (exclusive), from the blocks that hold them."""
        if end <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, -(-end // self.block)
        self.handle.seek(self.payload + int(self.offsets[a]))
        words = np.frombuffer(self.handle.read(int(self.offsets[b] - self.offsets[a])), dtype="<u8")
        return unpack_ids(words, self.width, end - a * self.block)[start - a * self.block :]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and write them to token-id files in ascending ``id_col`` order.

    Texts are range-partitioned and sorted by id and text hash, so each task writes the files of
    one range, each under a temporary name that is moved into place when whole; a
    repeated task writes other names, and only the names in the returned manifest
    count. Returns ``(path, base, n_ids)``: the file, the ids in all files before
    it, and its own ids.
    """
    spark = docs.sparkSession
    path = path.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        fs, root = _filesystem(path)
        tokenizer = word_tokenizer(tokenizer_path)
        width = bit_width(max(tokenizer.vocab_size, end_id + 1))
        doc_ids, lengths, held, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal doc_ids, lengths, held, size, number
            name = f"part-{part:06d}-{number:05d}-{uuid.uuid4().hex}.tkb"
            starts = np.concatenate(([0], np.cumsum(np.concatenate(lengths))))
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(f"{root}/.{name}") as out:
                out.write(file_image(doc_ids, starts, np.concatenate(held), width))
            fs.move(f"{root}/.{name}", f"{root}/{name}")
            row = pa.RecordBatch.from_pydict({"path": [f"{path}/{name}"], "part": [part], "number": [number], "n_ids": [int(starts[-1])]})
            doc_ids, lengths, held, size, number = [], [], [], 0, number + 1
            return row

        for batch in batches:
            own = batch.column(0).to_pylist()
            for row, count, data, offsets in text_chunks(batch.column(1)):
                ids, first = tokenizer.encode(data, offsets)
                doc_ids.extend(own[row : row + count])
                lengths.append(np.diff(first) + 1)
                held.append(np.insert(ids, first[1:], end_id))
                size += len(held[-1])
                if size >= FILE_IDS:
                    yield close()
        if doc_ids:
            yield close()

    named = whole_texts(docs).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    ordered = named.withColumn("h", F.xxhash64("t")).repartitionByRange("i", "h").sortWithinPartitions("i", "h").drop("h")
    files = materialize(ordered.mapInArrow(tidy(write), "path string, part long, number long, n_ids long"), "token-files")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"), "n_ids")


def read_token_files(files: DataFrame) -> DataFrame:
    """Read files back: one row per document with ``doc_id, start, n_tokens, ids_crc32``.

    A task reads a file's documents in groups of about a million ids.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = _filesystem(uri)
                with fs.open_input_file(name) as handle:
                    tokens = TokenFile(handle)
                    i = 0
                    while i < tokens.n_docs:
                        j = int(np.searchsorted(tokens.starts, tokens.starts[i] + (1 << 20), side="right")) - 1
                        j = min(max(j, i + 1), tokens.n_docs)
                        starts = tokens.starts[i : j + 1]
                        raw = memoryview(tokens.ids(int(starts[0]), int(starts[-1])).astype("<u4").tobytes())
                        at = ((starts - starts[0]) * 4).tolist()
                        yield pa.RecordBatch.from_arrays([
                            pa.array(tokens.doc_ids[i:j], pa.int64(), mask=tokens.null[i:j]),
                            pa.array(starts[:-1] + base, pa.int64()),
                            pa.array(np.diff(starts), pa.int64()),
                            pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.int64()),
                        ], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        i = j

    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = files.select("path", "base").repartition(tasks, "path")
    return spread.mapInArrow(tidy(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: encode all documents, write them, and report what the files hold."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = public_tokenizers.path("word_bpe_49k.json")
    return read_token_files(write_token_files(docs, scratch_path(spark, "tkb"), path, end_id=2))
