"""Exact Jaccard self-join of 5-word shingle sets, by prefix trees.

1. *Classes.* Each text's set of shingle hashes gets an order-free digest; texts with equal
   sets are one class and take part once. The same pass finds the hot shingles: tasks report what
   :data:`OFTEN` texts of a flush share, and a reported shingle with ``hot`` texts or more is hot.
2. *Global order.* Sorted shingles travel as packed arrays, one per bucket of the hash
   space; a bucket counts in how many classes each of its shingles occurs. Shingles are
   ordered rarest first. Those of one class only cannot match and stay at home. Hot shingles, a bounded list,
   are not counted but stand last in the order, so no bucket holds the texts of one of them. The number of
   buckets follows the shingles of the input.
3. *Prefixes.* Two sets with similarity 0.8 or more share one of their first
   ``n - ceil(0.8 n) + 1`` shingles. A class whose prefix holds only its own
   shingles is done; the others meet in candidate groups, the components of
   "shares a prefix shingle".
4. *Tries.* A candidate group is joined in a trie (:mod:`tessera.llm.trie`). Groups beyond
   ``block`` sets are cut into blocks by their rarest shingle; each block is joined by itself, then one set of
   every block's groups against the others. What is then not yet in the main group of
   its candidates is joined with the blocks that hold a set which shares a prefix shingle with it. That misses no link: each
   pair that can link meets in a trie unless a chain of links joins it already.

Shingles are compared by 56 bits and classes by 64 bits of their hashes.

Null and empty texts, and texts of white space, have no shingles, are linked with
nothing and are their own component. Texts under five words have one shingle. Rows
with a null ``doc_id`` do not choose component ids. Repeated rows are one class and share a component;
an empty table gives no rows. Only the id and the text are read, and columns that are asked to be kept. A text is held
whole by one task, some 60 bytes for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.trie import link_sets
from tessera.llm.vectors import sorted_groups
from tessera.llm.words import gram_hashes, mix, text_chunks, tidy, whole_texts, word_hashes, word_spans
from tessera.operators.components import connected_components
from tessera.storage import discard, materialize

WORDS = 5
#: Shingles that a map task holds before it sends them.
FLUSH = 3 << 20
#: Sets in one trie.
BLOCK = 512
#: Texts of a flush that make a shingle worth a report, and texts that make a reported one hot.
OFTEN, HOT = 8, 1 << 20
#: Shingles of texts a bucket is for, and the least and most bits of a bucket's number.
BUCKET_SHINGLES, BUCKET_BITS = 2 << 20, (4, 14)
#: The count that hot shingles have in the global order.
LAST = (1 << 32) - 1


def distinct_grams(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes (56 bits), sorted, and where each text's begin."""
    starts, ends, bounds = word_spans(data, offsets)
    grams, first = gram_hashes(word_hashes(data, starts, ends), bounds, n)
    grams >>= np.uint64(8)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    order = np.argsort(grams)
    kind = np.uint16 if len(bounds) <= 65536 else np.uint32
    order = order[np.argsort(text[order].astype(kind), kind="stable")]
    grams, text = grams[order], text[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    grams, text = grams[new], text[new]
    return grams, np.searchsorted(text, np.arange(len(bounds)))


def set_digests(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One order-free 64-bit hash for each set."""
    mixed = mix(grams + np.uint64(0x5851F42D4C957F2D))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
    sums = total[first[1:]] - total[first[:-1]]
    return mix(sums + np.diff(first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _classes(often: int, kept: list[str]):
    """Size and class of each text's set, and rows ``gram, texts`` for shingles that many of a flush's sets share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, empty = [], 0, None

        def report() -> pa.RecordBatch:
            grams, texts = np.unique(np.concatenate(held), return_counts=True)
            grams, texts = grams[texts >= often], texts[texts >= often]
            n = len(grams)
            return pa.RecordBatch.from_arrays([
                pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(grams.view(np.int64)), pa.array(texts, pa.int64()), *(pa.nulls(n, c.type) for c in empty),
            ], names=["doc_id", "n_shingles", "class", "gram", "texts", *kept])

        for batch in batches:
            empty = batch.columns[2:]
            for row, count, data, offsets in text_chunks(batch.column(1)):
                grams, first = distinct_grams(data, offsets)
                n = np.diff(first)
                digests = set_digests(grams, first)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, count), pa.array(n, pa.int64()), pa.array(digests.view(np.int64), mask=n == 0),
                    pa.nulls(count, pa.int64()), pa.nulls(count, pa.int64()), *(c.slice(row, count) for c in empty),
                ], names=["doc_id", "n_shingles", "class", "gram", "texts", *kept])
                # equal sets of a chunk count once
                once = np.zeros(count, dtype=bool)
                once[np.unique(digests, return_index=True)[1]] = True
                held.append(grams[np.repeat(once, n)])
                size += len(held[-1])
                if size >= FLUSH:
                    yield report()
                    held, size = [], 0
        if size:
            yield report()

    return run


def _planes(values: np.ndarray, width: int) -> bytes:
    """Little-endian bytes of sorted integers, one plane for each byte: the high planes compress well."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").reshape(-1)


def _postings(bits: int, hot: np.ndarray):
    """Pack each task's ``(shingle, class)`` pairs by bucket; a class counts once in a flush.

    Pairs of hot shingles are packed by the part of their class, as buckets beyond the others.
    """
    parts = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            classes = np.concatenate([c for c, _, _ in held])
            lengths = np.concatenate([n for _, n, _ in held])
            grams = np.concatenate([g for _, _, g in held])
            ids, once = np.unique(classes, return_index=True)
            keep = np.zeros(len(classes), dtype=bool)
            keep[once] = True
            grams = grams[np.repeat(keep, lengths)]
            rank = np.searchsorted(ids, classes[keep])
            own = np.repeat(rank, lengths[keep])
            sizes = np.empty(len(ids), np.int64)
            sizes[rank] = lengths[keep]
            rows: list[list] = [[], [], [], [], []]

            def put(number: int, grams: np.ndarray, own: np.ndarray) -> None:
                used, which = np.unique(own, return_inverse=True)
                for out, x in zip(rows, (number, _planes(grams, 7), _planes(which.astype(np.uint64), 3), ids[used].tobytes(), sizes[used].astype("<u4").tobytes()), strict=True):
                    out.append(x)

            if len(hot):
                common = hot[np.minimum(np.searchsorted(hot, grams), len(hot) - 1)] == grams
                order = np.argsort(own[common], kind="stable")  # ids are sorted, so this is the order of classes
                for part, at in enumerate(np.split(order, np.searchsorted(ids[own[common][order]], parts))):
                    if len(at):
                        put((1 << bits) + part, grams[common][at], own[common][at])
                grams, own = grams[~common], own[~common]
            order = np.argsort(grams)
            grams, own = grams[order], own[order]
            cuts = np.searchsorted(grams, np.arange(1 << bits, dtype=np.uint64) << np.uint64(56 - bits))
            for b, (lo, hi) in enumerate(zip(cuts, [*cuts[1:], len(grams)], strict=True)):
                if lo < hi:
                    put(b, grams[lo:hi], own[lo:hi])
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(x, pa.binary()) for x in rows[1:])], names=["bucket", "grams", "which", "ids", "sizes"])

        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                grams, first = distinct_grams(data, offsets)
                n = np.diff(first)
                held.append((set_digests(grams, first)[n > 0], n[n > 0], grams))
                size += len(grams)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _count(parts: int):
    """In each bucket keep the shingles of two classes or more, and send them to their classes; hot ones go there as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, 1):
            grams, classes, sizes = [], [], []
            for g, w, i, s in zip(*(rows.column(c).to_pylist() for c in range(1, 5)), strict=True):
                which = _unplanes(w, 3)
                grams.append(_unplanes(g, 7))
                classes.append(np.frombuffer(i, np.uint64)[which])
                sizes.append(np.frombuffer(s, "<u4")[which])
            grams, classes, sizes = np.concatenate(grams), np.concatenate(classes), np.concatenate(sizes)
            hot = rows.column(0)[0].as_py() >= parts
            if not hot:
                order = np.argsort(grams)
                grams = grams[order]
                same = grams[1:] == grams[:-1]
                often = np.zeros(len(grams), dtype=bool)
                often[1:] |= same
                often[:-1] |= same
                grams, order = grams[often], order[often]
                classes, sizes = classes[order], sizes[order]
            order = np.lexsort((classes, grams))
            grams, classes, sizes = grams[order], classes[order], sizes[order]
            new = np.ones(len(grams), dtype=bool)
            new[1:] = (grams[1:] != grams[:-1]) | (classes[1:] != classes[:-1])
            grams, classes, sizes = grams[new], classes[new], sizes[new]
            _, which, count = np.unique(grams, return_inverse=True, return_counts=True)
            often = (count[which] > 1) | hot
            grams, classes, sizes, count = grams[often], classes[often], sizes[often], np.where(hot, LAST, count[which][often])
            order = np.argsort(classes, kind="stable")
            grams, classes, sizes, count = grams[order], classes[order], sizes[order], count[order]
            cuts = np.searchsorted(classes, np.arange(1, parts, dtype=np.uint64) * np.uint64((1 << 64) // parts))
            out: list[list] = [[], [], [], [], [], []]
            for part, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(classes)], strict=True)):
                if a < b:
                    ids, first, times = np.unique(classes[a:b], return_index=True, return_counts=True)
                    for o, x in zip(out, (part, ids.tobytes(), sizes[a:b][first].astype("<u4").tobytes(), times.astype("<u4").tobytes(), grams[a:b].tobytes(), count[a:b].astype("<u4").tobytes()), strict=True):
                        o.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["part", "ids", "sizes", "times", "grams", "counts"])

    return run


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Order each class's shared shingles rarest first and keep classes whose prefix has any."""
    for rows in sorted_groups(batches, 1):
        classes, sizes, grams, counts = [], [], [], []
        for i, s, t, g, c in zip(*(rows.column(k).to_pylist() for k in range(1, 6)), strict=True):
            times = np.frombuffer(t, "<u4")
            classes.append(np.repeat(np.frombuffer(i, np.uint64), times))
            sizes.append(np.repeat(np.frombuffer(s, "<u4"), times))
            grams.append(np.frombuffer(g, np.uint64))
            counts.append(np.frombuffer(c, "<u4"))
        classes, sizes, grams, counts = (np.concatenate(x) for x in (classes, sizes, grams, counts))
        order = np.argsort(classes, kind="stable")
        classes, sizes, grams, counts = classes[order], sizes[order], grams[order], counts[order]
        ids, first, shared = np.unique(classes, return_index=True, return_counts=True)
        n = sizes[first].astype(np.int64)
        prefix = n - (80 * n + 99) // 100 + 1 - (n - shared)
        kept = np.flatnonzero(prefix > 0)
        ordered: list[tuple[bytes, bytes]] = []
        for i in kept.tolist():
            a, b = first[i], first[i] + shared[i]
            rank = np.lexsort((grams[a:b], counts[a:b]))
            ordered.append((grams[a:b][rank].tobytes(), counts[a:b][rank].tobytes()))
        yield pa.RecordBatch.from_arrays([
            pa.array(ids[kept].view(np.int64)), pa.array(n[kept]), pa.array(prefix[kept], pa.int32()),
            pa.array([x for x, _ in ordered], pa.binary()), pa.array([x for _, x in ordered], pa.binary()),
        ], names=["class", "n", "prefix", "grams", "counts"])


def _prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            prefix = batch.column(1).to_numpy()
            grams = [np.frombuffer(g.as_buffer(), np.int64, count=p) for g, p in zip(batch.column(2), prefix.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams)), pa.array(np.repeat(batch.column(0).to_numpy(), prefix))], names=["gram", "class"])


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join the sets of each ``(k, block)``; rows are ``k, block, class, n, grams, counts, build``."""
    for rows in sorted_groups(batches, 2):
        classes = rows.column(2).to_numpy()
        if len(classes) < 2:
            continue
        grams = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column(4)]
        counts = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in rows.column(5)])
        flat = np.concatenate(grams)
        order = np.lexsort((flat, counts))
        ordered = flat[order]
        ranks = np.empty(len(flat), np.int64)
        ranks[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        cuts = np.cumsum([len(g) for g in grams])[:-1]
        build = rows.column(6).to_numpy(zero_copy_only=False)
        groups = np.array(link_sets(rows.column(3).to_pylist(), np.split(ranks, cuts), int(ranks.max()) + 1, None if build.all() else build.tolist()))
        least = np.full(len(classes), np.iinfo(np.int64).max)
        np.minimum.at(least, groups, classes)
        moved = least[groups] != classes
        if moved.any():
            yield pa.RecordBatch.from_arrays([pa.array(classes[moved]), pa.array(least[groups][moved])], names=["src", "dst"])


def _run_blocks(rows: DataFrame) -> DataFrame:
    placed = rows.select("k", "block", "class", "n", "grams", "counts", "build").repartition("k", "block").sortWithinPartitions("k", "block")
    return placed.mapInArrow(tidy(_join_blocks), "src long, dst long")


def _blocked(rows: DataFrame, block: int) -> DataFrame:
    """Give rows with ``k`` a ``block`` so that a block has about ``block`` rows at most."""
    cut = rows.groupBy("k").count().select("k", F.ceil(F.col("count") / block).cast("long").alias("blocks"))
    return rows.join(cut, "k").withColumn("block", F.when(F.col("blocks") == 1, 0).otherwise(F.pmod(F.xxhash64("class"), F.col("blocks"))))


def _bucket_bits(shingles: int) -> int:
    """Bits of the hash space's buckets, from the number of shingles, so that a bucket's size stays as the input grows."""
    least, most = BUCKET_BITS
    return min(most, max(least, (shingles // BUCKET_SHINGLES).bit_length()))


def _members(sets: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    """Sets with their candidate group ``k`` and a ``block`` in it; ``blocks`` is 1 for groups of one block.

    Sets with one rarest shingle are of one block, unless they are more than half a block.
    """
    rows = sets.select("class", F.xxhash64(F.substring("grams", 1, 8)).alias("rarest")).join(groups, "class")  # the sets themselves move once
    cut = rows.groupBy("k").count().select("k", F.ceil(F.col("count") / block).cast("long").alias("blocks"))
    often = rows.groupBy("k", "rarest").count().where(F.col("count") > block / 2).withColumnRenamed("count", "alike")
    placed = rows.join(cut, "k").join(often, ["k", "rarest"], "left")
    salt = F.pmod(F.xxhash64("class"), F.ceil(F.col("alike") / block))
    number = F.when(F.col("blocks") == 1, 0).when(F.col("alike").isNull(), F.pmod("rarest", F.col("blocks"))).otherwise(F.xxhash64("rarest", salt))
    return sets.join(placed.select("class", "k", "blocks", number.alias("block")), "class")


def similar_classes(docs: DataFrame, block: int = BLOCK, bucket_bits: int = BUCKET_BITS[0], text_col: str = "text", hot: np.ndarray | None = None) -> DataFrame:
    """Edges ``(src, dst)`` between classes of equal sets whose components are those of the similarity graph.

    ``hot`` are hashes of shingles, in order, that are not to be counted.
    """
    hot = np.zeros(0, np.uint64) if hot is None else hot
    shared_hot = docs.sparkSession.sparkContext.broadcast(hot)
    schema = "bucket int, grams binary, which binary, ids binary, sizes binary"
    buckets = whole_texts(docs).select(F.col(text_col).alias("t")).mapInArrow(tidy(lambda batches: _postings(bucket_bits, shared_hot.value)(batches)), schema)
    parts = 1 << bucket_bits
    shared = (
        buckets.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket")
        .mapInArrow(tidy(_count(parts)), "part int, ids binary, sizes binary, times binary, grams binary, counts binary")
    )
    sets = materialize(
        shared.repartitionById(parts, F.col("part")).sortWithinPartitions("part")
        .mapInArrow(tidy(_candidates), "class long, n long, prefix int, grams binary, counts binary"), "sets"
    )
    prefixes = sets.select("class", "prefix", "grams").mapInArrow(tidy(_prefix_rows), "gram long, class long")
    hubs = prefixes.groupBy("gram").agg(F.min("class").alias("hub"), F.max("class").alias("last")).where("hub < last")
    meets = prefixes.join(hubs, "gram").where("class <> hub").select(F.col("class").alias("src"), F.col("hub").alias("dst"))  # repeats go when the components are made
    groups = connected_components(meets).select(F.col("node").alias("class"), F.col("component").alias("k"))
    members = materialize(_members(sets, groups, block), "members")
    discard(sets)
    links = materialize(_run_blocks(members.withColumn("build", F.lit(True))), "links")
    large = members.where("blocks > 1")
    if large.select("k").isEmpty():
        discard(members)
        return links
    out = links.unionByName(_across_blocks(large, links, block))
    discard(members)
    return out


def _across_blocks(large: DataFrame, links: DataFrame, block: int) -> DataFrame:
    """Edges between the blocks of candidate groups that have several."""
    inside = large.join(links.select(F.col("src").alias("class"), F.col("dst").alias("head")), "class", "left")
    pivots = _blocked(inside.where("head IS NULL").drop("head", "blocks", "block"), block)
    between = materialize(_run_blocks(pivots.withColumn("build", F.lit(True))), "pivots")
    label = connected_components(links.unionByName(between)).select(F.col("node").alias("class"), F.col("component").alias("label"))
    labelled = large.join(label, "class", "left").withColumn("label", F.coalesce("label", "class"))
    counts = labelled.groupBy("k", "label").count()
    main = counts.groupBy("k").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    labelled = materialize(labelled.join(main, "k").withColumn("build", F.col("label") != F.col("main")).drop("label", "main"), "labelled")
    strays = labelled.where("build")
    if strays.select("k").isEmpty():
        discard(labelled)
        return between
    # a stray meets the blocks of its candidate group in which a set shares a prefix shingle with it
    places = labelled.select("class", "prefix", "grams", "k", "block", "build")
    grams = places.select("class", "prefix", "grams").mapInArrow(tidy(_prefix_rows), "gram long, class long").join(places.drop("grams", "prefix"), "class")
    wanted = grams.where("build").select("k", "gram", "class", F.col("block").alias("sb")).join(grams.select("k", "gram", F.col("block").alias("ab")).distinct(), ["k", "gram"])
    wanted = materialize(wanted.select("k", "class", "sb", "ab").distinct(), "meetings")
    code = F.xxhash64("sb", "ab")
    pairs = wanted.select("k", "sb", "ab").distinct()
    built = strays.drop("block").join(wanted.drop("k"), "class").withColumn("block", code)
    # the others of a block, and strays whose own block it is, meet them as probes
    probes = labelled.join(pairs, [labelled["k"] == pairs["k"], labelled["block"] == pairs["ab"]]).drop(pairs["k"])
    probes = probes.where("NOT build OR sb <> ab").withColumn("block", code).withColumn("build", F.lit(False))
    names = ["k", "block", "class", "n", "grams", "counts", "build"]
    found = materialize(_run_blocks(built.select(*names).unionByName(probes.select(*names))), "strays")
    discard(labelled)
    discard(wanted)
    return between.unionByName(found)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, bucket_bits: int | None = None,
    keep: tuple[str, ...] = (), hot: int = HOT, often: int = OFTEN,
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``, and the columns ``keep`` of ``docs``."""
    held = [f"kept_{i}" for i in range(len(keep))]
    named = whole_texts(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"), *[F.col(c).alias(k) for c, k in zip(keep, held, strict=True)])
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in ("doc_id", "n_shingles", "class", "gram", "texts")), *(T.StructField(f.name, f.dataType) for f in named.schema.fields[2:])])
    rows = materialize(named.mapInArrow(tidy(_classes(often, held)), schema), "classes")
    texts = rows.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("texts").alias("texts")).where(F.col("texts") >= hot)
    common = np.array([r["gram"] for r in texts.select("gram").collect()], np.int64)  # at most one for each `hot` shingles of the corpus
    sized = rows.where("gram IS NULL").drop("gram", "texts")
    if bucket_bits is None:
        bucket_bits = _bucket_bits(sized.agg(F.sum("n_shingles")).first()[0] or 0)
    links = similar_classes(docs, block, bucket_bits, text_col, np.sort(common.view(np.uint64)))
    heads = connected_components(links).select(F.col("node").alias("class"), "component")
    least = sized.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"))
    headed = least.join(heads, "class", "left").withColumn("head", F.coalesce("component", "class"))
    best = headed.groupBy("head").agg(F.min("least").alias("component_id"))
    named_class = headed.join(best, "head").select("class", "component_id")
    found = sized.join(named_class, "class", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *[F.col(k).alias(c) for c, k in zip(keep, held, strict=True)])


def ngram_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: components of near-duplicate documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
