"""Repeated passages across documents, by sparse suffix arrays.

A passage of :data:`PASSAGE` words or more that also occurs in another document is
found whole, word for word (A-Z folded), by sorting few suffixes:

1. *Selection.* In every window of ``PASSAGE`` words the run of :data:`RUN` words with the
   smallest hash is selected. The choice depends on content only, so equal windows
   select the same place. About one word in twenty is selected; only these suffixes
   are kept.
2. *Sorting.* A selected run that occurs once cannot be part of a repeat and is dropped, most
   by a bitmap that all tasks hold, the rest by a join. The bitmap has :data:`BITS_A_RUN` bits for each repeated
   run, 2**28 (32 MB) at most; beyond that it lets more runs through to the join.
   The others carry the words around them, enough for every window that selected
   them. Rows with equal surroundings are merged, by map tasks first, to the smallest
   document and whether there are several. Suffixes are sorted, and neighbours give
   the lengths of common beginnings; the words before are sorted the same way from right to left.
3. *Extension.* A window reaches ``o`` words to the left of its selected place and
   the rest to the right. Two windows are equal when neighbours in the right order share the rest and
   neighbours in the left order share ``o`` words, so equal windows are runs in both
   orders at once. This finds each repeated window, not only the best neighbour's.
4. Windows become spans of words. A window is removed where a smaller ``doc_id`` has it too
   and kept where its document is the first.

Groups of one run with more than :data:`HOT` different surroundings skip the sort: each
window's hash meets its equals in an aggregation that Spark can combine in map
tasks, with the same result.

Null and empty texts and texts under ``PASSAGE`` words have no spans. Passages that repeat
only inside one document are left alone, as are rows that share one ``doc_id``, whatever their texts; rows
with a null ``doc_id`` take no part. Spans belong to an id and a text, so rows that repeat an id with
other texts have spans of their own. Words are compared by 32 bits of their hashes at 50
places or more in a row. Empty tables give no rows; only the id and the text are read. A text is held whole by one
task, some 60 bytes for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.vectors import sorted_groups
from tessera.llm.words import fresh, gram_hashes, text_chunks, tidy, whole_texts, word_hashes, word_spans
from tessera.storage import discard, materialize

PASSAGE = 50
RUN = 8
#: Words that surround a selected place in any of its windows.
BEFORE = PASSAGE - RUN
HOT = 20_000
#: Places whose surroundings are built at a time.
PLACES = 2048
#: Bits of the map for each repeated run, and the least and most bits of a place in the map.
BITS_A_RUN, MAP_BITS = 32, (20, 28)


def selected_places(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of smallest runs, their hashes, and the first and last window that selected each.

    Positions count words of the whole buffer. Windows are inside texts of ``PASSAGE`` words or more.
    """
    long = np.flatnonzero(np.diff(bounds) >= PASSAGE)
    runs, first = gram_hashes(words, bounds, RUN)
    span = PASSAGE - RUN + 1
    if not len(long):
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none
    # smallest of each `span` neighbouring runs, by doubling; the leftmost wins ties
    value, place = runs, np.arange(len(runs))
    width = 1
    while width < span:
        step = min(width, span - width)
        m = len(value) - step
        if m <= 0:
            break
        right = value[step:] < value[:m]
        value, place = np.where(right, value[step:], value[:m]), np.where(right, place[step:], place[:m])
        width += step
    count = np.diff(bounds)[long] - PASSAGE + 1
    before = np.cumsum(count) - count
    at = np.repeat(first[long] - before, count) + np.arange(int(count.sum()))
    window = np.repeat(bounds[long] - before, count) + np.arange(int(count.sum()))
    chosen = place[at]
    owner = np.repeat(long, count)
    chosen_word = chosen - first[owner] + bounds[owner]
    new = np.concatenate(([True], chosen[1:] != chosen[:-1]))
    head = np.flatnonzero(new)
    tail = np.concatenate((head[1:], [len(chosen)])) - 1
    return chosen_word[head], runs[chosen[head]], window[head], window[tail]


def _text_places(column: pa.Array):
    for row, count, data, offsets in text_chunks(column):
        starts, ends, bounds = word_spans(data, offsets)
        words = word_hashes(data, starts, ends)
        place, run, first, last = selected_places(words, bounds)
        text = np.searchsorted(bounds, place, side="right") - 1
        yield row, words, bounds, text, place, run, first, last


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct run hashes of a batch, and whether several documents have each."""
    for batch in batches:
        own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        runs, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for row, _, _, text, _, run, _, _ in _text_places(batch.column(1)):
            runs.append(run)
            docs.append(own[row + text])
        run, doc = np.concatenate(runs), np.concatenate(docs)
        order = np.argsort(run)
        run, doc = run[order], doc[order]
        head = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1]))) if len(run) else np.zeros(0, np.int64)
        if len(head):
            yield pa.RecordBatch.from_arrays([pa.array(run[head].view(np.int64)), pa.array(np.minimum.reduceat(doc, head)), pa.array(np.maximum.reduceat(doc, head))], names=["run", "low", "high"])


def _run_map(shared: DataFrame) -> np.ndarray:
    """A bitmap with a bit set for every run of ``shared``; other runs' bits may be set too.

    Runs are the smallest hashes of their windows, so it is their low bits that are evenly spread.
    """
    least, most = MAP_BITS
    bits = min(most, max(least, (BITS_A_RUN * shared.count()).bit_length()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, np.ndarray] = {}
        for batch in batches:
            bit = batch.column(0).to_numpy() & ((1 << bits) - 1)
            for slot in np.unique(bit & 7).tolist():
                slices.setdefault(slot, np.zeros(1 << (bits - 3), dtype=bool))[bit[bit & 7 == slot] >> 3] = True
        for slot, own in slices.items():
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], names=["slot", "bits"])

    out = np.zeros((8, 1 << (bits - 6)), np.uint8)
    for r in shared.repartitionById(8, F.col("run").bitwiseAND(7).cast("int")).mapInArrow(tidy(build), "slot int, bits binary").collect():
        out[r["slot"]] |= np.frombuffer(r["bits"], np.uint8)
    return out


def _surroundings(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Selected places whose run may repeat, with the words around them: zeros stand for what is outside the text."""
    mask = bits.size * 8 - 1
    for batch in batches:
        own, key = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 2))
        for row, words, bounds, *found in _text_places(batch.column(1)):
            bit = (found[2] & np.uint64(mask)).astype(np.int64)
            marked = bits[bit & 7, bit >> 6] >> (7 - (bit >> 3 & 7)).astype(np.uint8) & 1 > 0
            text, place, run, first, last = (x[marked] for x in found)
            short = np.maximum((words >> np.uint64(32)).astype(np.uint32), 1)
            for a in range(0, len(place), PLACES):
                at = place[a : a + PLACES]
                span = at[:, None] + np.arange(-BEFORE, PASSAGE)
                doc = text[a : a + PLACES]
                inside = (span >= first[a : a + PLACES, None]) & (span < last[a : a + PLACES, None] + PASSAGE)
                around = np.where(inside, short[np.clip(span, 0, len(short) - 1)], 0).astype(">u4")
                raw = around.tobytes()
                step = 4 * (BEFORE + PASSAGE)
                yield pa.RecordBatch.from_arrays([
                    pa.array(run[a : a + PLACES].view(np.int64)), pa.array(own[row + doc]), pa.array(key[row + doc]), pa.array((at - bounds[doc]).astype(np.int32)),
                    pa.array([raw[i * step : (i + 1) * step] for i in range(len(at))], pa.binary()),
                ], names=["run", "doc", "text_key", "place", "around"])


def _common(rows: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """For sorted rows, the number of equal leading words with the row before (0 across ``breaks``)."""
    out = np.zeros(len(rows), np.int64)
    same = (rows[1:] == rows[:-1]) & (rows[1:] != 0)
    out[1:] = np.where(same.all(axis=1), rows.shape[1], np.argmin(same, axis=1))
    out[breaks] = 0
    return out


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of the runs in a partition; rows are ``run, around, low, high``."""
    held, size = [], 0
    for group in sorted_groups(batches, 1):
        if group.num_rows > 1 or group.column(2)[0].as_py() < group.column(3)[0].as_py():
            held.append(group)
            size += group.num_rows
        if size >= 50_000:
            yield _repeated(pa.concat_tables(held))
            held, size = [], 0
    if held:
        yield _repeated(pa.concat_tables(held))


def _repeated(rows: pa.Table) -> pa.RecordBatch:
    """``run, around, ranges``: windows that several documents have, with the smallest of them.

    A window is named by its offset, the number of its words before the selected place.
    """
    run = rows.column(0).to_numpy()
    low, high = rows.column(2).to_numpy(), rows.column(3).to_numpy()
    around = np.frombuffer(b"".join(rows.column(1).to_pylist()), ">u4").reshape(len(run), -1)
    right, left = around[:, BEFORE:], around[:, BEFORE - 1 :: -1]
    orders, common = [], []
    for side in (right, left):
        key = np.ascontiguousarray(np.concatenate((run.view(np.uint64).astype(">u8").view(">u4").reshape(-1, 2), side), axis=1))
        order = np.argsort(key.view(f"V{key.shape[1] * 4}").reshape(-1), kind="stable")
        ranked = run[order]
        orders.append(order)
        common.append(_common(side[order], np.concatenate(([True], ranked[1:] != ranked[:-1]))))
    rows_out, offset_out, low_out = [], [], []
    before_known = (left != 0).cumprod(axis=1).sum(axis=1)
    after_known = (right != 0).cumprod(axis=1).sum(axis=1)
    for offset in range(BEFORE + 1):
        has = (before_known >= offset) & (after_known >= PASSAGE - offset)
        if not has.any():
            continue
        names = []
        for order, share, depth in ((orders[0], common[0], PASSAGE - offset), (orders[1], common[1], offset)):
            # a row opens a new class where it shares less than `depth` words with the row before, or the run changes
            ranked = run[order]
            opens = share < depth
            opens[0] = True
            opens[1:] |= ranked[1:] != ranked[:-1]
            name = np.empty(len(run), np.int64)
            name[order] = np.cumsum(opens)
            names.append(name)
        at = np.flatnonzero(has)
        key = names[0][at] * (len(run) + 1) + names[1][at]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        least, most = np.minimum.reduceat(low[at], head), np.maximum.reduceat(high[at], head)
        several = np.repeat(least < most, np.diff(np.append(head, len(at))))
        rows_out.append(at[several])
        offset_out.append(np.full(int(several.sum()), offset))
        low_out.append(np.repeat(least, np.diff(np.append(head, len(at))))[several])
    index = np.concatenate([np.zeros(0, np.int64), *rows_out])
    offsets, lows = np.concatenate([np.zeros(0, np.int64), *offset_out]), np.concatenate([np.zeros(0, np.int64), *low_out])
    order = np.lexsort((offsets, index))
    index, offsets, lows = index[order], offsets[order], lows[order]
    # neighbouring offsets with one first document are a range
    opens = np.ones(len(index), dtype=bool)
    opens[1:] = (index[1:] != index[:-1]) | (offsets[1:] != offsets[:-1] + 1) | (lows[1:] != lows[:-1])
    head = np.flatnonzero(opens)
    tail = np.append(head[1:], len(index)) - 1 if len(head) else head
    ids, first = np.unique(index[head], return_index=True)
    ranges = pa.StructArray.from_arrays([pa.array(offsets[head], pa.int32()), pa.array(offsets[tail], pa.int32()), pa.array(lows[head], pa.int64())], names=["low_offset", "high_offset", "low"])
    picked = rows.take(pa.array(ids))
    return pa.RecordBatch.from_arrays([
        picked.column(0).combine_chunks(), picked.column(1).combine_chunks(), pa.ListArray.from_arrays(pa.array(np.append(first, len(head)), pa.int32()), ranges),
    ], names=["run", "around", "ranges"])


REPEATS = "run long, around binary, ranges array<struct<low_offset:int,high_offset:int,low:long>>"


def _hot_repeats(hot: DataFrame) -> DataFrame:
    """The same for runs with very many surroundings, by equal windows instead of sorted neighbours."""

    def window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                around = np.frombuffer(b"".join(part.column(1).to_pylist()), ">u4").reshape(part.num_rows, -1)
                for offset in range(BEFORE + 1):
                    cut = np.ascontiguousarray(around[:, BEFORE - offset : BEFORE - offset + PASSAGE])
                    has = np.flatnonzero((cut != 0).all(axis=1))
                    if len(has):
                        own = part.take(pa.array(has))
                        yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), own.column(3), pa.array(np.full(len(has), offset), pa.int32()), pa.array([cut[k].tobytes() for k in has], pa.binary())], names=["run", "around", "low", "high", "offset", "window"])

    each = hot.mapInArrow(tidy(window), "run long, around binary, low long, high long, offset int, window binary")
    each = each.select("run", "around", "low", "high", "offset", F.sha2("window", 256).alias("window"))
    keys = ["run", "offset", "window"]
    equal = each.groupBy(*keys).agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most")
    met = each.join(equal, keys).groupBy("run", "around")  # at most one entry an offset
    entry = F.struct(F.col("offset").alias("low_offset"), F.col("offset").alias("high_offset"), F.col("least").alias("low"))
    return met.agg(F.collect_list(entry).alias("ranges"))


def _repeated_places(docs: DataFrame, id_col: str, text_col: str, hot: int) -> DataFrame:
    """``doc, text_key, place, ranges`` for every selected place that has repeated windows."""
    named = whole_texts(docs).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("t"), text_key(text_col).alias("text_key")).where("doc IS NOT NULL")
    runs = named.mapInArrow(tidy(_runs), "run long, low long, high long").groupBy("run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    shared = materialize(runs.where("low < high").select("run"), "runs")
    bits = docs.sparkSession.sparkContext.broadcast(_run_map(shared))  # 32 MB at most
    around = named.mapInArrow(tidy(lambda batches: _surroundings(batches, bits.value)), "run long, doc long, text_key long, place int, around binary")
    places = materialize(around.join(shared, "run", "left_semi"), "places")
    discard(shared)
    merged = materialize(places.groupBy("run", "around").agg(F.min("doc").alias("low"), F.max("doc").alias("high")), "surroundings")
    large = materialize(merged.groupBy("run").count().where(F.col("count") > hot).select("run"), "hot-runs")
    usual = merged.join(large, "run", "left_anti").select("run", "around", "low", "high").repartition("run").sortWithinPartitions("run")
    found = usual.mapInArrow(tidy(_repeats), REPEATS)
    if not large.isEmpty():
        found = found.unionByName(_hot_repeats(merged.join(large, "run", "left_semi").select("run", "around", "low", "high")))
    return places.join(found, ["run", "around"]).select("doc", "text_key", "place", "ranges")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """``doc_id, text_key, start, low``: every repeated window by its first word, and the smallest document that has it."""
    each = _repeated_places(docs, id_col, text_col, hot).select("doc", "text_key", "place", F.explode("ranges").alias("r"))
    each = each.select("doc", "text_key", "place", "r.low", F.explode(F.sequence("r.low_offset", "r.high_offset")).alias("offset"))
    return each.select(F.col("doc").alias("doc_id"), "text_key", (F.col("place") - F.col("offset")).alias("start"), "low")


def _merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unite each document's overlapping or touching spans."""

    def union(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
        out: list[dict[str, int]] = []
        for start, end in sorted(spans):
            if out and start <= out[-1]["end"]:
                out[-1]["end"] = max(out[-1]["end"], end)
            else:
                out.append({"start": start, "end": end})
        return out

    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        removed, kept, firsts = [], [], []
        for doc, spans in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            removed.append(union([(s["start"], s["end"]) for s in spans if s["low"] < doc]))
            kept.append(union([(s["start"], s["end"]) for s in spans if s["low"] >= doc]))
            firsts.append(sorted({s["low"] for s in spans if s["low"] < doc}))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, span), pa.array(kept, span), pa.array(firsts, pa.list_(pa.int64()))], names=["doc_id", "text_key", "removed", "kept", "first_doc_ids"])


def text_key(text_col: str):
    """What tells the texts of rows with one id apart."""
    return F.xxhash64(F.col(text_col))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per document and text with repeats: ``doc_id, text_key, removed, kept, first_doc_ids``.

    ``removed`` and ``kept`` are arrays of ``(start, end)`` in words: maximal unions of
    windows that a smaller document has, and of those it has first.
    ``first_doc_ids`` lists the smaller documents.
    """
    spans = F.transform("ranges", lambda r: F.struct((F.col("place") - r["high_offset"]).alias("start"), (F.col("place") - r["low_offset"] + PASSAGE).alias("end"), r["low"].alias("low")))
    found = _repeated_places(docs, id_col, text_col, hot)
    lists = found.groupBy("doc", "text_key").agg(F.flatten(F.collect_set(spans)).alias("spans"))  # one text's spans
    schema = "doc_id long, text_key long, removed array<struct<start:int,end:int>>, kept array<struct<start:int,end:int>>, first_doc_ids array<long>"
    return lists.select("doc", "text_key", "spans").mapInArrow(tidy(_merge_spans), schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Cut removed spans out of texts; all rows and columns are kept.

    Between what is left, the white space before the span stays. A text without repeats, and a null one, is unchanged.
    """
    own_spans, own_doc, own_key = (fresh(docs, c) for c in ("_spans", "_span_doc", "_span_text"))
    spans = repeated_spans(docs, id_col, text_col, hot).where(F.size("removed") > 0)
    spans = spans.select(F.col("doc_id").alias(own_doc), F.col("text_key").alias(own_key), F.col("removed").alias(own_spans))
    names, place = docs.columns, docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for i, own in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if own:
                    raw = texts[i].encode()
                    starts, _, _ = word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                    out, at = [], 0
                    for s in own:
                        out.append(raw[at : starts[s["start"]]])
                        at = int(starts[s["end"]]) if s["end"] < len(starts) else len(raw)
                    texts[i] = b"".join([*out, raw[at:]]).decode()
            columns = [pa.array(texts, batch.column(k).type) if k == place else c for k, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    same = (F.col(id_col).cast("long") == F.col(own_doc)) & (text_key(text_col) == F.col(own_key))
    return docs.join(spans, same, "left").select(*[docs[c] for c in names], own_spans).mapInArrow(tidy(cut), docs.schema)


def suffix_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: spans of passages that several documents share."""
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
