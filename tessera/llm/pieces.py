"""Best and N-best segmentation into the pieces of a SentencePiece model file, and decoding.

A text is a lattice: an edge for every piece at every place, scored by the file. Runs of spaces
begin pieces and never stand inside one, and nothing joins a line feed, so the
lattice falls apart into short chunks. Distinct chunks are solved in batches by
forward and backward Viterbi passes over all spans at once; what the best chunk path
loses to its runner-up is its gap. Chunks beyond :data:`LONG` characters (unspaced text)
are solved by themselves, in time linear in their length.

The N best segmentations of a text differ from the best in its ``N - 1`` chunks with
the smallest gaps at most. Only these go through the search: from the end of the chunk
backwards, with the forward Viterbi scores as an exact estimate of what is left, so
complete paths come off the heap in order of their scores. The estimate being exact, every open path
stands for one complete path, so no more than N need be open.

Characters without a piece are one edge of their UTF-8 byte pieces, scored 10 below the
least usual piece. A space stands before each text; null and empty texts have no pieces. Equal
scores keep the order in which the search meets them. Rows with a null id and repeated rows are encoded one by one; an empty
table gives no rows; only the id and the text are read. A space and a literal U+2581 have one piece, which decodes to a
space: such texts say so by ``round_trip``. Chunks are told apart by 64-bit hashes in a worker's cache. A text is held
whole by one task, some 100 bytes for each of its bytes, more for long unspaced stretches.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.words import ragged, text_chunks, tidy, whole_texts, word_hashes

SPACE = 0x2581
N_BEST = 3
#: Ids from here on stand for a character in byte pieces.
AS_BYTES = 1 << 22
#: Characters of a chunk that is solved by itself, and of a stretch of it that is held as Python objects.
LONG, SLAB = 64, 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)


class HashTable:
    """A fixed hash table of integers with linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(2 * len(keys) + 1).bit_length())
        self.mask = size - 1
        self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size, np.float32)
        slot, self.steps = self._slot(keys), 0
        while len(keys):
            self.steps += 1
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.ones(len(keys), dtype=bool)
            left[put] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def find(self, keys: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
        out, slot, at = otherwise.copy(), self._slot(keys), np.arange(len(keys))
        for _ in range(self.steps):
            held = self.keys[slot]
            hit = held == keys
            out[at[hit]] = self.values[slot[hit]]
            go = ~hit & (held >= 0)
            if not go.any():
                break
            keys, slot, at = keys[go], (slot[go] + 1) & self.mask, at[go]
        return out


def _mixed(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(2)).view(np.int64)


def _point_hash(total: np.ndarray, power: np.ndarray, i: int, j: int) -> np.ndarray:
    return _mixed(total[:, j] - total[:, i] * power[j - i])


def _totals(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, size = points.shape
    total, power = np.zeros((n, size + 1), np.uint64), np.ones(size + 1, np.uint64)
    for k in range(size):
        total[:, k + 1] = total[:, k] * _BASE + points[:, k].astype(np.uint64) + np.uint64(1)
        np.multiply(power[k : k + 1], _BASE, out=power[k + 1 : k + 2])
    return total, power


class PieceModel:
    """Pieces and scores of a model file, with a bounded cache of solved chunks."""

    def __init__(self, path: str, max_chunks: int = 1_000_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.texts: dict[str, int] = {}
        self.bytes = [b""] * model.get_piece_size()
        self.byte_id = np.zeros(256, np.int64)
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.texts[piece] = i
                self.bytes[i] = piece.replace(chr(SPACE), " ").encode()
        self.score = np.array([model.get_score(i) for i in range(len(self.bytes))])
        usual = self.score[list(self.texts.values())]
        self.byte_score = float(usual[usual > -1e8].min()) - 10
        self.longest = max(map(len, self.texts))
        hashes = []
        for text in self.texts:
            points = np.array([list(map(ord, text))], np.uint32)
            hashes.append(_point_hash(*_totals(points), 0, len(text))[0])
        self.table = HashTable(np.array(hashes), np.array(list(self.texts.values()), np.float32))
        self.piece_size = np.array([len(b) for b in self.bytes])
        self.piece_at = np.cumsum(self.piece_size) - self.piece_size
        self.piece_pool = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.max_chunks = max_chunks
        self.searched: dict[tuple[str, int], list] = {}
        self._reset()

    def _reset(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.best, self.gap = np.zeros(0), np.zeros(0)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def _solve(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best score, gap, and padded best ids (with their number) of chunks of one length."""
        n, size = points.shape
        total, power = _totals(points)
        span = min(size, self.longest)
        edge = np.full((n, size, span), -1, np.int32)
        places = [(i, length) for length in range(1, span + 1) for i in range(size - length + 1)]
        keys = np.empty((len(places), n), np.int64)
        for k, (i, length) in enumerate(places):
            keys[k] = _point_hash(total, power, i, i + length)
        found = self.table.find(keys.reshape(-1), np.full(keys.size, -1, np.float32)).reshape(keys.shape)
        for k, (i, length) in enumerate(places):
            edge[:, i, length - 1] = found[k]
        lone = edge[:, :, 0] < 0
        edge[:, :, 0][lone] = AS_BYTES + points[lone].astype(np.int32)
        score = np.where(edge < 0, -np.inf, np.where(edge >= AS_BYTES, self.byte_score, self.score[np.where(edge < AS_BYTES, edge, 0)]))
        forward, step = np.full((n, size + 1), -np.inf), np.zeros((n, size + 1), np.int64)
        forward[:, 0] = 0
        for j in range(1, size + 1):
            for length in range(1, min(j, span) + 1):
                value = forward[:, j - length] + score[:, j - length, length - 1]
                better = value > forward[:, j]
                forward[better, j], step[better, j] = value[better], length
        backward = np.full((n, size + 1), -np.inf)
        backward[:, size] = 0
        for i in range(size - 1, -1, -1):
            for length in range(1, min(size - i, span) + 1):
                np.maximum(backward[:, i], score[:, i, length - 1] + backward[:, i + length], out=backward[:, i])
        rows, at, count = np.arange(n), np.full(n, size), np.zeros(n, np.int64)
        ids, through = np.full((n, size), -1, np.int32), score.copy()
        for k in range(size):
            go = at > 0
            if not go.any():
                break
            r = rows[go]
            length = step[r, at[go]]
            begin = at[go] - length
            ids[r, k] = edge[r, begin, length - 1]
            through[r, begin, length - 1] = -np.inf
            at[go], count[go] = begin, count[go] + 1
        other = np.full(n, -np.inf)
        for length in range(1, span + 1):
            m = size - length + 1
            np.maximum(other, (forward[:, :m] + through[:, :m, length - 1] + backward[:, length:]).max(axis=1), out=other)
        back = np.take_along_axis(ids, np.maximum(count[:, None] - 1 - np.arange(size), 0), axis=1)
        return forward[:, size], forward[:, size] - other, back, count

    def _edges(self, points: np.ndarray) -> tuple[np.ndarray, ...]:
        """All edges of one long chunk by their ends: each end's first edge (one more at the end), and beginnings, pieces and scores."""
        size, value = len(points), points.astype(np.uint64) + np.uint64(1)
        begin, end, piece = [], [], []
        h = np.zeros(size, np.uint64)
        for length in range(1, min(size, self.longest) + 1):
            h = h[: size - length + 1] * _BASE + value[length - 1 :]
            found = self.table.find(_mixed(h), np.full(len(h), -1, np.float32)).astype(np.int32)
            if length == 1:
                found = np.where(found < 0, AS_BYTES + points.astype(np.int32), found)
            hit = np.flatnonzero(found >= 0)
            begin.append(hit.astype(np.int32))
            end.append((hit + length).astype(np.int32))
            piece.append(found[hit])
        begin, end, piece = np.concatenate(begin), np.concatenate(end), np.concatenate(piece)
        order = np.argsort(end, kind="stable")
        begin, end, piece = begin[order], end[order], piece[order]
        score = np.where(piece >= AS_BYTES, self.byte_score, self.score[np.where(piece < AS_BYTES, piece, 0)])
        return np.searchsorted(end, np.arange(size + 2)), begin, piece, score

    def _best_into(self, first: np.ndarray, begin: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best score of each place of a long chunk from its beginning, and the edge that gives it."""
        size = len(first) - 2
        best, step = np.zeros(size + 1), np.zeros(size + 1, np.int32)
        for low in range(0, size, SLAB):
            high, back = min(low + SLAB, size), max(0, low - self.longest)
            near, edge = best[back : low + 1].tolist(), []
            a = int(first[low + 1])
            begins, scores = (begin[a : first[high + 1]] - back).tolist(), score[a : first[high + 1]].tolist()
            cuts = (first[low + 1 : high + 2] - a).tolist()
            for x, y in zip(cuts, cuts[1:], strict=False):
                top, at = max((near[begins[e]] + scores[e], -e) for e in range(x, y))
                near.append(top)
                edge.append(a - at)
            best[low + 1 : high + 1], step[low + 1 : high + 1] = near[low + 1 - back :], edge
        return best, step

    def _solve_long(self, points: np.ndarray) -> tuple[float, float, np.ndarray]:
        """Best score, gap and best ids of one long chunk, in time linear in its length."""
        size = len(points)
        first, begin, piece, score = self._edges(points)
        end = np.repeat(np.arange(size + 2), np.diff(np.append(first, len(begin))))
        forward, step = self._best_into(first, begin, score)
        # the same from the end: edges turned around
        order = np.argsort(size - begin, kind="stable")
        turned = (size - begin)[order]
        backward = self._best_into(np.searchsorted(turned, np.arange(size + 2)), (size - end)[order], score[order])[0][::-1]
        path, at = [], size
        while at:
            path.append(int(step[at]))
            at = int(begin[step[at]])
        through = forward[begin] + score + backward[end]
        through[path] = -np.inf
        return float(forward[size]), float(forward[size] - through.max()), piece[path[::-1]]

    def _spell(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replace characters in byte pieces by their ids; returns ids and their owners."""
        special = np.flatnonzero(ids >= AS_BYTES)
        if not len(special):
            return ids, owner
        raw = [chr(SPACE if p == SPACE else p).encode("utf-8", "surrogatepass") for p in (ids[special] - AS_BYTES).tolist()]
        size = np.ones(len(ids), np.int64)
        size[special] = [len(b) for b in raw]
        out = np.repeat(ids, size)
        out[np.repeat(ids >= AS_BYTES, size)] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        return out, np.repeat(owner, size)

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = data.tobytes()
        texts = [raw[s:e].decode("utf-8", "replace").replace(" ", chr(SPACE)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        best, gap = np.empty(len(texts)), np.empty(len(texts))
        flat, owner = [], []
        for i in np.flatnonzero(length > LONG).tolist():
            points = np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), np.uint32)
            best[i], gap[i], ids = self._solve_long(points)
            spelt, who = self._spell(ids, np.full(len(ids), i))
            flat.append(spelt)
            owner.append(who)
        for size in np.unique(length[length <= LONG]).tolist():
            group = np.flatnonzero(length == size)
            batch = max(1, min(4096, 400_000 // (size * min(size, self.longest))))
            for k in range(0, len(group), batch):
                at = group[k : k + batch]
                points = np.frombuffer("".join(texts[i] for i in at).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), size)
                best[at], gap[at], ids, count = self._solve(points)
                held = np.arange(size) < count[:, None]
                spelt, who = self._spell(ids[held], np.repeat(at, count))
                flat.append(spelt)
                owner.append(who)
        ids, owner = np.concatenate(flat), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        ids, size = ids[order], np.bincount(owner, minlength=len(texts))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(size) - size
        self.used += len(ids)
        where = np.searchsorted(self.keys, keys)
        for name, value in (("keys", keys), ("at", at), ("size", size), ("best", best), ("gap", gap)):
            setattr(self, name, np.insert(getattr(self, name), where, value))

    def search(self, chunk: str, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best segmentations of one chunk, best first, by backward A*."""
        size = len(chunk)
        if size > LONG:
            first, begin, piece, score = self._edges(np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), np.uint32))
            forward = self._best_into(first, begin, score)[0]
            edges = lambda at: zip(*(x[first[at] : first[at + 1]].tolist() for x in (begin, piece, score)), strict=True)
        else:
            into: list[list[tuple[int, int, float]]] = [[] for _ in range(size + 1)]
            forward = [-np.inf] * (size + 1)
            forward[0] = 0.0
            for j in range(1, size + 1):
                for i in range(max(0, j - self.longest), j):
                    found = self.texts.get(chunk[i:j])
                    if found is None and j == i + 1:
                        into[j].append((i, AS_BYTES + ord(chunk[i]), self.byte_score))
                    elif found is not None:
                        into[j].append((i, found, float(self.score[found])))
                forward[j] = max((forward[i] + s for i, _, s in into[j]), default=-np.inf)
            edges = into.__getitem__
        heap, met, out = [(-float(forward[size]), 0, size, 0.0, None)], 0, []
        while heap and len(out) < n:
            _, _, at, behind, path = heapq.heappop(heap)
            if not at:
                ids = []
                while path:
                    ids.append(path[0])
                    path = path[1]
                out.append((behind, ids))
                continue
            for i, found, s in edges(at):
                met += 1
                heapq.heappush(heap, (-float(forward[i] + s + behind), met, i, s + behind, (found, path)))
            if len(heap) > n - len(out):
                heap = heapq.nsmallest(n - len(out), heap)
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray):
        """Best ids of all texts of a chunk.

        Returns ids, each text's first id, and for chunks of the texts their keys' rows in the
        cache, bounds by text, and spans in the padded buffer, which comes last.
        """
        filled = np.diff(offsets) > 0
        padded = np.insert(data, offsets[:-1][filled], 32)
        first = offsets + np.concatenate(([0], np.cumsum(filled)))
        n = len(padded)
        if not n:
            none = np.zeros(0, np.int64)
            return none, np.zeros(len(offsets), np.int64), none, np.zeros(len(offsets), np.int64), none, none, padded
        cut = np.zeros(n + 1, dtype=bool)
        cut[first] = True
        space, feed = padded == 32, padded == 10
        cut[1:n] |= space[1:] & ~space[:-1] & (padded[:-1] != 0x81)
        cut[1:n] |= feed[1:] | feed[:-1]
        starts = np.flatnonzero(cut[:n])
        ends = np.append(starts[1:], n)
        bounds = np.searchsorted(starts, first)
        hashes = word_hashes(padded, starts, ends, fold=False)
        keys, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > self.max_chunks:
            self._reset()
        where = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = where < len(self.keys)
        known[inside] = self.keys[where[inside]] == keys[inside]
        if not known.all():
            new = ~known
            self._learn(keys[new], padded, starts[one[new]], ends[one[new]])
            where = np.searchsorted(self.keys, keys)
        rows = where[which]
        size = self.size[rows]
        return self.pool[ragged(self.at[rows], size)], np.concatenate(([0], np.cumsum(size)))[bounds], rows, bounds, starts, ends, padded

    def n_best(self, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, padded: np.ndarray, ids: np.ndarray, n: int) -> list[tuple[float, np.ndarray]]:
        """Scores and ids of one text's ``n`` best segmentations, from its chunks and its best ids."""
        gap = self.gap[rows]
        near = np.argsort(gap, kind="stable")[: n - 1]
        near = np.sort(near[np.isfinite(gap[near])]).tolist()
        found, options = [(float(self.best[rows].sum()), ())], []
        for k in near:
            text = padded[starts[k] : ends[k]].tobytes().decode("utf-8", "replace").replace(" ", chr(SPACE))
            own = self.searched.get((text, n))
            if own is None:
                own = [(s, self._spell(np.array(path, np.int64), np.zeros(len(path), np.int64))[0]) for s, path in self.search(text, n)]
                if len(text) <= LONG:
                    if len(self.searched) > 200_000:
                        self.searched.clear()
                    self.searched[text, n] = own
            options.append(own)
            found = heapq.nlargest(n, [(a + s - own[0][0], (*picks, o)) for a, picks in found for o, (s, _) in enumerate(own)], key=lambda x: x[0])
        at = np.concatenate(([0], np.cumsum(self.size[rows])))
        out = []
        for score, picks in found:
            parts, done = [], 0
            for k, own, o in zip(near, options, picks, strict=True):
                parts += [ids[done : at[k]], own[o][1]]
                done = at[k + 1]
            out.append((score, np.concatenate([*parts, ids[done:]]).astype(np.int32)))
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of ids, with the space that stands before a text."""
        return self.piece_pool[ragged(self.piece_at[ids], self.piece_size[ids])]


_open: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """One model per file and worker process."""
    if path not in _open:
        _open[path] = PieceModel(path)
    return _open[path]


def encode_texts(docs: DataFrame, model_path: str, n_best: int = N_BEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, n_best_scores, n_best, round_trip`` of every whole text: best ids, the scores and the ids of
    the ``n_best`` best segmentations, and whether decoding gives the text back.

    Of segmentations with equal scores the first of ``n_best`` need not be ``ids``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            for row, count, data, offsets in text_chunks(batch.column(1)):
                ids, first, rows, bounds, starts, ends, padded = model.encode(data, offsets)
                scores, lists, same = [], [], []
                back = model.decode(ids)
                at = np.concatenate(([0], np.cumsum(model.piece_size[ids])))[first]
                held = np.concatenate(([0], ends))[bounds] if len(ends) else np.zeros(count + 1, np.int64)
                for i in range(count):
                    a, b = bounds[i], bounds[i + 1]
                    best = model.n_best(rows[a:b], starts[a:b], ends[a:b], padded, ids[first[i] : first[i + 1]], n_best) if b > a else []
                    scores.append([s for s, _ in best])
                    lists.append([x for _, x in best])
                    same.append(bool(np.array_equal(back[at[i] : at[i + 1]], padded[held[i] : held[i + 1]])))
                flat = [x for own in lists for x in own]
                inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, flat)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *flat])))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, count), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32())), pa.array(scores, pa.list_(pa.float64())),
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), inner), pa.array(same),
                ], names=["doc_id", "ids", "n_best_scores", "n_best", "round_trip"])

    named = whole_texts(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return named.mapInArrow(tidy(run), "doc_id long, ids array<int>, n_best_scores array<double>, n_best array<array<int>>, round_trip boolean")


def decode_ids(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from lists of ids; the space before a text is taken off, null lists give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            texts = []
            for ids in batch.column(1):
                raw = None if not ids.is_valid else model.decode(ids.values.to_numpy(zero_copy_only=False).astype(np.int64)).tobytes()
                texts.append(raw if raw is None else raw.removeprefix(b" ").decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).alias("doc_id"), ids_col).mapInArrow(tidy(run), "doc_id long, text string")


def pieces_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: digests of the best segmentation of every document and of its three best, their scores, and the round trip."""
    import public_tokenizers

    encoded = encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))

    def crc(ids: pa.ListScalar) -> int:
        return zlib.crc32(ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            several = [[crc(ids) for ids in own.values] for own in batch.column(3)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1).value_lengths().cast(pa.int64()), pa.array([crc(x) for x in batch.column(1)], pa.int64()), batch.column(2), pa.array(several, pa.list_(pa.int64())), batch.column(4),
            ], names=["doc_id", "n_pieces", "ids_crc32", "n_best_scores", "n_best_crc32", "round_trip"])

    return encoded.mapInArrow(tidy(digest), "doc_id long, n_pieces long, ids_crc32 long, n_best_scores array<double>, n_best_crc32 array<long>, round_trip boolean")
