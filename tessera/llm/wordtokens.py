"""Exact, cached word-level use of a public tokenizer file.

The tokenizer's pre-tokeniser never joins characters across white space, so a
text's ids are the concatenated ids of its white-space separated runs. Runs
repeat, so each distinct run is encoded once per worker process and a batch is
then assembled by vectorised gathers.
"""

from __future__ import annotations

import os

import numpy as np

from tessera.llm.words import ragged, word_hashes, word_spans

_open: dict[tuple[str, int], WordTokenizer] = {}

_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: Runs that a worker's cache holds.
MOST_RUNS = 500_000
#: Runs of letters are encoded this many at a time, as one text.
TOGETHER = 2000


def token_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """White-space separated runs, with one stop mark after an ASCII letter as a run of its own."""
    starts, ends, bounds = word_spans(data, offsets)
    cut = np.zeros(len(starts), dtype=bool)
    long = np.flatnonzero(ends - starts > 1)
    cut[long] = _STOP[data[ends[long] - 1]] & _LETTER[data[ends[long] - 2]]
    count = 1 + cut
    place = np.concatenate(([0], np.cumsum(count)))
    last = place[1:][cut] - 1
    starts, ends = np.repeat(starts, count), np.repeat(ends, count)
    starts[last] = ends[last] - 1
    ends[last - 1] -= 1
    return starts, ends, place[bounds]


class WordTokenizer:
    """Encode chunks of texts; the run cache is dropped beyond ``max_runs`` entries."""

    def __init__(self, path: str, max_runs: int = MOST_RUNS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.vocab_size = len(vocab)
        self.closes = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.closes[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True
        self.max_runs = max_runs
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = data.tobytes()
        runs = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        plain = np.fromiter((x.isalpha() and x.lower().isalpha() for x in runs), bool, len(runs))
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
        words = [runs[i] for i in order[: plain.sum()]]
        texts = [" ".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)]
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        joint = np.concatenate([np.zeros(0, np.uint32), *(np.array(x.ids, np.uint32) for x in encoded)])
        size = np.diff(np.concatenate(([-1], np.flatnonzero(self.closes[joint]))))
        if len(size) != len(words):
            raise ValueError("the tokenizer does not close each word with one piece")
        encoded = self.tokenizer.encode_batch_fast([runs[i] for i in order[len(words) :]], add_special_tokens=False)
        single = [x.ids for x in encoded]
        size = np.concatenate((size, np.fromiter(map(len, single), np.int64, len(single))))
        flat = np.concatenate((joint, np.fromiter((i for ids in single for i in ids), np.uint32)))
        keys = keys[order]
        rank = np.argsort(keys)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(size) - size
        self.used += len(flat)
        keys, at, size = keys[rank], at[rank], size[rank]
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.at = np.insert(self.at, where, at)
        self.size = np.insert(self.size, where, size)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a chunk, and each text's first id (one more entry at the end)."""
        starts, ends, bounds = token_runs(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        hashes = word_hashes(data, starts, ends, fold=False)
        keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > self.max_runs:
            self._reset()
        where = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = where < len(self.keys)
        known[inside] = self.keys[where[inside]] == keys[inside]
        if not known.all():
            new = ~known
            self._learn(keys[new], data, starts[first[new]], ends[first[new]])
            where = np.searchsorted(self.keys, keys)
        size = self.size[where][which]
        ids = self.pool[ragged(self.at[where][which], size)]
        return ids, np.concatenate(([0], np.cumsum(size)))[bounds]


def word_tokenizer(path: str, max_runs: int = MOST_RUNS) -> WordTokenizer:
    """One tokenizer per file and worker process."""
    if (path, max_runs) not in _open:
        _open[path, max_runs] = WordTokenizer(path, max_runs)
    return _open[path, max_runs]


def forget_tokenizers() -> None:
    """Drop this process's tokenizers and their caches, for a stage that needs none."""
    _open.clear()
