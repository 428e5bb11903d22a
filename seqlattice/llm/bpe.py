"""Token ids of a byte run, looked up once per distinct run and kept in a bounded table of the worker."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from seqlattice.llm.words import U64, ragged

# Entries of a worker's table; at about forty bytes each. A full table is emptied, which costs time only.
MAX_UNITS = 1_000_000

_WORD_TAIL = np.zeros(256, bool)
_WORD_TAIL[[0x2C, 0x2E]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = True
_LETTER[97:123] = True


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a file, with truncation and padding off."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encode_many(path: str, texts: list[str]) -> list[list[int]]:
    """Ids of each text; special tokens are not added, and their literals in a text are recognised."""
    return [e.ids for e in load(path).encode_batch_fast(texts, add_special_tokens=False)]


class Units:
    """Ids by the 64-bit hash and the length of a byte run: sorted hashes, and slots in flat arrays."""

    def __init__(self, path: str, limit: int = MAX_UNITS):
        self.path, self.limit = path, limit
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(0, U64)
        self.slots = np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 16, np.int32)
        self.first = np.zeros(1 << 14, np.int64)
        self.count = 0

    def _add(self, keys: np.ndarray, texts: list[str]) -> None:
        found = encode_many(self.path, texts)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        used, total = int(self.first[self.count]), int(sizes.sum())
        if used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), total), np.int32)])
        if self.count + len(found) + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros(max(len(self.first), len(found) + 1), np.int64)])
        self.ids[used : used + total] = np.fromiter((i for f in found for i in f), np.int32, total)
        self.first[self.count + 1 : self.count + 1 + len(found)] = used + np.cumsum(sizes)
        at = np.searchsorted(self.keys, keys)
        self.slots = np.insert(self.slots, at, self.count + np.arange(len(found)))
        self.keys = np.insert(self.keys, at, keys)
        self.count += len(found)

    def lookup(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The slot of each run; runs that are new are encoded, each once."""
        distinct, where, back = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        if not known.all():
            if self.count + int((~known).sum()) > self.limit and self.count:
                self._empty()
                known[:] = False
            raw = data.tobytes()
            new = where[~known]
            self._add(distinct[~known], [raw[a:b].decode("utf-8") for a, b in zip(start[new].tolist(), end[new].tolist())])
            at = np.searchsorted(self.keys, distinct)
        return self.slots[at][back]

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the slots one after another, and where each slot's begin."""
        place, first = ragged(self.first, slots)
        return self.ids[place], first


_TABLES: dict[str, Units] = {}


def units(path: str) -> Units:
    """The table of this worker for a tokenizer file."""
    if path not in _TABLES:
        _TABLES[path] = Units(path)
    return _TABLES[path]


def cut_tails(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs with a last comma or full stop after an ASCII letter cut in two, and the run each part came from.

    Both tokenizers end a token between a letter and such a mark, and the mark is the last of its run.
    """
    owner = np.arange(len(start))
    two = np.flatnonzero((end - start >= 2) & _WORD_TAIL[data[end - 1]])
    two = two[_LETTER[data[end[two] - 2]]]
    start2 = np.insert(start, two + 1, end[two] - 1)
    end2 = np.insert(end, two, end[two] - 1)
    return start2, end2, np.insert(owner, two + 1, two)
