"""BPE ids through content-defined chunks that documents share, and back to text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlattice.llm import bpe, words
from seqlattice.llm.words import U64

# A chunk ends where the rolling hash over WINDOW units is 0 modulo CHUNK, so CHUNK units on average.
WINDOW = 3
CHUNK = 64
# Ids of chunks that a worker keeps; a full table is emptied, which costs time only.
MAX_IDS = 4_000_000

# Code points that regular expressions count as white space, outside 0x20 and 0x09 to 0x0D, in UTF-8.
OTHER_SPACES = [chr(c).encode() for c in (0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def unit_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and first unit of each text: a unit is white space and the word after it, or white space that ends a text.

    A text with white space other than ASCII's is one unit, as its words are not cut alike by every tokenizer.
    """
    found = words.split(data, offsets)
    owner = found.owner
    start = np.concatenate([[0], found.end[:-1]]) if len(found.end) else np.zeros(0, np.int64)
    heads = found.first[:-1][np.diff(found.first) > 0]
    start[heads] = offsets[owner[heads]]
    last = np.full(found.texts, -1, np.int64)
    filled = np.diff(found.first) > 0
    last[filled] = found.end[found.first[1:][filled] - 1]
    last[~filled] = offsets[:-1][~filled]
    tail = np.flatnonzero(last < offsets[1:])
    start = np.concatenate([start, last[tail]])
    end = np.concatenate([found.end, offsets[1:][tail]])
    odd = _odd_texts(data, offsets)
    if len(odd):
        text = np.searchsorted(offsets, start, "right") - 1
        keep = ~np.isin(text, odd)
        start = np.concatenate([start[keep], offsets[odd]])
        end = np.concatenate([end[keep], offsets[odd + 1]])
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    return start, end, np.searchsorted(start, offsets)


def _odd_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    lead = np.zeros(256, bool)
    lead[[s[0] for s in OTHER_SPACES]] = True
    at = np.flatnonzero(lead[data])
    hit = np.zeros(len(at), bool)
    for s in OTHER_SPACES:
        same = at + len(s) <= len(data)
        for k, byte in enumerate(s):
            same[same] &= data[at[same] + k] == byte
        hit |= same
    return np.unique(np.searchsorted(offsets, at[hit], "right") - 1)


class Chunks:
    """Ids by chunk hash for one tokenizer; each chunk is encoded when it is first met."""

    def __init__(self, path: str, size: int = CHUNK, limit: int = MAX_IDS):
        self.path, self.size, self.limit = path, size, limit
        self.known: dict[int, np.ndarray] = {}
        self.agreed: set[tuple[int, int]] = set()
        self.held = 0

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive texts, and where each text's begin."""
        start, end, first = unit_bounds(data, offsets)
        sums = words.prefix_sums(data)
        keys = words.run_hash(sums, start, end)
        rolling = np.zeros(len(keys), U64)
        for k in range(WINDOW):
            rolling[k:] += words.mix(keys[: len(keys) - k] + U64(k))
        opens = np.zeros(len(keys), bool)
        opens[1:] = words.mix(rolling[:-1]) % U64(self.size) == 0
        opens[first[:-1][np.diff(first) > 0]] = True
        head = np.flatnonzero(opens)
        stop = np.append(head[1:], len(keys))
        names = words.run_hash(sums, start[head], end[stop - 1]).tolist()
        self._learn(data, start, end, keys, head, stop, names)
        parts = [self.known[n] for n in names]
        joins = np.flatnonzero(np.isin(head[1:], first[:-1], invert=True)) + 1
        text = np.searchsorted(first, head, "right") - 1
        self._repair(data, start, end, keys, head, joins.tolist(), parts, first[text], first[text + 1])
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        sizes = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
        return flat, sizes[np.searchsorted(head, first)]

    def _learn(self, data, start, end, keys, head, stop, names) -> None:
        if self.held > self.limit:
            self.known.clear()
            self.agreed.clear()
            self.held = 0
        new = {n: k for k, n in enumerate(names) if n not in self.known}
        if not new:
            return
        rows = np.fromiter(new.values(), np.int64, len(new))
        counts = stop[rows] - head[rows]
        unit = np.repeat(head[rows], counts) + words._within(counts)
        s, e, owner = bpe.cut_tails(data, start[unit], end[unit])
        table = bpe.units(self.path)
        # A part keyed by its own bytes; whole units keep the hash that is known already.
        part = keys[unit][owner]
        split = np.flatnonzero((s != start[unit][owner]) | (e != end[unit][owner]))
        if len(split):
            part = part.copy()
            part[split] = words.run_hash(words.prefix_sums(data), s[split], e[split])
        ids, at = table.gather(table.lookup(data, s, e, part))
        at = at[np.searchsorted(owner, np.concatenate([[0], np.cumsum(counts)]))]
        for k, name in enumerate(new):
            self.known[name] = ids[at[k] : at[k + 1]]
            self.held += int(at[k + 1] - at[k])

    def _repair(self, data, start, end, keys, head, joins, parts, lowest, highest) -> None:
        """Make the ids around each join those of its text, the units ``lowest`` to ``highest``, as a whole.

        The last unit before a join and the first after it are encoded together. If the result is not the two units'
        ids in a row, more units are taken on both sides until it begins and ends as the outermost units do; those ids
        replace the ones of their units. The region ends where a word does. Where the two chunks are too short for that, the whole text is encoded.
        """
        ask = []
        for j in joins:
            pair = (int(keys[head[j] - 1]), int(keys[head[j]]))
            if pair not in self.agreed:
                ask.append((j, int(head[j]), pair))
        if not ask:
            return
        raw = data.tobytes()
        text = lambda a, b: raw[start[a] : end[b - 1]].decode("utf-8")
        some = lambda spans: bpe.encode_many(self.path, [text(a, b) for a, b in spans])
        # A unit that begins inside white space says nothing about the ids before it.
        edge = lambda a: not raw[start[a] - 1 : start[a]].isspace()
        both = some((h - 1, h + 1) for _, h, _ in ask)
        left = some((h - 1, h) for _, h, _ in ask)
        right = some((h, h + 1) for _, h, _ in ask)
        # From which unit on a part still holds its own ids, after a repair of the join before it.
        begin = head.tolist()
        entire: set[int] = set()
        for (j, at, pair), whole, a, b in zip(ask, both, left, right):
            if whole == a + b:
                self.agreed.add(pair)
                continue
            if int(lowest[j]) in entire:
                continue
            low, high = begin[j - 1], int(head[j + 1]) if j + 1 < len(head) else len(start)
            reach = 1
            while True:
                reach *= 2
                first, last = max(low, at - reach), min(high, at + reach)
                whole, lead, close = some([(first, last), (first, first + 1), (last - 1, last)])
                agrees = first == lowest[j] or (edge(first) and whole[: len(lead)] == lead)
                agrees &= last == highest[j] or (edge(last) and whole[len(whole) - len(close) :] == close)
                if agrees or (first == low and last == high):
                    break
            if not agrees:
                entire.add(int(lowest[j]))
                mine = np.flatnonzero((head >= lowest[j]) & (head < highest[j]))
                for k in mine[1:].tolist():
                    parts[k] = np.zeros(0, np.int32)
                parts[mine[0]] = np.array(some([(int(lowest[j]), int(highest[j]))])[0], np.int32)
                continue
            before, after = (some([(x, y)])[0] if x < y else [] for x, y in ((low, first), (last, high)))
            parts[j - 1] = np.array(before + whole, np.int32)
            parts[j] = np.array(after, np.int32)
            begin[j] = last


_CHUNKS: dict[str, Chunks] = {}


def chunks(path: str) -> Chunks:
    if path not in _CHUNKS:
        _CHUNKS[path] = Chunks(path)
    return _CHUNKS[path]


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary.

    Printable bytes stand for themselves, the others for the code points from 256 on, in order.
    """
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    tokenizer = bpe.load(path)
    names = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]
    return [bytes(byte[c] for c in n) if all(c in byte for c in n) else n.encode() for n in names]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``doc_id, ids`` per row of ``docs``, and with ``with_text`` also ``decoded``, the text of those ids.

    Ids are the tokenizer's for the whole text, without added special tokens. A null or empty text has no ids and
    decodes to the empty text. Rows are handled one by one: repeated rows and null ids are kept. Other columns
    are not read. Nothing is shuffled; a worker keeps at most ``MAX_IDS`` ids of chunks.
    """
    schema = "doc_id bigint, ids array<int>" + (", decoded string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunks(tokenizer)
        for batch in batches:
            for row, data, offsets in words.pieces(batch.column(1)):
                ids, first = table.encode(data, offsets)
                count = len(first) - 1
                columns = [batch.column(0).slice(row, count), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids))]
                if with_text:
                    columns.append(_decoded(tokenizer, ids, first))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _decoded(path: str, ids: np.ndarray, first: np.ndarray) -> pa.Array:
    table = token_bytes(path)
    of = table.__getitem__
    return pa.array([b"".join(map(of, ids[a:b].tolist())).decode("utf-8", "replace") for a, b in zip(first[:-1].tolist(), first[1:].tolist())], pa.string())


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, decoded`` per row; special tokens keep their names, null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            if lists.null_count:
                lists = pa.array([x or [] for x in lists.to_pylist()], pa.list_(pa.int32()))
            first = lists.offsets.to_numpy()
            ids = lists.values.to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), _decoded(tokenizer, ids, first)], ["doc_id", "decoded"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id bigint, decoded string")
