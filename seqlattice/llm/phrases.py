"""Collocations by stripes: each prefix keys a counter of the words that follow it.

Words are counted first. Then, for phrases of 2, 3, .. words, each task gathers the stripes of its texts: for a prefix of one
word less, the counts of next words and how often none that matters follows. Stripes of one prefix are merged by adding their
counters up, and a merged stripe holds all that is needed of its prefix: the extensions with their counts, the prefix's own
count (the sum of all) and the largest count of an extension, which decides whether the prefix is subsumed.

* A phrase can only be frequent if both its parts of one word less are. A Bloom filter of the frequent shorter phrases tells
  tasks which prefixes and which extensions to pass by. It has no false negatives, so counts stay exact; beyond its largest size
  it only passes more.
* The stripe of a prefix that holds more than one in ``HOT`` of all words is cut into parts by its next words.
* Stripes travel sorted, so a task merges neighbours and holds one merged stripe.

Words are known by 64-bit hashes while they are counted; two words of one language with one hash would be taken for one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlattice.llm import bloom, words
from seqlattice.llm.hot import HOT, lookup
from seqlattice.llm.names import col
from seqlattice.llm.words import U64
from seqlattice.session import materialize

# Words whose stripes a task gathers before it sends them on.
FLUSH = 1 << 21
# Candidates that one task ranks.
RANKED = 1 << 20

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BETWEEN = _BREAK.copy()
_BETWEEN[[0x20, 0x09]] = True


def _lang_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _fold(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase and a word after it; a phrase of none has its language's hash."""
    return words.mix(h * U64(0x9E3779B97F4A7C15) + word)


class _Block:
    """The words of many texts: hashes, language numbers and whether the next word continues the piece."""

    def __init__(self) -> None:
        self.langs: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, data: np.ndarray, offsets: np.ndarray, langs: list[str]) -> words.Words:
        found = words.split(data, offsets, lower=True, between=_BETWEEN)
        n = len(found.hash)
        joint = np.zeros(n, bool)
        if n > 1:
            breaks = np.concatenate([[0], np.cumsum(_BREAK[found.data])])
            owner = found.owner
            joint[:-1] = (owner[1:] == owner[:-1]) & (breaks[found.start[1:]] == breaks[found.end[:-1]])
        codes = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs], np.int64)
        self.parts.append((found.hash, joint, np.repeat(codes, np.diff(found.first))))
        self.size += n
        return found

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        out = (*(np.concatenate(c) for c in zip(*self.parts)), list(self.langs))
        self.__init__()
        return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    block = _Block()
    for batch in batches:
        for row, data, offsets in words.pieces(batch.column(1)):
            block.add(data, offsets, batch.column(0).slice(row, len(offsets) - 1).to_pylist())
            if block.size >= FLUSH:
                yield block.take()
    if block.parts:
        yield block.take()


def count_words(docs: DataFrame) -> DataFrame:
    """``lang, word, hash, f`` for each word of each language; ``docs`` has ``lang`` and ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for batch in batches:
            for row, data, offsets in words.pieces(batch.column(1)):
                found = block.add(data, offsets, batch.column(0).slice(row, len(offsets) - 1).to_pylist())
                h, _, code, langs = block.take()
                order = np.lexsort((h, code))
                new = np.ones(len(order), bool)
                new[1:] = (np.diff(h[order]) != 0) | (np.diff(code[order]) != 0)
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(order)))
                raw = found.data.tobytes()
                one = order[first]
                texts = [raw[a:b].decode() for a, b in zip(found.start[one].tolist(), found.end[one].tolist())]
                columns = [pa.array(langs, pa.string()).take(pa.array(code[one])), pa.array(texts, pa.string()), pa.array(h[one].view(np.int64)), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "hash", "n"])

    found = docs.mapInArrow(count, "lang string, word string, hash long, n long")
    return found.groupBy("lang", "word", "hash").agg(F.sum("n").alias("f"))


def _phrase_hashes(lang: pa.Array, phrase: pa.Array) -> np.ndarray:
    """Hashes of phrases, all of one length."""
    known = lang.dictionary_encode()
    base = np.array([_lang_hash(x) for x in known.dictionary.to_pylist()], U64)
    h = base[known.indices.to_numpy()] if len(lang) else np.zeros(0, U64)
    size = len(phrase.flatten()) // max(len(phrase), 1)
    table = phrase.flatten().to_numpy().view(U64).reshape(len(phrase), size)
    for k in range(size):
        h = _fold(h, table[:, k])
    return h


def bloom_filter(phrases: DataFrame, count: int) -> np.ndarray:
    """A filter of the ``lang, words`` of ``phrases``."""
    return bloom.build(phrases.select("lang", "words"), count, lambda batch: _phrase_hashes(batch.column(0), batch.column(1)))


_STRIPE = "lang string, prefix binary, part int, rest long, nexts binary, counts binary"
_MERGED = "lang string, prefix array<long>, total long, top long, nexts array<long>, counts array<long>"


def gather(h: np.ndarray, joint: np.ndarray, code: np.ndarray, langs: list[str], size: int, likely: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """The stripes of one block for phrases of ``size`` words.

    ``rest`` counts how often a prefix stands before no word that could make a frequent phrase. ``part`` is -1, or the number of the
    part of a prefix in ``heavy`` (sorted hashes, and into how many parts their stripes are cut).
    """
    n = len(h)
    base = np.array([_lang_hash(x) for x in langs], U64)
    inside = np.ones(n, bool)  # size - 1 words from here on are in one piece
    key = base[code] if n else np.zeros(0, U64)
    for k in range(size - 1):
        key[: n - k] = _fold(key[: n - k], h[k:])
        if k:
            inside[: n - k] &= joint[k - 1 : n - 1]
            inside[n - k :] = False
    good = inside & bloom.contains(likely, key)
    follows = good.copy()
    follows[: n - 1] &= good[1:]
    follows[n - 1 :] = False
    reach = size - 2
    follows[: n - reach] &= joint[reach:]
    at = np.flatnonzero(good)
    after = follows[at]
    prefix = [h[at + k] for k in range(size - 1)]
    nxt = np.where(after, h[np.minimum(at + size - 1, max(n - 1, 0))], U64(0))
    slot = np.minimum(np.searchsorted(heavy[0], key[at]), max(len(heavy[0]) - 1, 0))
    part = np.full(len(at), -1, np.int32)
    if len(heavy[0]):
        cut = np.flatnonzero(heavy[0][slot] == key[at])
        part[cut] = np.where(after[cut], words.mix(nxt[cut]) % heavy[1][slot[cut]].astype(U64), U64(0)).astype(np.int32)
    order = np.lexsort((nxt, after, part, *prefix[::-1], code[at]))
    columns = [code[at][order], *(p[order] for p in prefix), part[order]]
    row = np.zeros(len(order), bool)
    entry = np.zeros(len(order), bool)
    if len(order):
        row[0] = entry[0] = True
        for c in columns:
            row[1:] |= c[1:] != c[:-1]
        entry[1:] = row[1:] | (np.diff(after[order]) != 0) | (np.diff(nxt[order]) != 0)
    first = np.flatnonzero(entry)
    count = np.diff(np.append(first, len(order)))
    real = after[order][first]
    owner = np.cumsum(row)[first] - 1
    head = np.flatnonzero(row)
    rest = np.zeros(len(head), np.int64)
    rest[owner[~real]] = count[~real]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner[real], minlength=len(head)))])
    stacked = np.stack([c[head] for c in columns[1:-1]], axis=1) if len(head) else np.zeros((0, size - 1), U64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(langs, pa.string()).take(pa.array(columns[0][head])),
            _binary(stacked.astype("<u8"), np.arange(len(head) + 1) * 8 * (size - 1)),
            pa.array(columns[-1][head], pa.int32()),
            pa.array(rest),
            _binary(nxt[order][first][real].astype("<u8"), bounds * 8),
            _binary(count[real].astype("<u4"), bounds * 4),
        ],
        ["lang", "prefix", "part", "rest", "nexts", "counts"],
    )


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    raw = pa.py_buffer(np.ascontiguousarray(values).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype("<i4").tobytes()), raw])


def _raw(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column and how many each row has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    size = np.dtype(kind).itemsize
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].copy().view(kind) if data is not None else np.zeros(0, kind)
    return values, np.diff(offsets) // size


class _Stripes:
    """Merged stripes in order: keys, rests, and entries with the number of their stripe."""

    def __init__(self, lang: list[str], prefix: np.ndarray, part: np.ndarray, rest: np.ndarray, owner: np.ndarray, nxt: np.ndarray, count: np.ndarray):
        self.lang, self.prefix, self.part, self.rest, self.owner, self.nxt, self.count = lang, prefix, part, rest, owner, nxt, count

    def key(self, k: int) -> tuple:
        return self.lang[k], self.prefix[k].tobytes(), int(self.part[k])

    def slice(self, low: int, high: int) -> _Stripes:
        a, b = np.searchsorted(self.owner, [low, high])
        return _Stripes(self.lang[low:high], self.prefix[low:high], self.part[low:high], self.rest[low:high], self.owner[a:b] - low, self.nxt[a:b], self.count[a:b])


def _merged(parts: list[_Stripes]) -> _Stripes:
    """Neighbouring stripes of one key as one, counters added."""
    lang = [x for p in parts for x in p.lang]
    prefix, part, rest = (np.concatenate([getattr(p, f) for p in parts]) for f in ("prefix", "part", "rest"))
    shift = np.cumsum([0] + [len(p.lang) for p in parts[:-1]])
    owner = np.concatenate([p.owner + s for p, s in zip(parts, shift)])
    nxt, count = (np.concatenate([getattr(p, f) for p in parts]) for f in ("nxt", "count"))
    new = np.ones(len(lang), bool)
    codes = pa.array(lang, pa.string()).dictionary_encode().indices.to_numpy()
    new[1:] = (np.diff(codes) != 0) | (prefix[1:] != prefix[:-1]).any(axis=1) | (np.diff(part) != 0)
    group = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    owner = group[owner]
    order = np.lexsort((nxt, owner))
    owner, nxt, count = owner[order], nxt[order], count[order]
    if len(owner):
        first = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(nxt) != 0)]))
        owner, nxt, count = owner[first], nxt[first], np.add.reduceat(count, first)
    return _Stripes([lang[k] for k in head], prefix[head], part[head], np.add.reduceat(rest, head), owner, nxt, count)


def merge(batches: Iterator[pa.RecordBatch], size: int, least: int) -> Iterator[pa.RecordBatch]:
    """Merge sorted stripes; extensions counted fewer than ``least`` times only go into the totals, and stripes without others are left out."""
    held: _Stripes | None = None

    def out(s: _Stripes) -> pa.RecordBatch:
        n = len(s.lang)
        total = s.rest + np.bincount(s.owner, s.count, n).astype(np.int64)
        keep = s.count >= least
        sizes = np.bincount(s.owner[keep], minlength=n)
        top = np.zeros(n, np.int64)
        np.maximum.at(top, s.owner[keep], s.count[keep])
        bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(v[keep].view(np.int64))) for v in (s.nxt, s.count)]
        prefix = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (size - 1)), pa.array(s.prefix.reshape(-1).view(np.int64)))
        found = pa.RecordBatch.from_arrays([pa.array(s.lang, pa.string()), prefix, pa.array(total), pa.array(top), *lists], ["lang", "prefix", "total", "top", "nexts", "counts"])
        return found.filter(pa.array((sizes > 0) | (s.part >= 0)))

    for batch in batches:
        if not batch.num_rows:
            continue
        prefix, _ = _raw(batch.column(1), U64)
        nxt, lengths = _raw(batch.column(4), U64)
        count, _ = _raw(batch.column(5), np.uint32)
        rows = batch.num_rows
        new = _Stripes(batch.column(0).to_pylist(), prefix.reshape(rows, size - 1), batch.column(2).to_numpy(), batch.column(3).to_numpy(), np.repeat(np.arange(rows), lengths), nxt, count.astype(np.int64))
        both = _merged([held, new] if held else [new])
        last = len(both.lang) - 1
        held = both.slice(last, last + 1)
        if last:
            yield out(both.slice(0, last))
    if held:
        yield out(held)


def stripes(docs: DataFrame, size: int, shorter: DataFrame, every: int, least: int) -> DataFrame:
    """``lang, prefix, total, top, nexts, counts``: merged stripes of all prefixes of ``size - 1`` words with frequent extensions.

    ``shorter`` has the frequent phrases of ``size - 1`` words (``lang, words, f``), of ``every`` words in all. A prefix that holds
    more than one in HOT of them has its stripe in parts, one row each.
    """
    context = docs.sparkSession.sparkContext
    likely = context.broadcast(bloom_filter(shorter, shorter.count()))
    hot = shorter.filter(F.col("f") * HOT > every).select("lang", "words", "f").collect()
    keys = [_phrase_hashes(pa.array([r["lang"]]), pa.array([r["words"]], pa.list_(pa.int64())))[0] for r in hot]
    order = sorted(range(len(hot)), key=keys.__getitem__)
    heavy = context.broadcast((np.array([keys[k] for k in order], U64), np.array([-(-hot[k]["f"] * HOT // every) for k in order], np.int64)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            found = gather(*block, size, likely.value, heavy.value)
            for low in range(0, found.num_rows, 1 << 15):
                yield found.slice(low, 1 << 15)

    key = ["lang", "prefix", "part"]
    sent = docs.mapInArrow(send, _STRIPE).repartition(*key).sortWithinPartitions(*key)
    return sent.mapInArrow(lambda batches: merge(batches, size, least), _MERGED)


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, covered: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``top`` phrases of each language by cohesion: ``lang, rank, phrase, a, l, r, n, score``.

    A-Z are lower-cased; texts are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at spaces and tabs into words. Phrases are
    2 to ``max_words`` consecutive words of a piece, ``a`` their number of occurrences, overlaps included, at least ``least``. A
    phrase cut after its first k words scores ``floor(1000000 * a * a / (l * r))``, ``l`` and ``r`` being the occurrences of both
    parts; its lowest-scoring cut counts, of equal ones the first. A phrase is dropped if one word more on either side still has
    ``covered`` percent of its occurrences or more. ``n`` is the number of words of the language. Ranks go by score and ``a``,
    descending, then by the phrase's bytes.

    Null texts are empty, a null language is ``und``, repeated rows count each time, other columns are not read, and an empty table
    gives an empty result. Counts cover all texts.
    """
    docs = docs.select(F.coalesce(col(lang_col).cast("string"), F.lit("und")).alias("lang"), col(text_col).cast("string").alias("text"))
    counted = materialize(count_words(docs))
    sizes = materialize(counted.groupBy("lang").agg(F.sum("f").alias("n")))
    every = int(sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    frequent = {1: materialize(counted.filter(F.col("f") >= least).select("lang", F.array("hash").alias("words"), F.col("word").alias("phrase"), "f"))}
    covers = []
    for size in range(2, max_words + 1):
        found = materialize(stripes(docs, size, frequent[size - 1], every, least))
        totals = found.groupBy("lang", "prefix").agg(F.sum("total").alias("total"), F.max("top").alias("top"))
        longer = found.select("lang", "prefix", F.explode(F.arrays_zip("nexts", "counts")).alias("entry"))
        longer = materialize(longer.select("lang", F.concat("prefix", F.array("entry.nexts")).alias("words"), F.col("entry.counts").alias("f")))
        if size > 2:
            covers += [totals.select("lang", F.col("prefix").alias("words"), F.col("top").alias("over")), longer.select("lang", F.slice("words", 2, size - 1).alias("words"), F.col("f").alias("over"))]
        frequent[size] = _scored(longer, totals, frequent, size, every)
    phrases = materialize(_kept([frequent[k] for k in range(2, max_words + 1)], covers, covered))
    salts = -(-phrases.count() // RANKED)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    if salts > 1:
        some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
        phrases = phrases.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= top)
    ranked = phrases.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _scored(longer: DataFrame, totals: DataFrame, frequent: dict[int, DataFrame], size: int, every: int) -> DataFrame:
    """``lang, words, phrase, f, cut`` of phrases of ``size`` words; parts of a frequent phrase are frequent, so all are found."""

    def find(table: DataFrame, other: DataFrame, count: str, first: int, length: int, give: dict[str, str]) -> DataFrame:
        """``table`` with values of the part of ``length`` words from word ``first`` on."""
        table = table.withColumn("part", F.slice("words", first, length))
        other = other.select(F.col("lang").alias("of"), F.col("words").alias("is"), (F.col(count) * HOT > every).alias("is_hot"), *[F.col(a).alias(b) for a, b in give.items()])
        return materialize(lookup(table, other, {"lang": "of", "part": "is"}, F.col("is_hot")).drop("part", "is_hot"))

    table = find(longer, totals.withColumnRenamed("prefix", "words"), "total", 1, size - 1, {"total": f"l{size - 1}"})
    table = find(table, frequent[1], "f", 1, 1, {"phrase": "head"} | ({"f": "l1"} if size > 2 else {}))
    table = find(table, frequent[size - 1], "f", 2, size - 1, {"phrase": "tail", "f": "r1"})
    for k in range(2, size):
        table = find(table, frequent[size - k], "f", k + 1, size - k, {"f": f"r{k}"})
        if k < size - 1:
            table = find(table, frequent[k], "f", 1, k, {"f": f"l{k}"})
    whole = "decimal(19,0)"
    square = F.lit(1_000_000).cast("decimal(7,0)") * (F.col("f").cast("decimal(15,0)") * F.col("f").cast("decimal(15,0)"))
    cuts = [F.struct(F.call_function("div", square, F.col(f"l{k}").cast(whole) * F.col(f"r{k}").cast(whole)).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, size)]
    return materialize(table.select("lang", "words", F.concat_ws(" ", "head", "tail").alias("phrase"), "f", F.array_min(F.array(*cuts)).alias("cut")))


def _kept(tables: list[DataFrame], covers: list[DataFrame], covered: int) -> DataFrame:
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other)
    if covers:
        over = covers[0]
        for other in covers[1:]:
            over = over.unionByName(other)
        over = over.groupBy("lang", "words").agg(F.max("over").alias("over"))
        out = out.join(over, ["lang", "words"], "left").filter(F.col("over").isNull() | (100 * F.col("over") < covered * F.col("f")))
    return out.select("lang", "phrase", F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
