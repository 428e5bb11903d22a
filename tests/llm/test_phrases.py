"""Collocations against plain counting."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from seqlattice.llm import bloom, phrases
from tests.llm.brute import LOWER


def plain(rows, max_words, least, covered, top):
    count, size = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            size[lang] += len(w)
            for m in range(1, max_words + 1):
                count[lang].update(tuple(w[k : k + m]) for k in range(len(w) - m + 1))
    out = []
    for lang, f in count.items():
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        over = Counter()
        for p, a in frequent.items():
            for m in range(2, len(p)):
                for k in range(len(p) - m + 1):
                    over[p[k : k + m]] = max(over[p[k : k + m]], a)
        found = []
        for p, a in frequent.items():
            if 100 * over[p] >= covered * a and over[p]:
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, size[lang], -score))
    return sorted(out)


def texts(seed, n):
    rng = np.random.default_rng(seed)
    vocabulary = ["the", "The", "of", "Über", "naïve", "x"] + [f"w{k}" for k in range(12)]
    rows = []
    for _ in range(n):
        k = int(rng.integers(0, 40))
        words = rng.choice(vocabulary, k, p=np.arange(len(vocabulary), 0, -1) / sum(range(len(vocabulary) + 1)))
        ends = rng.choice([" ", "  ", "\t", ", ", ".", "\n", " "], k, p=[0.6, 0.1, 0.05, 0.1, 0.05, 0.05, 0.05])
        rows.append(("".join(a + b for a, b in zip(words, ends)), [None, "en", "de", "und"][int(rng.integers(0, 4))]))
    return rows


@pytest.mark.parametrize("max_words,least,top,hot", [(3, 10, 2000, 4096), (3, 4, 25, 8), (4, 3, 2000, 16), (2, 2, 7, 4)])
def test_counts_scores_and_subsumption(spark, monkeypatch, max_words, least, top, hot):
    # With few parts allowed for all prefixes, several stripes are cut; small blocks make many stripes of one prefix.
    monkeypatch.setattr(phrases, "HOT", hot)
    monkeypatch.setattr(phrases, "FLUSH", 500)
    rows = texts(3, 220) + [("the the the the", "en")] * 12 + [(None, "en"), ("", None), (" \n.", "fr"), ("one word", "fr")]
    docs = spark.createDataFrame([(t, x, k) for k, (t, x) in enumerate(rows)], "text string, lang string, `part.of` int").repartition(5)
    found = phrases.collocations(docs, max_words=max_words, least=least, top=top)
    assert sorted(map(tuple, found.collect())) == plain(rows, max_words, least, 50, top)


def test_few_ranked_rows_per_task_give_the_same_ranks(spark, monkeypatch):
    docs = spark.createDataFrame(texts(5, 150), "text string, lang string")
    whole = sorted(map(tuple, phrases.collocations(docs, least=3, top=9).collect()))
    monkeypatch.setattr(phrases, "RANKED", 20)
    assert sorted(map(tuple, phrases.collocations(docs, least=3, top=9).collect())) == whole


def test_no_rows_and_no_frequent_phrases(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(docs).collect() == []
    assert phrases.collocations(spark.createDataFrame([("a b c", "en")], "text string, lang string")).collect() == []


def test_merge_joins_stripes_over_batches():
    def stripe(prefix, part, rest, nexts, counts):
        binary = [np.array(v, t).tobytes() for v, t in ((prefix, "<u8"), (nexts, "<u8"), (counts, "<u4"))]
        return ("en", binary[0], part, rest, binary[1], binary[2])

    rows = [stripe([1], -1, 1, [5, 6], [2, 1]), stripe([1], -1, 0, [6], [3]), stripe([1], -1, 4, [], []), stripe([2], 0, 3, [], []), stripe([2], 1, 0, [7], [1]), stripe([3], -1, 0, [9], [1])]
    types = [pa.string(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    for cut in range(1, 7):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + cut]), types)], ["lang", "prefix", "part", "rest", "nexts", "counts"]) for k in range(0, 6, cut)]
        found = [tuple(r.values()) for b in phrases.merge(iter(batches), 2, 2) for r in b.to_pylist()]
        assert found == [("en", [1], 11, 4, [5, 6], [2, 4]), ("en", [2], 3, 0, [], []), ("en", [2], 1, 0, [], [])]


def test_filter_keeps_all_members(spark):
    rows = [("en" if k % 2 else "de", [k, k * 7 - 3]) for k in range(3000)]
    table = spark.createDataFrame(rows, "lang string, words array<long>")
    likely = phrases.bloom_filter(table, len(rows))
    keys = phrases._phrase_hashes(pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]))
    assert bloom.contains(likely, keys).all()
    others = phrases._phrase_hashes(pa.array(["fr"] * 3000), pa.array([r[1] for r in rows]))
    assert bloom.contains(likely, others).mean() < 0.02
