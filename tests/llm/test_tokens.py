"""Chunked BPE and packing against the tokenizers library."""

import random
import zlib

import pytest
from seqlattice.llm import bpe, chunks, packing
from seqlattice.llm.queries import tokenizer

TEXTS = [
    None,
    "",
    " ",
    " \n\n",
    "A plain line, with marks. It's don't we'll; 3.14 and 1,000.",
    "trailing space ",
    "  leading\n\n  and   runs \t\t of\r\nspace  ",
    "<|endoftext|> in the text<|endoftext|>x <|STARTOFTEXT|> <|startoftext|>.",
    "non\u00a0breaking \u2003 space\u3000x \x85 y\x1cz",
    "Éé ñ ß İstanbul ΑΣ ﬁ e\u0301 日本語 🙂🙂 \ud7ff",
    "word, " * 3000,
    "x" * 9000,
    "a.b,c.. d,. E., 'quoted.' (see fig.1).",
]


def texts(seed=1, n=60):
    rng = random.Random(seed)
    parts = ["the", "Of", "tion", "é", "end.", "end,", "x\u00a0y", "\n", " ", "12", "it's", "<|endoftext|>", "日本", "--", "naïve"]
    shared = " ".join(rng.choice(parts) for _ in range(300))
    out = list(TEXTS)
    for k in range(n):
        body = " ".join(rng.choice(parts) for _ in range(rng.randrange(0, 200)))
        out.append(body + (shared if k % 3 == 0 else "") + body[: rng.randrange(0, 30)])
    return out


def plain_ids(path, text):
    return bpe.load(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("size", [1, 3, 64])
def test_chunks_are_exact(size):
    """Chunks of one unit too, so that every place is a join."""
    import pyarrow as pa
    from seqlattice.llm import words

    path = tokenizer("byte_bpe_50k.json")
    table = chunks.Chunks(path, size)
    rows = texts()
    for row, data, offsets in words.pieces(pa.array(rows), 20_000):
        ids, first = table.encode(data, offsets)
        for k in range(len(first) - 1):
            assert ids[first[k] : first[k + 1]].tolist() == plain_ids(path, rows[row + k]), rows[row + k]


def test_joins_are_repaired():
    """Cuts inside runs of line ends, which are one token or two together; only the repair makes the ids right."""
    import numpy as np

    path = tokenizer("byte_bpe_50k.json")
    text = "one two\n\n\n three four\n\n\n\n five six seven\n\n\n eight"
    data = np.frombuffer(text.encode(), np.uint8)
    start = np.array([0, *(k for k in range(1, len(text)) if text[k] == "\n" or (text[k] == " " and text[k - 1] != "\n"))])
    end = np.append(start[1:], len(data))
    keys = np.arange(len(start)).astype(np.uint64)
    inside = [k for k in range(1, len(start)) if text[start[k]] == text[start[k] - 1] == "\n"]
    for cuts in ([inside[0]], [inside[1], inside[2]], inside[::2], inside):
        head = np.array([0, *cuts])
        table = chunks.Chunks(path)
        cut = [text[start[a] : end[b - 1]] for a, b in zip(head, [*cuts, len(start)])]
        parts = [np.array(i, np.int32) for i in bpe.encode_many(path, cut)]
        assert np.concatenate(parts).tolist() != plain_ids(path, text)
        table._repair(data, start, end, keys, head, list(range(1, len(head))), parts, np.zeros_like(head), np.full_like(head, len(start)))
        assert np.concatenate(parts).tolist() == plain_ids(path, text)


def test_encode_and_decode(spark):
    path = tokenizer("byte_bpe_50k.json")
    rows = list(enumerate(texts())) + [(None, "no id"), (0, None)]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, ids string")
    got = chunks.encode(docs, path, with_text=True)
    assert got.columns == ["doc_id", "ids", "decoded"]
    want = {(i, t or ""): plain_ids(path, t) for i, t in rows}
    for r in got.collect():
        assert list(r["ids"]) == want[r["doc_id"], r["decoded"]]
    assert got.count() == len(rows)
    back = chunks.decode(got, path)
    assert sorted((r[0] or -1, r[1]) for r in back.collect()) == sorted((i or -1, t or "") for i, t in rows)
    broken = spark.createDataFrame([(1, [240, 159]), (2, None), (3, [50256])], "doc_id long, ids array<int>")
    library = bpe.load(path)
    assert sorted(map(tuple, chunks.decode(broken, path).collect())) == [
        (1, library.decode([240, 159], skip_special_tokens=False)),
        (2, ""),
        (3, "<|endoftext|>"),
    ]
    assert chunks.encode(docs.filter("doc_id > 99999"), path).collect() == []


def test_a_full_table_is_emptied():
    import numpy as np

    path = tokenizer("word_bpe_49k.json")
    table = bpe.Units(path, limit=4)
    for word in ("one", "two", "three", "four", "five", "six", "one"):
        data = np.frombuffer(word.encode(), np.uint8)
        slot = table.lookup(data, np.array([0]), np.array([len(data)]), np.array([hash(word) & (2**63 - 1)], np.uint64))
        assert table.gather(slot)[0].tolist() == plain_ids(path, word)
        assert table.count <= 4


def best_bins(counts, capacity):
    return -(-sum(n * c for n, c in counts.items()) // capacity)


@pytest.mark.parametrize("counts", [{}, {5: 3}, {100: 1}, {60: 7, 40: 7}, {51: 4, 49: 3, 1: 9}, {n: n % 7 + 1 for n in range(1, 101)}, {1: 1_000_000, 99: 1}])
def test_patterns_use_every_piece_once(counts):
    left = dict(counts)
    bins = 0
    for used, times in packing.patterns(counts, 100):
        assert times > 0 and sum(n * k for n, k in used.items()) <= 100
        bins += times
        for n, k in used.items():
            left[n] -= k * times
    assert not any(left.values())
    assert best_bins(counts, 100) <= bins <= best_bins(counts, 100) * 1.05 + 1


def test_fullest_is_the_largest_sum():
    rng = random.Random(4)
    for _ in range(60):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(rng.randrange(1, 7))}
        used = packing.fullest(counts, 60)
        assert used.get(max(counts)) and all(k <= counts[n] for n, k in used.items())
        items = [n for n, c in counts.items() for _ in range(c)]
        items.remove(max(counts))
        sums = {0}
        for n in items:
            sums |= {s + n for s in sums if s + n <= 60 - max(counts)}
        assert sum(n * k for n, k in used.items()) == max(counts) + max(sums)


def test_packing(spark):
    path = tokenizer("word_bpe_49k.json")
    rows = list(enumerate(texts(n=80))) + [(3, " "), (3, " "), (None, None), (900, "far " * 9000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, offset int")
    got = [r.asDict() for r in packing.pack_documents(docs, path, with_ids=True).collect()]
    whole = sorted((i if i is not None else -1, [*plain_ids(path, t), 1]) for i, t in rows)
    want = sorted((i, k // 4096, k, ids[k : k + 4096]) for i, ids in whole for k in range(0, len(ids), 4096))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["piece"], r["start"], list(r["ids"])) for r in got) == want
    places = {}
    for r in got:
        assert r["length"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r["ids"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r["length"] for r in got)
    assert len(places) <= -(-total // 4096) + 1
    assert packing.pack_documents(docs.filter("doc_id > 99999"), path).collect() == []
