"""n-gram join, substring dedup and language ID against plain versions and on odd rows."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from seqlattice.llm import jaccard, langid, substrings, words  # noqa: E402

ODD = [None, "", "   \n", "one", "One two", "ONE two", "x" * 5000, "ä ö\u00a0ü\x1cz", "a  b\tc\x0bd"]


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=3, n=120):
    """Texts with copies, near copies, shared passages and a hot group."""
    rng = random.Random(seed)
    passage = prose(rng, 60, 10_000)
    out = []
    for k in range(n):
        body = prose(rng, rng.randrange(0, 120), 5_000)
        if k % 4 == 1 and out:
            body = (out[rng.randrange(len(out))] or "").split()
            for _ in range(rng.randrange(0, 4)):
                if body:
                    body[rng.randrange(len(body))] = "new%d" % rng.randrange(9)
        if k % 5 == 2:
            at = rng.randrange(0, len(body) + 1)
            body = body[:at] + passage + body[at:]
        if k % 3 == 0:
            body = passage[:50] + ["end%d" % (k % 7)]
        out.append(" ".join(body))
    return out + ODD


@pytest.mark.parametrize("size,threshold", [(4, 85), (5, 80), (2, 60)])
def test_ngram_join(spark, size, threshold):
    rows = list(enumerate(corpus())) + [(3, corpus()[3]), (None, corpus()[3]), (None, None)]
    docs = spark.createDataFrame([(i, t, "z", 7) for i, t in rows], "doc_id long, text string, component_id string, set_key int")
    got = [tuple(r) for r in jaccard.join(docs, size, threshold).collect()]
    order = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(got, key=order) == sorted(brute.ngram_join(rows, size, threshold), key=order)


def test_ngram_join_in_tiles(spark, monkeypatch):
    """A cell above the limits of one tree is dealt into tiles, and ranges of n-grams are many."""
    rng = random.Random(8)
    base = prose(rng, 80, 3_000)
    rows = []
    for k in range(90):
        body = list(base)
        for _ in range(k % 6):
            body[rng.randrange(80)] = f"n{rng.randrange(40)}"
        rows.append((1000 - k, " ".join(body)))
    monkeypatch.setattr(jaccard, "TREE_SETS", 16)
    monkeypatch.setattr(jaccard, "RANGE", 900)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard.join(docs, 4, 85).collect())
    assert got == sorted(brute.ngram_join(rows, 4, 85))


def test_ngram_join_with_common_grams(spark, monkeypatch):
    """N-grams that most texts share are settled within pieces and ordered by their counters; pieces hold a few texts each."""
    rng = random.Random(12)
    line = prose(rng, 30, 50)
    rows = []
    for k in range(160):
        body = line + prose(rng, rng.randrange(5, 60), 4_000)
        if k % 3 == 1:
            body = rows[rng.randrange(len(rows))][1].split()
            body[-rng.randrange(1, 4)] = f"other{k % 5}"
        rows.append((k, " ".join(body)))
    rows += [(500 + k, rows[k * 5][1]) for k in range(20)]
    monkeypatch.setattr(jaccard, "RANGE", 800)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(map(tuple, jaccard.join(docs, 4, 85).collect())) == sorted(brute.ngram_join(rows, 4, 85))


def test_ngram_join_of_one_id_with_several_texts(spark):
    rng = random.Random(21)
    rows = []
    for k in range(12):
        a, b = prose(rng, 60, 50_000), prose(rng, 50, 50_000)
        rows += [(k, " ".join(a)), (k, " ".join(b)), (100 + k, " ".join(a[:-1] + ["end"])), (200 + k, " ".join(b[:-1] + ["end"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join(docs, 4, 85).collect())) == sorted(brute.ngram_join(rows, 4, 85))


def test_ngram_join_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join(docs).collect() == []
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join(blank).collect())) == [(1, 0, 1), (2, 0, 2)]


def test_tree_finds_every_component():
    rng = np.random.default_rng(5)
    base = np.sort(rng.choice(10_000, 60, replace=False)).astype(np.uint64)
    sets = []
    for _ in range(60):
        keep = base[rng.random(60) > rng.choice([0.02, 0.1, 0.3])]
        more = rng.choice(10_000, rng.integers(0, 8)).astype(np.uint64)
        sets.append(np.unique(np.concatenate([keep, more])))
    tree, links = jaccard.Tree(80), []
    for s in sets:
        links += tree.add(s)
    true = [
        (i, j)
        for i in range(60)
        for j in range(i)
        if 100 * (both := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - both)
    ]
    assert brute.components(range(60), links) == brute.components(range(60), true)
    assert set(map(frozenset, links)) <= set(map(frozenset, true)) and len(links) < 60


@pytest.mark.parametrize("size,prefix,group,piece", [(35, 8, 1 << 20, 4 << 20), (10, 4, 64, 2000), (6, 6, 16, 500)])
def test_substring_dedup(spark, monkeypatch, size, prefix, group, piece):
    """Small groups make prefixes heavy, so that they are dealt by whole windows; small pieces meet only in groups."""
    monkeypatch.setattr(substrings, "PIECE", piece)
    texts = corpus(seed=4) + [corpus(seed=4)[2]] + ["r " * 200]
    docs = spark.createDataFrame([(k % 130, t, "k") for k, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(5)
    got = substrings.dedup(docs, size, prefix, group)
    assert got.columns == ["doc_id", "text", "kept", "n_words", "n_removed"]
    found = sorted((r["doc_id"], r["text"] or "", r["kept"], r["n_words"], r["n_removed"]) for r in got.collect())
    want = brute.substring_dedup(texts, size)
    assert found == sorted((k % 130, t or "", *w) for (k, t), w in zip(enumerate(texts), want))


def test_substring_dedup_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.dedup(docs).collect() == []
    null = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert [tuple(r) for r in substrings.dedup(null).collect()] == [(None, None, "", 0, 0)]


def test_words_are_those_of_split():
    import pyarrow as pa

    texts = corpus(seed=6) + ["é" * 3, "\x85a\x85 b"]
    for size in (10, 1 << 20):
        seen = []
        for row, data, offsets in words.pieces(pa.array(texts), size):
            found = words.split(data, offsets)
            for t in range(found.texts):
                span = range(found.first[t], found.first[t + 1])
                seen.append([bytes(data[found.start[w] : found.end[w]]) for w in span])
        assert seen == [(t or "").encode().split() for t in texts]


LANGS = {"aa": "bato kumi rela", "bb": "schrex vlunt greck", "cc": "ñandé çoua éli"}


def labelled(spark, n=400):
    rng = random.Random(1)
    rows = []
    for k in range(n):
        lang = sorted(LANGS)[k % 3]
        rows.append((k, " ".join(rng.choice(LANGS[lang].split()) + rng.choice("aeiou") for _ in range(rng.randrange(3, 90))), lang))
    return rows


def test_language_id(spark):
    rows = labelled(spark)
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 ... \n", "cc"), (None, "schrexa vlunto", "bb"), (1003, "çouai " * 3000, None), (5, "bato", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "'own' AS score")
    model = langid.train(docs)
    assert model.labels == ["aa", "bb", "cc"]
    got = langid.predict(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    out = [r.asDict() for r in got.withColumn("held", langid.held_out(got["doc_id"])).collect()]
    assert len(out) == len(rows) + len(odd)
    test = [r for r in out if r["held"] and r["lang"] and r["lang_pred"] != "und"]
    assert len(test) > 60 and np.mean([r["lang"] == r["lang_pred"] for r in test]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)
    blank = [r for r in out if not any(c.isalpha() for c in r["text"] or "")]
    assert len(blank) == 3 and all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in blank)
    # The same text, the same answer: id and label are no inputs.
    moved = docs.selectExpr("doc_id + 77 AS doc_id", "text", "'aa' AS lang")
    again = {r["text"]: (r["lang_pred"], r["score"]) for r in langid.predict(moved, model).collect()}
    assert all(again[r["text"]] == (r["lang_pred"], r["score"]) for r in out)


def test_language_id_without_labels(spark):
    docs = spark.createDataFrame([(1, "text", None), (2, None, None)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert [tuple(r)[3:] for r in langid.predict(docs, model).collect()] == [("und", 0.0)] * 2
    none = docs.filter("doc_id > 5")
    assert langid.predict(none, langid.train(none)).collect() == []


def test_language_id_of_many_labels(spark, monkeypatch):
    """No label is left out; with many of them each gives fewer texts."""
    rows = [(k, f"word{k % 70} text", f"l{k % 70:02d}") for k in range(1400)] + [(9_000 + k, "more text", "l00") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(langid, "fit", lambda windows, target, labels: seen.append(np.bincount(target, minlength=len(labels))) or langid.Model(labels, {}))
    want = [f"l{k:02d}" for k in range(70)]
    assert langid.train(docs).labels == want and langid.train(docs, total=140).labels == want
    assert (seen[0] > 0).all() and (seen[1] == 2 * langid.SAMPLE_WINDOWS).all()


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    windows = rng.integers(0, 256, (6, 20)).astype(np.uint8)
    target = rng.integers(0, 3, 6)
    layers = langid.fit(windows, target, ["a", "b", "c"], epochs=1).layers
    layers = {k: v.astype(np.float64) for k, v in layers.items()}
    loss = lambda: -np.log(langid.forward(layers, windows)[0][np.arange(6), target]).mean()
    grads = langid.gradients(layers, windows, target)
    for name, value in layers.items():
        at = np.unravel_index(np.abs(grads[name]).argmax(), value.shape)
        kept = value[at]
        value[at] = kept + 1e-6
        high = loss()
        value[at] = kept - 1e-6
        low = loss()
        value[at] = kept
        assert abs((high - low) / 2e-6 - grads[name][at]) < 1e-5
