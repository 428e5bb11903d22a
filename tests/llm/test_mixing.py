"""Source mixtures: exact water levels, whole words, repeatable choices."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlattice.llm import mixing


def levels(sizes, weights, total, epochs):
    """Targets by filling round after round, in fractions."""
    targets = {s: Fraction(0) for s in sizes}
    open_ = {s for s in sizes if weights.get(s)}
    left = Fraction(total)
    while open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= epochs * sizes[s]}
        if not full:
            return targets | share
        for s in full:
            targets[s] = Fraction(epochs * sizes[s])
            left -= targets[s]
        open_ -= full
    return targets


def table(spark, seed=0, n=600):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        source = None if k % 7 == 0 else "hot" if k % 3 == 0 else f"s{int(rng.integers(0, 12))}"
        size = [None, 0, 1, int(rng.integers(1, 40)), int(rng.integers(100, 900))][int(rng.integers(0, 5))]
        rows.append((None if k % 50 == 0 else k, source, size))
    rows += [(7777, "hot", 11)] * 40
    return rows, spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, source string, size long, `mix_hash.a` string, TAKEN int").repartition(7)


@pytest.mark.parametrize("epochs,total", [(3, None), (1, None), (3, 2000), (5, 10**7), (3, 0)])
def test_targets_and_words(spark, epochs, total):
    rows, docs = table(spark)
    weights = {s: 5 if s is None else 1 + len(s) % 3 for _, s, _ in rows if s != "s3"}
    given = spark.createDataFrame(list(weights.items()), "source string, weight int")
    found = mixing.mix(docs, given, total=total, epochs=epochs, seed=3)
    assert found.columns == ["doc_id", "source", "size", "mix_hash.a", "source_size", "target", "taken"]
    got = found.collect()
    assert sorted(map(str, ((r["doc_id"], r["source"], r["size"]) for r in got))) == sorted(map(str, rows))
    sizes, taken = {}, {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + (n or 0)
    want = levels(sizes, weights, sum(sizes.values()) if total is None else total, epochs)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(float(want[r["source"]]), rel=1e-12)
        assert 0 <= r["taken"] <= epochs * (r["size"] or 0)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in sizes:
        # Rows of one key at the edge share what is left, each rounded down.
        assert want[s] - 45 <= taken[s] <= want[s]


def test_reruns_agree_however_rows_are_split_and_seeds_differ(spark):
    rows, docs = table(spark, 4)
    given = docs.select("source").distinct().select("source", F.lit(1).alias("weight"))
    runs = [sorted(map(str, mixing.mix(d, given, seed=s).collect())) for d, s in ((docs, 1), (docs.repartition(2, "size"), 1), (docs, 2))]
    assert runs[0] == runs[1] != runs[2]


def test_hot_keys_only_and_no_rows(spark, monkeypatch):
    rows, docs = table(spark, 5, 80)
    given = docs.select("source").distinct().select("source", F.lit(2).alias("weight"))
    whole = sorted(map(str, mixing.mix(docs, given).collect()))
    monkeypatch.setattr(mixing, "HOT", 3)
    assert sorted(map(str, mixing.mix(docs, given).collect())) == whole
    assert mixing.mix(docs.limit(0), given).collect() == []
    assert {r["taken"] for r in mixing.mix(docs, given.limit(0)).collect()} == {0}


def test_written_out_repetitions_have_the_words_taken(spark):
    texts = ["a b c d e", "f  g\th", None, "", "i", "j k\nl m n o p"]
    docs = spark.createDataFrame([(k, "s" if k % 2 else "t", t) for k, t in enumerate(texts)], "doc_id long, source string, text string")
    sized = docs.withColumn("size", mixing.word_count(F.col("text")))
    assert [r["size"] for r in sized.orderBy("doc_id").collect()] == [5, 3, 0, 0, 1, 7]
    given = spark.createDataFrame([("s", 1), ("t", 5)], "source string, weight int")
    mixed = mixing.mix(sized, given)
    out = mixing.repeated(mixed).collect()
    count = {}
    for r in out:
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + len(r["text"].split())
        assert texts[r["doc_id"]].split()[: len(r["text"].split())] == r["text"].split()
    assert count == {r["doc_id"]: r["taken"] for r in mixed.collect() if r["taken"]}
