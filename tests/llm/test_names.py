"""Extra columns, whatever they are called, come through every operator that keeps them; ids with several texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqlattice.llm import jaccard, langid, mixing, sharding, substrings

# Helper columns of the operators, their outputs, and names that need quotes.
CLASHING = [
    "row_key", "row_text", "span_key", "spans", "plain_text", "key_slot", "table_slot", "table_shard", "slot", "words_kept", "words_all", "words_removed",
    "lang_found", "lang_score", "row_id", "row_copy", "copy_id", "copy_text", "copy_stays", "set_key", "text_key", "component_id", "stays", "rows", "start",
    "mix_source", "mix_size", "mix_hash", "mix_plan", "mix_source_of", "source_of", "a.b", "c`d", "TEXT_KEY2", "Row_Number", "e f", "__key", "__text", "__lang", "__kept", "__copy",
]


def table(spark):
    rng = np.random.default_rng(9)
    words = [f"kumi{k}" for k in range(60)]
    base = [" ".join(rng.choice(words, 90)) for _ in range(6)]
    rows = [(k, base[k % 6] if k % 2 else " ".join(rng.choice(words, 50)), "aa" if k % 3 else "bb", "src", k) for k in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long")
    extra = [F.concat(F.lit(f"{n}-"), "doc_id").alias(n) for n in CLASHING]
    return docs.select("*", *extra)


def untouched(out):
    values = out.select("doc_id", *[F.col("`" + n.replace("`", "``") + "`") for n in CLASHING]).collect()
    return all(tuple(r)[1:] == tuple(f"{n}-{r['doc_id']}" for n in CLASHING) for r in values)


def test_stages_keep_all_columns(spark):
    docs = table(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and untouched(out)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 24


def test_operators_keep_all_columns(spark):
    docs = table(spark)
    weights = spark.createDataFrame([("src", 1)], "source string, weight int")
    done = [
        substrings.dedup(docs), langid.predict(docs, langid.train(docs)), mixing.mix(docs, weights),
        sharding.place(docs.drop("slot").withColumn("slot2", F.col("doc_id")), "a.b", ["x", "y"]).withColumn("slot", F.concat(F.lit("slot-"), "doc_id")), jaccard.representatives(docs),
    ]
    for out in done:
        assert out.count() and untouched(out)


@pytest.mark.parametrize("shared", [True, False])
def test_one_row_of_each_group_stays(spark, shared):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(200)]
    text = [" ".join(rng.choice(words, 60)) for _ in range(12)]
    near = lambda t: t.rsplit(" ", 1)[0] + " other"
    rows = [(k, text[k]) for k in range(8)] + [(20, near(text[1])), (21, text[2]), (21, near(text[2])), (3, text[3]), (3, text[3])]
    # An id with two texts, one of them a copy of a smaller document's; the other is its own and stays.
    rows += [(30, text[4]), (30, text[9]), (31, None), (31, ""), (31, ""), (None, text[5]), (None, text[5]), (40, text[10]), (41, text[10])]
    if shared:
        rows += [(50, near(text[11])), (50, text[11])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, jaccard.representatives(docs).collect()), key=str)
    want = [(k, text[k]) for k in range(8)] + [(30, text[9]), (31, None), (31, ""), (None, text[5]), (None, text[5]), (40, text[10])]
    if shared:
        # Two linked texts of one id: one row stays.
        kept = [r for r in got if r[0] == 50]
        assert len(kept) == 1 and kept[0][1] in (text[11], near(text[11]))
        want += kept
    assert got == sorted(want, key=str)


def test_ngrams_that_agree_in_their_high_bits_are_not_lost():
    high = np.arange(1, 2001, dtype=np.uint64) << np.uint64(44)
    one = np.sort(np.concatenate([high, high | np.uint64(5)]))
    sent, counted = jaccard._settled([one, one + np.uint64(1)])
    # Half of the n-grams share their 31 high bits with another of their set; none may be missing in the bound.
    assert (counted >= 2000).all()


def test_prefixes_of_long_texts_do_not_depend_on_the_place(monkeypatch):
    rng = np.random.default_rng(3)
    passage = [f"p{k}" for k in range(60)]
    long = [f"x{k}" for k in rng.integers(0, 50, 3000)] + passage
    data = (" ".join(long) + " ".join(passage)).encode()
    cut = len(" ".join(long))
    offsets = np.array([0, cut, len(data)])
    plain = substrings._windows(np.frombuffer(data, np.uint8), offsets, 35, 8)
    for stretch in (40, 128, 1000):
        monkeypatch.setattr(substrings, "STRETCH", stretch)
        found = substrings._windows(np.frombuffer(data, np.uint8), offsets, 35, 8)
        assert all((a == b).all() for a, b in zip(plain, found))
    assert (plain[3][-26:] == plain[3][-52:-26]).all() and (plain[4][-26:] == plain[4][-52:-26]).all()


def test_texts_of_more_words_than_a_place_has_bits_for():
    size = (1 << 24) + 400
    head = np.full(2 * size, 0x20, np.uint8)
    head[::2] = np.random.default_rng(1).integers(97, 123, size, dtype=np.uint8)
    tail = head[-2 * 194 :]
    data = np.concatenate([head, tail])
    text, local, anchor, prefix, whole = substrings._windows(data, np.array([0, len(head), len(data)]), 35, 8)
    first, second = text == 0, text == 1
    assert (whole[first][-160:] == whole[second]).all() and (prefix[first][-160:] == prefix[second]).all()


