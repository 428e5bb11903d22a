"""The pipeline against plain versions of its stages."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from test_texts import LANGS  # noqa: E402
from test_tokens import plain_ids  # noqa: E402

from seqlattice.llm import langid  # noqa: E402
from seqlattice.llm.queries import tokenizer  # noqa: E402


def rows():
    rng = random.Random(2)
    word = lambda lang: rng.choice(LANGS[lang].split()) + "".join(rng.choice("aeiou") for _ in range(3))
    passage = [word("aa") for _ in range(70)]
    out = []
    for k in range(150):
        lang = sorted(LANGS)[k % 3]
        body = [word(lang) for _ in range(rng.randrange(20, 120))]
        if k % 10 == 3:
            body[5:5] = passage
        if k % 7 == 4:
            body = out[-3][1].split()
            lang = out[-3][2]
            body[rng.randrange(len(body))] = "changed"
        out.append((k, " ".join(body), lang, "s", 0))
    return out + [(200, None, "aa", "s", None), (201, "12 34", "bb", None, 5), (202, "", None, "s", 0), out[0], (203, out[0][1], "aa", "s", 0), (None, "bato kumia", "aa", "s", 9)]


def test_stages(spark, tmp_path):
    data = rows()
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = [(r[0], r[1]) for r in data if any(c.isalpha() for c in r[1] or "")]
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "pack":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen.append(docs)
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    assert pairs(seen[0]) == sorted(kept, key=str)
    group = brute.ngram_join(kept, 5, 80)
    single = {k for (k, _), (_, _, c) in zip(kept, group) if c is None or k == c}
    kept = sorted({r for r in kept if r[0] in single}, key=str)
    assert pairs(seen[1]) == kept and len(kept) < 145
    cut = brute.substring_dedup([t for _, t in kept], 35)
    assert pairs(seen[2]) == sorted(((k, c[0]) for (k, _), c in zip(kept, cut)), key=str)
    assert sum(c[2] for c in cut) > 500
    assert all(r["n_chars"] == len(r["text"]) for r in seen[2].collect())
    path = tokenizer("word_bpe_49k.json")
    assert sorted(((r["doc_id"], r["length"]) for r in seen[3].collect()), key=str) == sorted(((k, len(plain_ids(path, c[0])) + 1) for (k, _), c in zip(kept, cut)), key=str)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    lengths = lambda df: sorted(((r["doc_id"], r["length"], r["ids_crc32"]) for r in df.collect()), key=str)
    assert lengths(whole) == lengths(seen[3])


def test_extra_columns_pass(spark):
    docs = spark.createDataFrame(
        [(k, " ".join(f"kumi{(k * 7 + j) % 50}" for j in range(20)), "aa", k, 1.5, "x", [1]) for k in range(8)],
        "doc_id long, text string, lang string, component_id long, score double, kept string, n_words array<int>",
    )
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.drop("text").exceptAll(docs.drop("text")).count() == 0


def test_nothing_in_nothing_out(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").collect() == []


def test_texts_stay_without_labels(spark, tmp_path):
    """Null labels, no text to learn from: letterless texts go, the others reach the end."""
    data = [(k, " ".join(f"w{k}x{j}" for j in range(20)), None) for k in range(8)] + [(20, None, None), (21, "12 34", None), (None, "bato", None)]
    spark.createDataFrame(data, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    held = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "aa"))
    for some in (docs, held):
        out = corpus_pipeline.language_id(spark, some, "")
        assert out.columns == docs.columns
        assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted([*range(8), None], key=str)
    ended = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert ended == {*range(8), None}


def test_a_task_of_the_ngram_join_has_one_python_worker(spark, monkeypatch):
    from seqlattice.llm import jaccard
    from seqlattice.session import materialize

    rows = [(k, " ".join(f"w{j}" for j in range(40)) + f" x{k % 3}") for k in range(12)]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string"))
    seen = []

    def stages(node, held):
        """The steps in Python of each stage: exchanges part stages."""
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return stages(node.initialPlan(), held)
        if "Exchange" in name:
            held = []
            seen.append(held)
        if "Arrow" in name or "Python" in name:
            held.append(name)
        for k in range(node.children().size()):
            stages(node.children().apply(k), held)

    def noted(df, *more):
        seen.append([])
        stages(df._jdf.queryExecution().executedPlan(), seen[-1])
        return materialize(df, *more)

    monkeypatch.setattr(jaccard, "materialize", noted)
    assert jaccard.representatives(docs).count() == 1
    assert any(seen) and max(map(len, seen)) == 1


def test_stages_limit_the_bytes_of_a_batch(spark):
    """One partition of 12 MB reaches Python in several batches after any stage, whole; before, in one. A user's own limit stays."""
    import pyarrow as pa

    from seqlattice.session import ARROW_BYTES

    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = [(k, " ".join(f"kumi{(k * 7 + j) % 50}" for j in range(20)), "aa") for k in range(4)]

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])

    for _, stage in corpus_pipeline.STAGES:
        session = spark.newSession()
        stage(session, session.createDataFrame(rows, "doc_id long, text string, lang string"), "")
        wide = session.range(0, 3000, 1, 1).select(F.repeat(F.lit("kumi"), 1000).alias("text"))
        seen = wide.mapInArrow(sizes, "rows long, bytes long").collect()
        assert sum(r["rows"] for r in seen) == 3000
        assert max(r["bytes"] for r in seen) < 1.5 * ARROW_BYTES
    session = spark.newSession()
    session.conf.set(limit, "1m")
    corpus_pipeline.language_id(session, session.createDataFrame(rows, "doc_id long, text string, lang string"), "")
    assert session.conf.get(limit) in ("1m", "1048576b")
