"""From documents to packed sequences: language ID, near-duplicate removal, substring dedup, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept. All but the last return the columns
of their input, whatever those are; ``doc_id``, ``text`` and, for training, ``lang`` are read. Executors and their workers are
the same for all stages, and each keeps most of what any stage took, so every stage limits the session's Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlattice.llm import jaccard, langid, names, packing, substrings
from seqlattice.llm.queries import tokenizer
from seqlattice.session import materialize, small_batches

# The network needs training, which SQL cannot express.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a label from the network, which are those with a letter; null texts and texts without a letter go.

    Without a label to learn from, the same texts stay.
    """
    small_batches(docs.sparkSession)
    model = langid.train(docs)
    if not model.labels:
        return docs.filter(langid.has_letter(F.col("text").cast("string")))
    lang, score = names.free(docs, "lang_found", "lang_score")
    named = langid.predict(docs, model, lang_col=lang, score_col=score)
    return named.filter(F.col(lang) != langid.UNKNOWN).select(*names.columns(docs))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles link at 0.8 or more: that with the smallest id.

    Of rows that agree in id and text one stays. Rows with a null id link with nothing and all stay.
    """
    small_batches(docs.sparkSession)
    return jaccard.representatives(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages of 35 words or more that occur more than once; ``n_chars``, if there, follows."""
    small_batches(docs.sparkSession)
    kept, *counts = names.free(docs, "words_kept", "words_all", "words_removed")
    done = substrings.dedup(docs, kept_col=kept, counts=tuple(counts))
    new = {"text": F.col(kept), "n_chars": F.length(kept).cast("long")}
    return done.select(*[new[c].alias(c) if c in new else names.col(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 ids."""
    small_batches(docs.sparkSession)
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("ngram_join", ngram_join), ("substring_dedup", substring_dedup), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each result written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
