"""Mixtures of sources by capped water-filling; DataFrame functions only.

Each source gets words in proportion to its weight, but never more than ``epochs`` times its own. Sources above that are
clamped to it and what they leave is shared out among the others by weight, again and again until none is above. The
water level, words for a unit of weight, is an exact fraction, and only it and counts reach the driver.

A target is a whole number of repetitions of the source and a part of one. The part goes to the documents that come first in
the order of a seeded hash. Where that order reaches the target is found in steps, by ranges of the hash and then by ranges and
hashes of the range found, so no task sorts a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlattice.llm.hot import HOT, lookup
from seqlattice.llm.names import col, columns, free
from seqlattice.session import materialize

EPOCHS = 3
# Leading hexadecimal digits of a hash that name its range, from step to step; the last step takes whole hashes. No step but the last
# has more than 4,096 ranges of a source, and the last has one hash for each 16 million of its documents.
DIGITS = (3, 6, 32)
_BIG = "decimal(38,0)"


def word_count(text: Column) -> Column:
    """The number of words ``[^\\x20\\x09-\\x0D]+``; 0 for a null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_level(sources: DataFrame, total: int, epochs: int = EPOCHS) -> tuple[int, int]:
    """``words, weight``: a source of weight ``w`` that is not clamped gets ``w * words / weight``; weight 0 means that all are clamped.

    ``sources`` has ``source_size`` and ``weight``. Each round is one aggregate over it.
    """
    left, weight, clamped = total, 0, -1
    while True:
        # Nothing is clamped in the first round.
        full = F.lit(False) if clamped < 0 else _full(left, weight, epochs)
        row = sources.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size").cast(_BIG) * epochs)), F.lit(0)).alias("words"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weight"),
            F.count(F.when(full, 1)).alias("clamped"),
        ).first()
        left, weight = total - int(row["words"]), int(row["weight"])
        if row["clamped"] == clamped or not weight:
            return left, weight
        clamped = row["clamped"]


def _full(words: int, weight: int, epochs: int) -> Column:
    """Whether a source's share at this level reaches ``epochs`` times its size."""
    if not weight:
        return F.lit(True)
    return F.col("source_size").cast(_BIG) * F.lit(epochs * weight).cast("decimal(19,0)") <= F.col("weight").cast("decimal(19,0)") * F.lit(words).cast("decimal(19,0)")


def targets(sizes: DataFrame, weights: DataFrame, total: int | None = None, epochs: int = EPOCHS) -> DataFrame:
    """``source, source_size, target, goal, whole, part`` of each source of ``sizes`` (``source``, ``source_size``).

    ``weights`` has ``source, weight`` (whole, positive), one row each; a source without weight gets nothing. ``total`` words are
    shared, all words where it is null. ``goal`` is the target in whole words: ``whole`` times the source and ``part`` words.
    """
    weighted = sizes.join(weights, sizes["source"].eqNullSafe(weights["source"]), "left")
    table = materialize(weighted.select(sizes["source"], "source_size", F.coalesce(F.col("weight"), F.lit(0)).cast("long").alias("weight")))
    if total is None:
        total = int(table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    words, weight = water_level(table.filter("weight > 0"), total, epochs)
    full = (F.col("weight") > 0) & _full(words, weight, epochs)
    share = F.col("weight").cast("decimal(19,0)") * F.lit(words).cast("decimal(19,0)")
    some = max(weight, 1)
    out = table.select(
        "source",
        "source_size",
        F.when(full, (F.col("source_size") * epochs).cast("double")).otherwise(share.cast("double") / F.lit(float(some))).alias("target"),
        F.when(full, F.col("source_size") * epochs).otherwise(_div(share, F.lit(some).cast("decimal(19,0)"))).alias("goal"),
    )
    out = out.withColumn("whole", F.when(F.col("source_size") > 0, _div(F.col("goal"), F.col("source_size"))).otherwise(0).cast("long"))
    return out.withColumn("part", F.col("goal") - F.col("whole") * F.col("source_size"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def mix(
    docs: DataFrame,
    weights: DataFrame,
    key_col: str = "doc_id",
    source_col: str = "source",
    size_col: str = "size",
    total: int | None = None,
    epochs: int = EPOCHS,
    seed: int = 0,
) -> DataFrame:
    """``docs`` with ``source_size``, ``target`` (both of its source) and ``taken``, the words of it that the mixture takes.

    A document is taken ``taken div size`` times and then for its first ``taken % size`` words; ``repeated`` writes that out. A
    source's taken words are its target rounded down, but for documents that share a key: all rows of one key at the edge
    take equal parts, each rounded down. Nothing is taken more than ``epochs`` times. The same rows and seed give the
    same result, however they are split.

    Null sources are a source, null sizes count as 0 and null keys as one key; repeated rows are so many documents; an empty
    table gives an empty result. Columns of ``docs`` with the new names are replaced, all others kept, whatever their
    names. ``docs`` is read four times, so it should be a written table without texts, or one whose sizes are stored.
    """
    new = ("source_size", "target", "taken")
    source, size, order = free(docs, "mix_source", "mix_size", "mix_hash")
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(col(key_col).cast("string"), F.lit("")))
    added = [col(source_col).alias(source), F.coalesce(col(size_col).cast("long"), F.lit(0)).alias(size), F.md5(text.cast("binary")).alias(order)]
    rows = docs.select(*columns(docs, new), *added)
    slim = rows.select(F.col(source).alias("source"), F.col(size).alias("size"), F.col(order).alias("hash"))

    held = slim.groupBy("source", F.substring("hash", 1, DIGITS[0]).alias("range")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    held = materialize(held)
    sizes = held.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("rows").alias("rows"))
    goals = targets(sizes, weights, total, epochs).join(sizes.select(F.col("source").alias("counted"), "rows"), F.col("source").eqNullSafe(F.col("counted"))).drop("counted")
    goals = materialize(goals)

    edge = goals.filter("part > 0").select(F.col("source").alias("of"), "part")
    sums = held.join(edge, F.col("source").eqNullSafe(F.col("of")))
    for digits, more in zip(DIGITS, (*DIGITS[1:], 0)):
        # The range of hashes in which the part of a source ends, and what is left of the part there.
        before = F.sum("words").over(Window.partitionBy("source").orderBy("range")) - F.col("words")
        found = sums.withColumn("before", before).filter("before <= part AND part < before + words")
        edge = found.select(F.col("source").alias("of"), F.col("range").alias("edge"), (F.col("part") - F.col("before")).alias("part"), F.col("words").alias("edge_words"))
        if more:
            inside = slim.join(edge, F.col("source").eqNullSafe(F.col("of")) & (F.substring("hash", 1, digits) == F.col("edge")))
            sums = inside.groupBy("source", F.substring("hash", 1, more).alias("range"), "part").agg(F.sum("size").alias("words"))
    last = edge.select("of", F.col("edge").alias("last"), F.col("part").alias("room"), F.col("edge_words").alias("words"))

    plan = materialize(goals.join(last, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "rows", F.struct("source_size", "target", "whole", "last", "room", "words").alias("plan")))
    every = int(plan.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
    (known,) = free(rows, "mix_plan")
    found = lookup(rows, plan.select(F.col("source").alias(f"{source}_of"), F.col("plan").alias(known), F.col("rows").alias(f"{source}_rows")), {source: f"{source}_of"}, F.col(f"{source}_rows") * HOT > every)
    p, n = F.col(known), F.col(size)
    extra = F.when(F.col(order) < p["last"], n).when(F.col(order) == p["last"], _div(n.cast("decimal(19,0)") * p["room"].cast("decimal(19,0)"), p["words"].cast("decimal(19,0)"))).otherwise(0)
    return found.select(*columns(docs, new), p["source_size"].alias("source_size"), p["target"].alias("target"), (n * p["whole"] + F.coalesce(extra, F.lit(0))).cast("long").alias("taken"))


def repeated(mixed: DataFrame, text_col: str = "text", size_col: str = "size") -> DataFrame:
    """The documents of ``mixed`` as often as they are taken, with ``repetition`` from 1; a last, cut one has its first words, joined by one space."""
    (at,) = free(mixed, "repetition")
    size = F.greatest(F.coalesce(col(size_col), F.lit(0)).cast("long"), F.lit(1))
    times = F.ceil(F.col("taken") / size)
    rest = F.col("taken") - (F.col(at) - 1) * size
    words = F.regexp_extract_all(col(text_col), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(rest < size, F.array_join(F.slice(words, F.lit(1), rest.cast("int")), " ")).otherwise(col(text_col))
    out = mixed.filter("taken > 0").select("*", F.explode(F.sequence(F.lit(1).cast("long"), times)).alias(at))
    return out.select(*[text.alias(c) if c == text_col else col(c) for c in mixed.columns], F.col(at))
