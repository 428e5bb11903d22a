"""Read-pair operators: mate pairing, anchor/UMI split, primary transcripts, bottom-k subset."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlattice.contracts import expect, expect_rows, read_rule, require
from seqlattice.functions import reads as R
from seqlattice.schemas import RETAINED_TAGS

# Default anchor and UMI length.
ANCHOR = "TTGCGCAATG"
UMI_LENGTH = 8


def pair_mates(first: DataFrame, second: DataFrame, sample: str = "sample", check: bool = True) -> DataFrame:
    """Join mates by position in their files; ids repeat, so they are compared and not joined on.

    Both inputs have ``sample, ordinal, read_id, seq, qual``. With ``check`` the pairing must be
    complete and the normalised ids equal; without it the faults stay visible in ``mate_status``.
    """
    left = first.select(
        sample, "ordinal", F.col("read_id").alias("_id1"), F.col("seq").alias("seq1"), F.col("qual").alias("qual1")
    )
    right = second.select(
        sample, "ordinal", F.col("read_id").alias("_id2"), F.col("seq").alias("seq2"), F.col("qual").alias("qual2")
    )
    one, two = R.normalize_id("_id1"), R.normalize_id("_id2")
    status = (
        F.when(F.col("_id1").isNull(), "missing_r1")
        .when(F.col("_id2").isNull(), "missing_r2")
        .when(one != two, "id_mismatch")
        .otherwise("paired")
    )
    pairs = left.join(right, [sample, "ordinal"], "full_outer").select(
        sample,
        "ordinal",
        F.coalesce(one, two).alias("read_id"),
        "seq1",
        "qual1",
        "seq2",
        "qual2",
        status.alias("mate_status"),
    )
    if not check:
        return pairs
    expect_rows(pairs, "No read pairs")
    expect(pairs, F.col("mate_status") == "paired", "Mates differ in number or identifier")
    return pairs.drop("mate_status")


def split_umi(pairs: DataFrame, anchor: str = ANCHOR, length: int = UMI_LENGTH) -> DataFrame:
    """Cut the anchor and UMI off mate 1 and class each pair.

    Any non-empty UMI counts, also a short one at the end of a read. A read that ends at the anchor
    is non-UMI, but is trimmed all the same.
    """
    require(bool(anchor), "The anchor must not be empty")
    require(length >= 1, "The UMI length must be at least 1")
    original = F.col("seq1")
    return pairs.select(
        *[c for c in pairs.columns if c not in ("seq1", "qual1", "umi", "umi_class", "anchor_hit")],
        (R.anchor_position(original, anchor) > 0).alias("anchor_hit"),
        R.umi_after(original, anchor, length).alias("umi"),
        R.rest_after(original, original, anchor, length).alias("seq1"),
        R.rest_after("qual1", original, anchor, length).alias("qual1"),
    ).withColumn("umi_class", F.when(F.col("umi") != "", "umi").otherwise("non_umi"))


def umi_only(split: DataFrame) -> DataFrame:
    return split.filter(F.col("umi") != "")


def umi_stats(split: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Extraction counts and the UMI-positive share."""
    total, umi = F.count(F.lit(1)), F.count_if(F.col("umi") != "")
    return split.groupBy(*by).agg(
        total.alias("total_reads"),
        F.count_if("anchor_hit").alias("tso_reads"),
        umi.alias("umi_reads"),
        F.count_if(F.col("umi") == "").alias("non_umi_reads"),
        F.try_divide(umi, total).alias("umi_fraction"),
    )


def annotate_names(split: DataFrame, sample: str = "sample") -> DataFrame:
    """Add the read name carrying cell and UMI tags (``UB:`` stays empty for non-UMI pairs)."""
    return split.withColumn("name", R.annotate_name("read_id", sample, "umi"))


def tag_completeness(tagged: DataFrame, by: Sequence[str] = (), mode: str | None = None) -> DataFrame:
    """Rows in all and rows with both CB and UB; ``mode`` ``any`` or ``all`` makes it a check."""
    both = (F.coalesce("CB", F.lit("")) != "") & (F.coalesce("UB", F.lit("")) != "")
    counted = tagged.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(both).alias("tagged"))
    if mode == "any":
        expect(expect_rows(counted, "No records"), F.col("tagged") > 0, "No record carries both tags")
    elif mode == "all":
        valid = (F.col("total") > 0) & (F.col("tagged") == F.col("total"))
        expect(expect_rows(counted, "No records"), valid, "Some records lack a tag")
    return counted


def primary_transcripts(sam: DataFrame, length: int = 96, check: bool = True) -> DataFrame:
    """Primary alignments as reads in sequencing orientation, cut to a fixed length.

    The star read name carries query name and tags, percent-encoded, so nothing is lost downstream.
    """
    require(length >= 1, "The read length must be positive")
    kept = sam.filter(R.is_primary("flag"))
    if check:
        usable = read_rule(length=length)
        expect(kept.select("qname", "seq", "qual"), usable, f"Reads need sequence and quality of at least {length}")
    reverse = R.is_reversed("flag")
    sequence = F.when(reverse, R.reverse_complement("seq")).otherwise(F.col("seq"))
    quality = F.when(reverse, F.reverse("qual")).otherwise(F.col("qual"))
    tags = {tag: R.tag_or_empty("tags", tag) for tag in RETAINED_TAGS}
    name = F.concat(
        F.lit("Q="), R.percent_encode("qname"), *[F.concat(F.lit(f"|{t}="), R.percent_encode(v)) for t, v in tags.items()]
    )
    carried = [c for c in ("ordinal",) if c in sam.columns]
    return kept.select(
        *carried,
        name.alias("star_read_name"),
        F.col("qname").alias("original_qname"),
        *[v.alias(t) for t, v in tags.items()],
        F.substring(sequence, 1, length).alias("seq"),
        F.substring(quality, 1, length).alias("qual"),
    )


def _blake2b(seed: str):
    @F.pandas_udf("string")
    def score(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: hashlib.blake2b(f"{seed}\0{k}".encode(), digest_size=16).hexdigest())

    return score


def selection_score(key: Column | str, seed: str | int, method: str = "blake2b") -> Column:
    """Fixed-width hex score of a read id, so text order is numeric order."""
    key = F.col(key) if isinstance(key, str) else key
    if method == "sha256":
        return F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)
    require(method == "blake2b", "method must be 'blake2b' or 'sha256'")
    return _blake2b(str(seed))(key)


def bottom_k(
    df: DataFrame,
    key: str,
    k: int,
    seed: str | int,
    ordinal: str = "ordinal",
    method: str = "blake2b",
    check: bool = True,
    by: Sequence[str] = (),
) -> DataFrame:
    """The ``k`` rows of each ``by`` group with the smallest seeded hash, renumbered from 1 in input order.

    ``by`` and ``ordinal`` together name a row. Only they and the key are sorted, as a top-k; the rows themselves come from
    a join with the picks. ``check`` asks for ``k`` rows in each group.
    """
    place = [*by, ordinal]
    scored = df.select(*place, selection_score(key, seed, method).alias("_score"))
    if by:
        least = Window.partitionBy(*by).orderBy("_score", ordinal)
        picked = scored.withColumn("_rank", F.row_number().over(least)).filter(F.col("_rank") <= k)
        if check:
            expect(scored.groupBy(*by).agg(F.count(F.lit(1)).alias("rows")), F.col("rows") >= k, f"Fewer than {k} rows to choose from")
    else:
        picked = scored.orderBy("_score", ordinal).limit(k)
        if check:
            found = scored.limit(k).count()
            require(found == k, f"{k} rows are asked for, and the input has {found}")
    # At most k rows in a window: k is the size of the subset asked for.
    inside = Window.partitionBy(*by).orderBy(ordinal) if by else Window.orderBy(ordinal)
    numbered = picked.select(*place, F.row_number().over(inside).cast("bigint").alias("output_index"))
    return df.join(numbered, place)


def subset_summary(
    pairs: DataFrame, chosen: DataFrame, sample: str, seed, anchor=ANCHOR, length=UMI_LENGTH, method: str = "blake2b"
) -> DataFrame:
    """Provenance counts of a subset as ``metric, value`` rows; ``method`` is that of ``bottom_k``."""
    complete = R.has_complete_umi("seq1", anchor, length)

    def counts(df: DataFrame, label: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(complete).alias("c")).select(
            F.explode(
                F.array(
                    F.struct(F.lit(f"{label}_read_pairs").alias("metric"), F.col("n").cast("string").alias("value")),
                    F.struct(
                        F.lit(f"{label}_complete_tso_umi_pairs").alias("metric"), F.col("c").cast("string").alias("value")
                    ),
                )
            ).alias("m")
        ).select("m.*")

    fixed = [
        ("sample", sample),
        ("selection_method", f"smallest_{method}_read_id_hashes"),
        ("selection_seed", str(seed)),
        ("tso_sequence", anchor),
        ("umi_length", str(length)),
    ]
    head = pairs.sparkSession.createDataFrame(fixed, "metric STRING, value STRING")
    return head.unionByName(counts(pairs, "source_total")).unionByName(counts(chosen, "selected"))
