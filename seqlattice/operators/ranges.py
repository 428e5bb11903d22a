"""Range joins by coordinate bins, or by a sweep where bins do not fit the intervals, and read-to-gene assignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlattice.functions.regions import aligned_blocks
from seqlattice.operators.sweep import block_extremes, sweep_join, sweep_overlaps

BIN = "_bin"

# An interval table is broadcast only if its binned form was counted and is no larger than this.
BROADCAST_ROWS = 500_000
# Bytes of an exon table that goes to all tasks.
BROADCAST_BYTES = 64 << 20
# Larger tables are shuffled by bins if an interval has no more than SPREAD bins on average and a bin no more than CROWD intervals.
SPREAD = 4
CROWD = 1024
# Smallest bin for exons.
EXON_BIN = 512


def _div(value, size: int):
    return F.floor(F.col(value) / F.lit(size)).cast("bigint")


def _binned(intervals: DataFrame, start: str, end: str, size: int) -> DataFrame:
    return intervals.withColumn(BIN, F.explode(F.sequence(_div(start, size), _div(end, size))))


def _binned_rows(intervals: DataFrame, start: str, end: str, size: int) -> int:
    spans = intervals.agg(F.sum(_div(end, size) - _div(start, size) + 1).alias("n")).first()["n"]
    return spans or 0


def _fits_bins(intervals: DataFrame, on: Sequence[str], start: str, end: str, size: int, binned: int) -> bool:
    """Whether a join by bins neither repeats the intervals much nor meets many of them in one bin."""
    if binned > SPREAD * intervals.count():
        return False
    crowd = _binned(intervals, start, end, size).groupBy(*on, BIN).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (crowd or 0) <= CROWD


def _shared(intervals: DataFrame, binned: int, broadcast_rows: int) -> DataFrame:
    """The binned intervals as one side of a join: small ones go to all tasks, others are shuffled, and a hot bin of points is split by the planner."""
    return F.broadcast(intervals) if binned <= broadcast_rows else intervals.hint("merge")


def range_join(
    points: DataFrame,
    intervals: DataFrame,
    on: Sequence[str] = ("chrom",),
    position: str = "pos",
    start: str = "start",
    end: str = "end",
    bin_size: int = 1_000_000,
    how: str = "inner",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Points inside closed intervals. ``how`` is ``inner`` or ``left``.

    Interval tables whose form by coordinate bins is small are broadcast, and the points never move; a point has one bin, so no pair
    appears twice. Larger ones meet the points in the bins, each point moving once. Where that would repeat the intervals or crowd the bins,
    both are swept in the order of coordinates, without bins.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    binned = _binned_rows(intervals, start, end, bin_size)
    if binned > broadcast_rows and not _fits_bins(intervals, on, start, end, bin_size, binned):
        return sweep_join(points, intervals, on, position, start, end, how)
    keys = [*on, BIN]
    inside = F.col(position).between(F.col(start), F.col(end))
    right = _shared(_binned(intervals, start, end, bin_size), binned, broadcast_rows)
    # The keys are renamed on the interval side so that the containment test can sit in the join.
    right = right.select(*[F.col(k).alias(f"_i_{k}") if k in keys else F.col(k) for k in right.columns])
    # The bin of a point follows from its position, so the points do not carry it.
    same = inside & (_div(position, bin_size) == F.col(f"_i_{BIN}"))
    for key in on:
        same = same & (F.col(key) == F.col(f"_i_{key}"))
    joined = points.join(right, same, how)
    return joined.drop(*[f"_i_{k}" for k in keys])


def overlap_join(
    spans: DataFrame,
    intervals: DataFrame,
    on: Sequence[str] = ("chrom",),
    span: tuple[str, str] = ("from", "to"),
    interval: tuple[str, str] = ("start", "end"),
    bin_size: int = 100_000,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Pairs of overlapping closed intervals.

    With a small, broadcast interval table a pair is kept only in the bin where its overlap starts; otherwise both are swept.
    """
    binned = _binned_rows(intervals, *interval, bin_size)
    if binned > broadcast_rows:
        return sweep_overlaps(spans, intervals, on, span, interval)
    left = _binned(spans, *span, bin_size)
    keys = [*on, BIN]
    right = F.broadcast(_binned(intervals, *interval, bin_size))
    right = right.select(*[F.col(k).alias(f"_i_{k}") if k in keys else F.col(k) for k in right.columns])
    first = F.greatest(F.col(span[0]), F.col(interval[0]))
    same = (F.col(span[0]) <= F.col(interval[1])) & (F.col(span[1]) >= F.col(interval[0]))
    same = same & (F.floor(first / F.lit(bin_size)).cast("bigint") == F.col(BIN))
    for key in keys:
        same = same & (F.col(key) == F.col(f"_i_{key}"))
    return left.join(right, same).drop(*[f"_i_{k}" for k in keys], BIN)


def assign_reads(
    alignments: DataFrame,
    exons: DataFrame,
    key: Sequence[str],
    min_mapq: int | None = 255,
    both_ends: bool = True,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Gene of each alignment, or the reason why it has none.

    ``alignments``: key columns, ``flag``, ``rname``, ``pos``, ``mapq``, ``cigar`` and ``nh`` (number of
    reported hits, null for 1). ``exons``: ``chrom``, ``start``, ``end``, ``gene_id``. Each alignment
    counts on its own; strands are ignored; one overlapping base is enough.

    Exons of at most ``broadcast_rows`` rows, of at most BROADCAST_BYTES, go to all tasks, and alignments stay where they are. Of larger ones
    an alignment gets the list of its bin, moving once, if its CIGAR spans no more than a bin. Longer alignments, or all of them if the exons
    do not fit bins, are swept block by block and meet their blocks' genes again by ``key``. An alignment whose
    status needs no gene is not joined.
    """
    kept = alignments if min_mapq is None else alignments.filter(F.col("mapq") >= min_mapq)
    blocks = aligned_blocks("pos", "cigar")
    given = exons.select("chrom", "start", "end", "gene_id")
    rows, size = given.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("chrom") + F.length("gene_id") + 24), F.lit(0))).first()
    unmapped = F.col("flag").bitwiseAND(0x4) != 0
    lone = F.lit(both_ends) & (F.col("flag").bitwiseAND(0x1) != 0) & (F.col("flag").bitwiseAND(0x8) != 0)
    multiple = F.coalesce("nh", F.lit(1)) > 1
    if rows <= broadcast_rows and size <= BROADCAST_BYTES:
        found = kept.withColumn("_genes", block_extremes(F.col("rname"), blocks, given, "gene_id"))
    else:
        settled = F.coalesce(unmapped | lone | multiple, F.lit(False))
        found = _extremes_by_bins(kept.filter(~settled), blocks, given, key)
        none = F.lit(None).cast(found.schema["_genes"].dataType)
        found = found.unionByName(kept.filter(settled).withColumn("_genes", none))
    low, high = F.col("_genes.low"), F.col("_genes.high")
    status = (
        F.when(unmapped, "Unassigned_Unmapped")
        .when(lone, "Unassigned_Singleton")
        .when(multiple, "Unassigned_MultiMapping")
        .when(low.isNull(), "Unassigned_NoFeatures")
        .when(low != high, "Unassigned_Ambiguity")
        .otherwise("Assigned")
    )
    named = found.withColumn("status", status).withColumn("gene_id", F.when(F.col("status") == "Assigned", low))
    return named.drop("_genes")


def _extremes_by_bins(rows: DataFrame, blocks: Column, exons: DataFrame, key: Sequence[str]) -> DataFrame:
    """``rows`` with ``_genes``, the smallest and largest gene under their blocks, or null: see ``assign_reads``."""
    fine = exons.filter("start <= end AND chrom IS NOT NULL AND gene_id IS NOT NULL")
    mean = fine.agg(F.avg(F.col("end") - F.col("start") + 1)).first()[0] or 1.0
    size = max(EXON_BIN, 1 << int(2 * mean - 1).bit_length())
    binned = _binned_rows(fine, "start", "end", size)

    def swept(some: DataFrame) -> DataFrame:
        spans = some.select(*key, F.col("rname").alias("chrom"), F.explode(blocks).alias("_block"))
        spans = spans.select(*key, "chrom", F.col("_block.start").alias("from"), F.col("_block.end").alias("to"))
        genes = sweep_overlaps(spans, fine).groupBy(*key)
        return some.join(genes.agg(F.struct(F.min("gene_id").alias("low"), F.max("gene_id").alias("high")).alias("_genes")), list(key), "left")

    if not _fits_bins(fine, ["chrom"], "start", "end", size, binned):
        return swept(rows)
    numbers = F.regexp_extract_all("cigar", F.lit("([0-9]+)[MDNX=]"), F.lit(1))
    far = F.coalesce(F.aggregate(numbers, F.lit(0).cast("bigint"), lambda acc, x: acc + x.cast("bigint")) > size, F.lit(False))
    some = not rows.select("cigar").distinct().filter(far).isEmpty()
    near = (rows.filter(~far) if some else rows).withColumn(BIN, _div("pos", size))
    # A bin has its own exons and those of the next one, so it has all that such an alignment can touch.
    wide = fine.withColumn(BIN, F.explode(F.sequence(_div("start", size) - 1, _div("end", size))))
    lists = wide.groupBy(F.col("chrom").alias("_chrom"), F.col(BIN).alias("_place")).agg(F.collect_list(F.struct("start", "end", "gene_id")).alias("_exons"))
    met = near.join(lists.hint("merge"), (F.col("rname") == F.col("_chrom")) & (F.col(BIN) == F.col("_place")), "left").withColumn("_blocks", blocks)
    met = met.withColumns({"_from": F.get("_blocks", F.lit(0))["start"], "_to": F.get("_blocks", F.size("_blocks") - 1)["end"]})
    around = F.filter("_exons", lambda e: (e["start"] <= F.col("_to")) & (e["end"] >= F.col("_from")))
    touched = F.filter(around, lambda e: F.exists("_blocks", lambda b: (b["start"] <= e["end"]) & (b["end"] >= e["start"])))
    met = met.withColumn("_found", F.transform(touched, lambda e: e["gene_id"]))
    done = met.select(*rows.columns, F.struct(F.array_min("_found").alias("low"), F.array_max("_found").alias("high")).alias("_genes"))
    return done.unionByName(swept(rows.filter(far))) if some else done
