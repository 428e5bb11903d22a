"""From read pairs and alignments to a gene-by-cell dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlattice.contracts import expect_references, require
from seqlattice.functions.reads import extract_tag
from seqlattice.operators.counts import CellDataset, annotate_features, dedup_umis, gene_totals
from seqlattice.operators.ranges import assign_reads
from seqlattice.operators.reads import ANCHOR, UMI_LENGTH, annotate_names, split_umi
from seqlattice.sources.fastq import read_fastq_pairs


def extract_umis(spark: SparkSession, manifest: DataFrame, anchor: str = ANCHOR, length: int = UMI_LENGTH) -> DataFrame:
    """All mate pairs of a manifest, split and named; one task per pair of files, no shuffle."""
    return annotate_names(split_umi(read_fastq_pairs(spark, manifest), anchor, length))


def tag_alignments(sam: DataFrame) -> DataFrame:
    """Cell and UMI columns from the read names."""
    return sam.withColumn("CB", extract_tag("qname", "CB")).withColumn("UB", extract_tag("qname", "UB"))


def count_molecules(alignments: DataFrame, exons: DataFrame, method: str = "unique", min_mapq: int = 255, **options) -> DataFrame:
    """``gene, cell, count`` from tagged alignments (``file, ordinal`` identify one)."""
    hits = F.expr("try_cast(tags['NH'] AS INT)") if "tags" in alignments.columns else F.lit(None).cast("int")
    rows = alignments.withColumn("nh", hits)
    assigned = assign_reads(rows, exons, ["file", "ordinal"], min_mapq, **options).filter("status = 'Assigned'")
    return dedup_umis(assigned, method=method)


def build_dataset(counts: DataFrame, manifest: DataFrame, annotation: DataFrame, tables: DataFrame | None = None) -> CellDataset:
    """Merge the samples' counts: genes annotated, cells exactly the manifest's samples in order.

    ``tables`` lists in ``sample`` whose count table is there, so that an empty table is a cell without molecules. Without
    it each sample of the manifest needs a row in ``counts``.
    """
    samples = manifest.select(F.col("sample").alias("cell"), "ordinal")
    seen = counts.select("cell").distinct()
    expect_references(seen, samples, ["cell"], "Counts of samples outside the manifest")
    present = seen if tables is None else tables.select(F.col("sample").alias("cell"))
    expect_references(samples, present, ["cell"], "Samples of the manifest without a count table")
    totals = gene_totals(counts)
    require(not totals.filter("count > 0").isEmpty(), "All counts are zero, so there is nothing to merge")
    genes = annotate_features(counts.select(F.col("gene").alias("gene_id")).distinct(), annotation)
    return CellDataset(totals.filter("count > 0"), genes.withColumn("gene", F.col("gene_id")), samples)
