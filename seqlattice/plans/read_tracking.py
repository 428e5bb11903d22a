"""Read numbers of each sample through the pipeline, from its files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlattice.contracts import expect, expect_references
from seqlattice.operators import qc as Q
from seqlattice.session import materialize
from seqlattice.sources.tables import read_umi_counts
from seqlattice.sources.text import read_sam, sample_of
from seqlattice.sources.writers import write_tsv

# File name endings of the steps, and the mate each holds.
FASTQ_FILES = (
    ("raw_umi", 1, "_R1_umi_out.fastq.gz"),
    ("raw_umi", 2, "_R2_umi_out.fastq.gz"),
    ("raw_noumi", 1, "_R1_out.fastq.gz"),
    ("raw_noumi", 2, "_R2_out.fastq.gz"),
    ("trimmed_umi", 1, "_R1_umi_out_val_1.fq.gz"),
    ("trimmed_noumi", 1, "_R1_out_val_1.fq.gz"),
)


@dataclass(frozen=True)
class ReadTracking:
    legacy: DataFrame
    corrected: DataFrame
    order: DataFrame

    def write(self, path: str) -> None:
        """Both tables, samples in manifest order and steps in theirs."""
        for name, table in (("readtracking_production_legacy", self.legacy), ("readtracking_corrected_r1", self.corrected)):
            placed = table.join(self.order, "sample")
            write_tsv(placed, f"{path}/{name}", ["sample", "step", "value"], order=["ordinal", "section", "position", "step"], single_file=True)


def fastq_counts(spark: SparkSession, folder: str) -> DataFrame:
    """``sample, step, mate, records`` of the FASTQ files below ``folder``, by their names; other files are left out."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.f*q.gz").text(folder)
    counted = lines.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("lines"))
    what = F.lit(None).cast("struct<step:string,mate:int,ending:string>")
    for step, mate, ending in FASTQ_FILES:
        entry = F.struct(F.lit(step).alias("step"), F.lit(mate).alias("mate"), F.lit(ending).alias("ending"))
        what = F.when(F.col("file").endswith(ending), entry).otherwise(what)
    known = counted.withColumn("w", what).filter("w IS NOT NULL")
    expect(known.select("file", "lines"), F.col("lines") % 4 == 0, "The number of lines is no multiple of four")
    sample = F.expr("substring(file, 1, length(file) - length(w.ending))")
    return known.select(sample.alias("sample"), "w.step", "w.mate", (F.col("lines") / 4).cast("long").alias("records"))


def run(spark: SparkSession, manifest: DataFrame, folder: str) -> ReadTracking:
    """The tracking tables of the samples of ``manifest`` (sample, ordinal) from a pipeline's output folder.

    ``umi_extracted/`` and ``umi_trimmed/`` hold the FASTQ files, ``mapped/<sample>/`` the alignments as SAM text
    (``<sample>_assigned_sorted.sam``, plain or gzip) and the count table (``<sample>_counts.tsv.gz``). A missing FASTQ file
    counts as 0 reads; alignments and counts are needed of every sample.
    """
    fastq = fastq_counts(spark, f"{folder}/umi_extracted").unionByName(fastq_counts(spark, f"{folder}/umi_trimmed"))
    alignments = read_sam(spark, f"{folder}/mapped/*/*_assigned_sorted.sam*")
    alignments = materialize(alignments.withColumn("sample", sample_of(F.col("file"), r"_assigned_sorted\.sam(?:\.gz)?")))
    counts = read_umi_counts(spark, f"{folder}/mapped/*/*_counts.tsv*")
    expect_references(manifest, alignments.select("sample").distinct(), ["sample"], "No alignments")
    expect_references(manifest, counts.select(F.col("cell").alias("sample")).distinct(), ["sample"], "No UMI count table")
    fastq = materialize(fastq)
    # Reads come in the order of the steps, the rest by name within its section.
    position = F.coalesce(*[F.when(F.col("step") == s, F.lit(i)) for i, s in enumerate(Q.FASTQ_STEPS)], F.lit(len(Q.FASTQ_STEPS)))
    tables = [materialize(Q.read_tracking(fastq, alignments, counts, manifest, legacy).withColumn("position", position)) for legacy in (True, False)]
    return ReadTracking(*tables, manifest.select("sample", "ordinal"))
