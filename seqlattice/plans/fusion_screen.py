"""Targeted fusion screen over a folder of junction files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlattice.operators.fusion import enforce_policy, evidence_summary, report_columns, scan_junctions
from seqlattice.schemas import ABL1, BCR, Region
from seqlattice.sources.listing import sample_files
from seqlattice.sources.text import parse_junctions, read_junctions
from seqlattice.sources.writers import metrics_table, write_tsv
from seqlattice.session import materialize

JUNCTIONS = (r"*_Chimeric.out.junction*", r"_Chimeric\.out\.junction(?:\.gz)?")
MARKERS = (r"*_fusion_mapping.done", r"_fusion_mapping\.done")


@dataclass(frozen=True)
class FusionScreen:
    records: DataFrame
    candidates: DataFrame
    summary: DataFrame
    parameters: DataFrame

    def write(self, path: str, project: str) -> None:
        columns = self.records.columns
        order = ["sample", "source_line"]
        write_tsv(self.records, f"{path}/{project}_chimeric_junctions", columns, order=order)
        write_tsv(self.candidates, f"{path}/{project}_expected_orientation_junctions", columns, order=order)
        report = [c for c in self.summary.columns if c != "ordinal"]
        write_tsv(self.summary, f"{path}/{project}_summary_all_samples", report, order=["ordinal"], single_file=True)
        write_tsv(self.parameters, f"{path}/{project}_parameters", ["parameter", "value"], single_file=True)


def input_status(spark: SparkSession, manifest: DataFrame, folder: str, require_done: bool = True) -> DataFrame:
    """The manifest with ``mapping_status`` of samples whose files are missing or unfinished."""
    found = sample_files(spark, folder, *JUNCTIONS).select("sample", F.lit(True).alias("_file")).distinct()
    joined = manifest.join(found, "sample", "left")
    missing = F.when(F.col("_file").isNull(), "missing_junction_file")
    if not require_done:
        return joined.withColumn("mapping_status", missing).drop("_file")
    done = sample_files(spark, folder, *MARKERS).filter("bytes > 0").select("sample", F.lit(True).alias("_done")).distinct()
    unfinished = missing.when(F.col("_done").isNull(), "incomplete_mapping")
    return joined.join(done, "sample", "left").withColumn("mapping_status", unfinished).drop("_file", "_done")


def screen(
    junctions: DataFrame, manifest: DataFrame, a: Region = BCR, b: Region = ABL1, min_umi: int = 2
) -> FusionScreen:
    """The screen on tables; only samples with usable input contribute records."""
    if "mapping_status" in manifest.columns:
        usable = manifest.filter(F.coalesce("mapping_status", F.lit("complete")) == "complete")
    else:
        usable = manifest
    junctions = junctions.join(usable.select("sample"), "sample", "left_semi")
    records = report_columns(scan_junctions(junctions, a, b), a, b)
    flag = next(c for c in records.columns if c.endswith("expected_orientation"))
    values = {"MIN_UNIQUE_UMI": min_umi}
    for region in (a, b):
        values |= {f"{region.name}_{k.upper()}": getattr(region, k) for k in ("chrom", "start", "end", "strand")}
    return FusionScreen(
        records,
        records.filter(F.col(flag) == 1),
        evidence_summary(junctions, manifest, a, b, min_umi),
        metrics_table(junctions.sparkSession, values),
    )


def run(
    spark: SparkSession,
    manifest: DataFrame,
    folder: str,
    a: Region = BCR,
    b: Region = ABL1,
    min_umi: int = 2,
    require_done: bool = True,
    fail_on_missing: bool = True,
    fail_on_malformed: bool = True,
    out: str | None = None,
    project: str = "project",
) -> FusionScreen:
    """Read, screen, optionally write, and raise last for samples that could not be evaluated."""
    samples = materialize(input_status(spark, manifest, folder, require_done))
    files = sample_files(spark, folder, *JUNCTIONS).filter("bytes > 0")
    paths = [r["path"] for r in files.join(samples.select("sample"), "sample", "left_semi").select("path").collect()]
    if paths:
        junctions = read_junctions(spark, paths)
    else:
        junctions = parse_junctions(spark.createDataFrame([], "sample STRING, line_no BIGINT, value STRING"))
    result = screen(junctions, samples, a, b, min_umi)
    if out:
        result.write(out, project)
    enforce_policy(result.summary, fail_on_missing, fail_on_malformed)
    return result
