"""Raw quality control of samples from assignment summaries and UMI count tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlattice.contracts import expect_references
from seqlattice.operators.ordering import quantiles
from seqlattice.operators.qc import (
    ASSIGNED_PERCENTILE,
    ASSIGNED_THRESHOLD,
    UMI_PERCENTILE,
    UMI_THRESHOLD,
    qc_flags,
    retention,
    umi_totals,
)
from seqlattice.session import materialize
from seqlattice.sources.writers import metrics_table, write_tsv


@dataclass(frozen=True)
class RawQc:
    samples: DataFrame
    parameters: DataFrame

    def write(self, path: str) -> None:
        write_tsv(self.samples, f"{path}/raw_qc_by_sample", self.samples.columns, order=["sample"], single_file=True)
        write_tsv(self.parameters, f"{path}/raw_qc_parameters", ["parameter", "value"], single_file=True)


def run(
    manifest: DataFrame,
    assigned: DataFrame,
    counts: DataFrame,
    hashes: DataFrame | None = None,
    tables: DataFrame | None = None,
    assigned_threshold: int = ASSIGNED_THRESHOLD,
    umi_threshold: int = UMI_THRESHOLD,
    assigned_percentile: float = ASSIGNED_PERCENTILE,
    umi_percentile: float = UMI_PERCENTILE,
) -> RawQc:
    """Flags per sample, and the applied bounds next to the data's own percentiles.

    ``assigned`` is ``sample, featurecounts_assigned``; ``hashes`` adds file hashes per sample. ``tables`` lists in
    ``sample`` whose UMI table is there: a table without rows is a total of 0, a missing one an error. Without
    ``tables`` each sample needs a row in ``counts``.
    """
    expect_references(manifest, assigned, ["sample"], "No assignment summary")
    present = tables if tables is not None else counts.select(F.col("cell").alias("sample")).distinct()
    expect_references(manifest, present, ["sample"], "No UMI count table")
    totals = umi_totals(counts, manifest).withColumnRenamed("total", "total_deduplicated_umis")
    rows = manifest.select("sample").join(assigned, "sample").join(totals, "sample")
    flags = qc_flags(rows, assigned_threshold=assigned_threshold, umi_threshold=umi_threshold)
    if hashes is not None:
        flags = flags.join(hashes, "sample", "left")
    flags = materialize(flags)
    # Three single rows: the counts and one value per percentile.
    kept = retention(flags).first()
    reads = quantiles(flags, [], "featurecounts_assigned", {"v": assigned_percentile}).first()["v"]
    umis = quantiles(flags, [], "total_deduplicated_umis", {"v": umi_percentile}).first()["v"]
    values = {
        "sample_count": kept["sample_count"],
        "assigned_read_percentile": assigned_percentile,
        "empirical_assigned_read_percentile_value": f"{reads:.10g}",
        "applied_assigned_read_threshold": assigned_threshold,
        "deduplicated_umi_percentile": umi_percentile,
        "empirical_deduplicated_umi_percentile_value": f"{umis:.10g}",
        "applied_deduplicated_umi_threshold": umi_threshold,
        "threshold_comparison": "inclusive_le",
        "retained_sample_count": kept["retained_sample_count"],
        "removed_sample_count": kept["removed_sample_count"],
    }
    return RawQc(flags, metrics_table(manifest.sparkSession, values))
