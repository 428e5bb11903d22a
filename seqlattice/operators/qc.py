"""Sample-level quality control and read tracking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlattice.contracts import require
from seqlattice.functions.reads import species
from seqlattice.operators.ordering import quantiles
from seqlattice.schemas import ASSIGNMENT_STATUSES

# Default upper bounds and the percentiles they came from.
ASSIGNED_THRESHOLD, UMI_THRESHOLD = 478877, 12149
ASSIGNED_PERCENTILE, UMI_PERCENTILE = 0.65, 0.70
FASTQ_STEPS = ("raw_umi", "raw_noumi", "trimmed_umi", "trimmed_noumi")


def umi_totals(counts: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Molecules per sample; with a manifest, samples without counts get 0."""
    totals = counts.groupBy(F.col("cell").alias("sample")).agg(F.sum("count").cast("bigint").alias("total"))
    if manifest is None:
        return totals
    return manifest.select("sample").join(totals, "sample", "left").na.fill(0, subset=["total"])


def qc_flags(
    samples: DataFrame,
    assigned: str = "featurecounts_assigned",
    umis: str = "total_deduplicated_umis",
    assigned_threshold: int = ASSIGNED_THRESHOLD,
    umi_threshold: int = UMI_THRESHOLD,
) -> DataFrame:
    """Inclusive upper bounds on assigned reads and molecules; both must hold to keep a sample."""
    require(assigned_threshold >= 0 and umi_threshold >= 0, "A threshold is below zero")
    reads, molecules = F.col(assigned) <= assigned_threshold, F.col(umis) <= umi_threshold
    return (
        samples.withColumn("assigned_read_pass", reads.cast("int"))
        .withColumn("deduplicated_umi_pass", molecules.cast("int"))
        .withColumn("raw_qc_keep", (reads & molecules).cast("int"))
        .withColumn("raw_qc_status", F.when(reads & molecules, "keep").otherwise("raw_qc_removal"))
    )


def empirical_thresholds(samples: DataFrame, columns: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact percentiles of several columns as ``name, probability, value`` rows."""
    for _, p in columns.values():
        require(0 <= p <= 1, "Percentiles must be between 0 and 1")
    out = None
    for name, (column, p) in columns.items():
        part = quantiles(samples, [], column, {"value": p}).select(
            F.lit(name).alias("name"), F.lit(float(p)).alias("probability"), "value"
        )
        out = part if out is None else out.unionByName(part)
    return out


def retention(flags: DataFrame) -> DataFrame:
    return flags.agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.sum("raw_qc_keep").cast("bigint").alias("retained_sample_count"),
        F.sum(1 - F.col("raw_qc_keep")).cast("bigint").alias("removed_sample_count"),
    )


def mapped_metrics(alignments: DataFrame, by: Sequence[str] = ("sample",)) -> DataFrame:
    """Mapped reads by species and status, human share, tagged reads and distinct molecules.

    ``alignments``: ``rname`` (null or ``*`` if unmapped), ``flag`` and ``tags`` or the columns
    ``XS, CB, UB, XT``. A missing or unlisted status counts as ``Unassigned_Other``.
    """
    if "tags" in alignments.columns:
        for tag in ("XS", "CB", "UB", "XT"):
            alignments = alignments.withColumn(tag, F.col("tags")[tag])
    mapped = (F.col("flag").bitwiseAND(4) == 0) & F.col("rname").isNotNull() & (F.col("rname") != "*")
    status = F.when(F.col("XS").isin(*ASSIGNMENT_STATUSES), F.col("XS")).otherwise("Unassigned_Other")
    step = F.when(mapped, F.concat_ws("_", F.lit("reads"), species("rname"), status))
    tagged = F.coalesce(F.col("XS") == "Assigned", F.lit(False))
    for tag in ("CB", "UB", "XT"):
        tagged = tagged & F.col(tag).isNotNull()
    molecule = F.when(tagged, F.struct("CB", "XT", "UB"))
    # One pass: reads collapse to (step, molecule) before the shuffle.
    merged = (
        alignments.select(*by, step.alias("step"), molecule.alias("_molecule"))
        .groupBy(*by, "step", "_molecule")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    statuses = merged.filter("step IS NOT NULL").groupBy(*by, "step").agg(F.sum("_n").alias("_n"))
    by_status = statuses.select(*by, F.lit(1).alias("section"), "step", F.col("_n").cast("string").alias("value"))
    human = F.sum(F.when(F.col("step") == "reads_human_Assigned", F.col("_n")).otherwise(0))
    mouse = F.sum(F.when(F.col("step") == "reads_mouse_Assigned", F.col("_n")).otherwise(0))
    share = (
        statuses.groupBy(*by)
        .agg(human.alias("_h"), mouse.alias("_m"))
        .filter(F.col("_h") + F.col("_m") > 0)
        .select(
            *by,
            F.lit(2).alias("section"),
            F.lit("Percent_Human_Assigned").alias("step"),
            F.concat(
                F.format_number(100.0 * F.col("_h") / (F.col("_h") + F.col("_m")), 2), F.lit("%")
            ).alias("value"),
        )
    )
    molecules = merged.groupBy(*by).agg(
        F.sum(F.when(F.col("_molecule").isNotNull(), F.col("_n")).otherwise(0)).alias("_reads"),
        F.count_distinct("_molecule").alias("_umis"),
    )
    counted = molecules.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.lit(3).alias("section"), F.lit("Tagged_Reads").alias("step"), F.col("_reads").cast("string").alias("value")),
                F.struct(F.lit(4).alias("section"), F.lit("UMIs_tagged").alias("step"), F.col("_umis").cast("string").alias("value")),
            )
        ).alias("_m"),
    ).select(*by, "_m.*")
    return by_status.unionByName(share).unionByName(counted)


def record_counts(records: DataFrame) -> DataFrame:
    """Reads per sample, step and mate from a record table."""
    return records.groupBy("sample", "step", "mate").agg(F.count(F.lit(1)).alias("records"))


def fastq_steps(counts: DataFrame, manifest: DataFrame, legacy: bool = False) -> DataFrame:
    """Raw and trimmed read counts; absent files count as 0.

    The legacy view adds both mates for raw steps, the corrected one counts mate 1. Trimmed steps
    always count mate 1. ``counts`` is ``sample, step, mate, records``.
    """
    counted = F.col("mate") == 1
    if legacy:
        counted = counted | F.col("step").startswith("raw_")
    totals = counts.groupBy("sample", "step").agg(F.sum(F.when(counted, F.col("records")).otherwise(0)).alias("_n"))
    # Four fixed steps for each sample.
    expected = manifest.select("sample", F.explode(F.array(*[F.lit(s) for s in FASTQ_STEPS])).alias("step"))
    return expected.join(totals, ["sample", "step"], "left").select(
        "sample", F.lit(0).alias("section"), "step", F.coalesce("_n", F.lit(0)).cast("string").alias("value")
    )


def read_tracking(
    fastq_counts: DataFrame, alignments: DataFrame, counts: DataFrame, manifest: DataFrame, legacy: bool = False
) -> DataFrame:
    """The whole tracking table ``sample, section, step, value``; order by section, then step."""
    metrics = mapped_metrics(alignments)
    zero = manifest.select(
        "sample",
        F.explode(
            F.array(
                F.struct(F.lit(3).alias("section"), F.lit("Tagged_Reads").alias("step"), F.lit("0").alias("value")),
                F.struct(F.lit(4).alias("section"), F.lit("UMIs_tagged").alias("step"), F.lit("0").alias("value")),
            )
        ).alias("_m"),
    ).select("sample", "_m.*")
    missing = zero.join(metrics.select("sample", "step"), ["sample", "step"], "left_anti").select(*zero.columns)
    deduplicated = umi_totals(counts, manifest).select(
        "sample", F.lit(5).alias("section"), F.lit("UMIs_deduplicated").alias("step"), F.col("total").cast("string").alias("value")
    )
    return (
        fastq_steps(fastq_counts, manifest, legacy)
        .unionByName(metrics.join(manifest.select("sample"), "sample", "left_semi").select(*zero.columns))
        .unionByName(missing)
        .unionByName(deduplicated)
    )
