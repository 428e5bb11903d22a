"""Two-condition statistics on bulk libraries in long form ``(gene, sample, count)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlattice.contracts import require
from seqlattice.functions.tails import tail_p
from seqlattice.operators.ordering import average_rank, benjamini_hochberg, weighted, weighted_quantiles
from seqlattice.schemas import Contrast
from seqlattice.session import materialize

# Expression filter.
MIN_COUNT, MIN_TOTAL, LARGE_GROUP, LARGE_SHARE, SLACK = 10.0, 15.0, 10, 0.7, 1e-14
# Shares trimmed from the log-ratios and from the mean levels.
TRIM_RATIO, TRIM_LEVEL = 0.3, 0.05
# Pseudo-count in reported fold changes and levels.
PRIOR = 0.125


def library_sizes(counts: DataFrame) -> DataFrame:
    """One row per library, written out so that the planner can broadcast it by its real size."""
    return materialize(counts.groupBy("sample").agg(F.sum("count").cast("bigint").alias("library_size")))


def _smallest_group(samples: DataFrame) -> float:
    n = samples.groupBy("condition").count().agg(F.min("count").alias("n")).first()["n"]
    return LARGE_GROUP + (n - LARGE_GROUP) * LARGE_SHARE if n > LARGE_GROUP else float(n)


def expression_flags(counts: DataFrame, samples: DataFrame, libraries: DataFrame | None = None) -> DataFrame:
    """Per gene: libraries above the CPM cutoff, total count and whether the gene is kept."""
    libraries = library_sizes(counts) if libraries is None else libraries
    # One row per library; a single number comes back.
    median = libraries.agg(F.median("library_size").alias("m")).first()["m"]
    cutoff = MIN_COUNT / median * 1e6
    needed = _smallest_group(samples)
    level = F.col("count") / F.col("library_size") * 1e6
    flags = counts.join(libraries, "sample").groupBy("gene").agg(
        F.count_if(level >= cutoff).alias("libraries_above"), F.sum("count").cast("bigint").alias("total")
    )
    keep = (F.col("libraries_above") >= needed - SLACK) & (F.col("total") >= MIN_TOTAL - SLACK)
    return flags.withColumn("kept", keep)


def filter_by_expr(counts: DataFrame, samples: DataFrame) -> DataFrame:
    """Counts of the genes with enough expression for the design."""
    kept = expression_flags(counts, samples).filter("kept").select("gene")
    return counts.join(kept, "gene", "left_semi")


def upper_quartiles(counts: DataFrame, libraries: DataFrame) -> DataFrame:
    """Scaled 75 % quantile per library over genes seen in any library, absent counts being zeros."""
    present = counts.filter("count > 0")
    genes = present.agg(F.count_distinct("gene").alias("n")).first()["n"]
    values = materialize(weighted(present, ["sample"], "count"))
    zeros = values.groupBy("sample").agg((F.lit(genes) - F.sum("n")).alias("n"))
    zeros = zeros.filter("n > 0").select("sample", F.lit(0).cast("bigint").alias("count"), "n")
    filled = values.withColumn("count", F.col("count").cast("bigint")).unionByName(zeros)
    quartile = weighted_quantiles(filled, ["sample"], "count", {"_q": 0.75})
    return libraries.join(quartile, "sample").select(
        "sample", "library_size", (F.col("_q") / F.col("library_size")).alias("upper_quartile")
    )


def _reference(quartiles: DataFrame, counts: DataFrame) -> str:
    # One row per library of the design.
    rows = quartiles.orderBy("sample").collect()
    values = [r["upper_quartile"] for r in rows]
    middle = sorted(values)[len(values) // 2]
    if middle < 1e-20:
        roots = counts.groupBy("sample").agg(F.sum(F.sqrt("count")).alias("s")).orderBy(F.desc("s"), "sample").first()
        return roots["sample"]
    mean = sum(values) / len(values)
    return min(rows, key=lambda r: (abs(r["upper_quartile"] - mean), r["sample"]))["sample"]


def tmm_factors(counts: DataFrame, libraries: DataFrame | None = None, reference: str | None = None) -> DataFrame:
    """Trimmed-mean normalisation factors per library, with geometric mean 1."""
    libraries = library_sizes(counts) if libraries is None else libraries
    if reference is None:
        reference = _reference(upper_quartiles(counts, libraries), counts)
    present = counts.filter("count > 0").join(libraries, "sample")
    against = present.filter(F.col("sample") == reference).select(
        "gene", F.col("count").alias("_r"), F.col("library_size").alias("_nr")
    )
    y, n, r, nr = (F.col(c).cast("double") for c in ("count", "library_size", "_r", "_nr"))
    ratio = F.log2((y / n) / (r / nr))
    level = (F.log2(y / n) + F.log2(r / nr)) / 2
    variance = (n - y) / n / y + (nr - r) / nr / r
    points = materialize(
        present.join(against, "gene").select(
            "sample", "gene", ratio.alias("_m"), level.alias("_a"), variance.alias("_v")
        )
    )
    ranked = average_rank(average_rank(points, ["sample"], "_m", "_rm"), ["sample"], "_a", "_ra")
    sizes = points.groupBy("sample").agg(F.count(F.lit(1)).alias("_n"), F.max(F.abs("_m")).alias("_widest"))
    low_m = F.floor(F.col("_n") * TRIM_RATIO) + 1
    low_a = F.floor(F.col("_n") * TRIM_LEVEL) + 1
    kept = F.col("_rm").between(low_m, F.col("_n") + 1 - low_m) & F.col("_ra").between(low_a, F.col("_n") + 1 - low_a)
    mean = F.try_divide(F.sum(F.when(kept, F.col("_m") / F.col("_v"))), F.sum(F.when(kept, 1 / F.col("_v"))))
    shift = (
        ranked.join(sizes, "sample")
        .groupBy("sample")
        .agg(F.max("_widest").alias("_widest"), mean.alias("_f"))
        .select("sample", F.when(F.col("_widest") < 1e-6, 0.0).otherwise(F.coalesce("_f", F.lit(0.0))).alias("_f"))
    )
    raw = libraries.join(shift, "sample", "left").na.fill(0.0, subset=["_f"])
    # One row per library, so the mean over all of them is a small window.
    center = F.avg("_f").over(Window.partitionBy(F.lit(1)))
    return raw.select(
        "sample",
        "library_size",
        F.pow(F.lit(2.0), F.col("_f") - center).alias("norm_factor"),
    ).withColumn("effective_library_size", F.col("library_size") * F.col("norm_factor"))


def cpm(counts: DataFrame, factors: DataFrame) -> DataFrame:
    """Counts per million of the effective library (``sample, effective_library_size``)."""
    sized = counts.join(factors.select("sample", "effective_library_size"), "sample")
    return sized.withColumn("cpm", F.col("count") / F.col("effective_library_size") * 1e6).drop("effective_library_size")


def mean_cpm(levels: DataFrame, samples: DataFrame, contrast: Contrast) -> DataFrame:
    """Mean CPM per gene and condition; libraries without the gene count as 0."""
    sizes = {r["condition"]: r["count"] for r in samples.groupBy("condition").count().collect()}
    tagged = levels.join(samples, "sample")

    def mean(label: str):
        return F.sum(F.when(F.col("condition") == label, F.col("cpm")).otherwise(0.0)) / sizes[label]

    return tagged.groupBy("gene").agg(
        mean(contrast.a).alias("condition_a_mean_CPM"), mean(contrast.b).alias("condition_b_mean_CPM")
    )


def ql_statistics(counts: DataFrame, samples: DataFrame, factors: DataFrame, contrast: Contrast) -> DataFrame:
    """Per gene: deviances of a two-group log-linear model with library offsets, and their F ratio.

    Fitted group rates are group sums, so both deviances come from one grouped pass.
    """
    design = materialize(samples.join(factors.select("sample", "effective_library_size"), "sample"))
    sizes = {
        r["condition"]: (r["n"], r["s"])
        for r in design.groupBy("condition")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("effective_library_size").alias("s"))
        .collect()
    }
    for label in (contrast.a, contrast.b):
        require(label in sizes, f"No libraries of condition {label}")
    residual = sizes[contrast.a][0] + sizes[contrast.b][0] - 2
    require(residual > 0, "The test needs replicates")
    size_a, size_b = sizes[contrast.a][1], sizes[contrast.b][1]
    rows = counts.join(design.filter(F.col("condition").isin(contrast.a, contrast.b)), "sample")
    y = F.col("count").cast("double")
    sums = rows.groupBy("gene").agg(
        F.sum(F.when(F.col("condition") == contrast.a, y).otherwise(0.0)).alias("_a"),
        F.sum(F.when(F.col("condition") == contrast.b, y).otherwise(0.0)).alias("_b"),
        F.sum(F.when(y > 0, y * F.log(y / F.col("effective_library_size"))).otherwise(0.0)).alias("_own"),
    )

    def fitted(total, size: float):
        return F.when(total > 0, total * F.log(total / F.lit(size))).otherwise(0.0)

    a, b = F.col("_a"), F.col("_b")
    full = F.greatest(F.lit(0.0), 2 * (F.col("_own") - fitted(a, size_a) - fitted(b, size_b)))
    null = F.greatest(F.lit(0.0), 2 * (F.col("_own") - fitted(a + b, size_a + size_b)))
    rate_a, rate_b = (a + PRIOR) / F.lit(size_a), (b + PRIOR) / F.lit(size_b)
    return (
        sums.withColumn("deviance_full", full)
        .withColumn("deviance_null", null)
        .withColumn("df_residual", F.lit(residual))
        .withColumn(
            "F",
            F.when(
                F.col("deviance_full") > 0,
                (F.col("deviance_null") - F.col("deviance_full")) / (F.col("deviance_full") / F.col("df_residual")),
            ),
        )
        .withColumn("logFC", F.log2(rate_a / rate_b))
        .withColumn("logCPM", F.log2((a + b + 2 * PRIOR) / F.lit(size_a + size_b) * 1e6))
        .select("gene", "logFC", "logCPM", "deviance_full", "deviance_null", "df_residual", "F")
    )


def ql_test(counts: DataFrame, samples: DataFrame, factors: DataFrame, contrast: Contrast) -> DataFrame:
    """Quasi-Poisson F test per gene with false discovery rates.

    This is a plain re-statement, not the empirical-Bayes fit of the usual package; rank signatures
    from a pre-computed table where parity with that package matters.
    """
    stats = ql_statistics(counts, samples, factors, contrast)
    p = tail_p("f", F.col("F"), F.lit(1.0), F.col("df_residual"))
    tested = materialize(stats.withColumn("PValue", F.coalesce(p, F.lit(1.0))))
    return benjamini_hochberg(tested, "PValue", "FDR")


def is_deg(fdr: str, log_fc: str, fdr_threshold: float = 0.05, min_abs_log2fc: float = 1.0):
    """Strict on the FDR, inclusive on the effect."""
    return (F.col(fdr) < fdr_threshold) & (F.abs(log_fc) >= min_abs_log2fc)


def deg(table: DataFrame, fdr_threshold: float = 0.05, min_abs_log2fc: float = 1.0) -> DataFrame:
    return table.filter(is_deg("FDR", "logFC", fdr_threshold, min_abs_log2fc))

