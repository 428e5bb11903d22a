"""Single-cell normalisation, pseudobulk and two-group markers; zeros stay implicit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlattice.contracts import expect, require
from seqlattice.functions.reads import parse_keep
from seqlattice.functions.tails import tail_p
from seqlattice.operators.counts import CellDataset, cell_totals
from seqlattice.operators.ordering import scan, slice_rows
from seqlattice.schemas import Contrast
from seqlattice.session import materialize

SCALE = 1e4


def keep_cells(data: CellDataset, keep: str, check: bool = True) -> CellDataset:
    """Cells whose keep column says yes; missing values drop out, other texts are an error."""
    if check:
        known = F.col(keep).isNull() | parse_keep(keep).isNotNull()
        expect(data.cells.select("cell", keep), known, "Keep column holds values that are not logical")
    return data.select_cells(parse_keep(keep))


def log_normalize(counts: DataFrame, totals: DataFrame | None = None, scale: float = SCALE) -> DataFrame:
    """Add ``scaled`` (count per ``scale`` of the cell's total) and ``value`` (its log1p).

    Cell totals are a small table of their own, so the counts need no shuffle by cell.
    """
    totals = materialize(cell_totals(counts)) if totals is None else totals
    scaled = F.col("count") / F.col("total") * F.lit(float(scale))
    return counts.join(totals, "cell").withColumn("scaled", scaled).withColumn("value", F.log1p("scaled")).drop("total")


def group_sizes(cells: DataFrame, condition: str = "condition") -> dict[str, int]:
    """Cells per condition; one row per label."""
    return {r[condition]: r["count"] for r in cells.groupBy(condition).count().collect()}


def pseudobulk(
    data: CellDataset, contrast: Contrast, pseudocount: float = 1.0, condition: str = "condition"
) -> tuple[DataFrame, DataFrame]:
    """Sums, CPM, detection and log2 ratio per gene, and the size of both groups.

    Every feature appears, also without a count; cells without a count are in the denominators.
    """
    sizes = group_sizes(data.cells, condition)
    for label in (contrast.a, contrast.b):
        require(sizes.get(label, 0) > 0, f"No retained cells of condition {label}")
    labelled = data.cells.select("cell", F.col(condition).alias("_condition"))
    rows = data.counts.join(labelled, "cell")

    def when(label, value):
        return F.when(F.col("_condition") == label, value)

    sums = rows.groupBy("gene").agg(
        F.sum(when(contrast.a, F.col("count"))).alias("_a"),
        F.sum(when(contrast.b, F.col("count"))).alias("_b"),
        F.count(when(contrast.a, F.when(F.col("count") > 0, 1))).alias("_da"),
        F.count(when(contrast.b, F.when(F.col("count") > 0, 1))).alias("_db"),
    )
    genes = materialize(data.features.select("gene").join(sums, "gene", "left").na.fill(0))
    library = genes.agg(F.sum("_a").alias("a"), F.sum("_b").alias("b")).first()
    require(bool(library["a"]) and bool(library["b"]), "A pseudobulk library is empty")

    cpm_a, cpm_b = F.col("_a") / library["a"] * 1e6, F.col("_b") / library["b"] * 1e6
    table = genes.select(
        "gene",
        F.col("_a").cast("bigint").alias("condition_a_counts"),
        F.col("_b").cast("bigint").alias("condition_b_counts"),
        cpm_a.alias("condition_a_CPM"),
        cpm_b.alias("condition_b_CPM"),
        (F.col("_da") / sizes[contrast.a]).alias("condition_a_detection_rate"),
        (F.col("_db") / sizes[contrast.b]).alias("condition_b_detection_rate"),
        (F.log2(cpm_a + pseudocount) - F.log2(cpm_b + pseudocount)).alias("descriptive_sc_log2FC"),
        F.lit(f"{contrast.a}_vs_{contrast.b}").alias("sc_comparison"),
    )
    summary = data.cells.sparkSession.createDataFrame(
        [(contrast.a, sizes[contrast.a], library["a"]), (contrast.b, sizes[contrast.b], library["b"])],
        "condition STRING, retained_cells BIGINT, pseudobulk_library_size BIGINT",
    )
    return table, summary


def rank_sums(
    normalized: DataFrame, cells: DataFrame, features: DataFrame, contrast: Contrast, condition: str = "condition"
) -> DataFrame:
    """Per gene: detection, scaled sums, rank sum of group A, tie term and normal score.

    Values repeat a lot, so (gene, value) is counted per group first. The non-zero values are ranked
    by a scan that splits large genes; all zeros of a gene form one block of ties below them.
    """
    sizes = group_sizes(cells, condition)
    n_a, n_b = sizes.get(contrast.a, 0), sizes.get(contrast.b, 0)
    require(n_a > 0 and n_b > 0, "Both conditions need cells")
    n = n_a + n_b
    labelled = cells.filter(F.col(condition).isin(contrast.a, contrast.b)).select(
        "cell", (F.col(condition) == contrast.a).alias("_in_a")
    )
    # Twelve digits keep equal ratios equal; only their order matters below.
    values = (
        normalized.filter("value > 0")
        .join(labelled, "cell")
        .groupBy("gene", F.rint(F.col("value") * 1e12).alias("value"))
        .agg(
            F.count_if("_in_a").alias("a"),
            F.count_if(~F.col("_in_a")).alias("b"),
            F.sum(F.when(F.col("_in_a"), F.col("scaled")).otherwise(0.0)).alias("sa"),
            F.sum(F.when(~F.col("_in_a"), F.col("scaled")).otherwise(0.0)).alias("sb"),
        )
        .withColumn("t", F.col("a") + F.col("b"))
    )
    ranked = scan(slice_rows(values, ["gene"], ["value"]), ["gene"], ["value"], "upto", "t")
    t = F.col("t").cast("double")
    per_gene = ranked.groupBy("gene").agg(
        F.sum("a").alias("nz_a"),
        F.sum("b").alias("nz_b"),
        F.sum("sa").alias("sum_a"),
        F.sum("sb").alias("sum_b"),
        F.sum(F.col("a") * (F.col("upto") - (F.col("t") - 1) / 2.0)).alias("within"),
        F.sum(t * t * t - t).alias("ties"),
    )
    genes = features.select("gene").join(per_gene, "gene", "left").na.fill(0)
    zeros = F.lit(float(n)) - F.col("nz_a") - F.col("nz_b")
    zero_a = F.lit(float(n_a)) - F.col("nz_a")
    rank_sum = zero_a * (zeros + 1) / 2 + F.col("within") + F.col("nz_a") * zeros
    statistic = F.col("rank_sum_a") - n_a * (n_a + 1) / 2.0
    tie_term = F.col("ties") + zeros * zeros * zeros - zeros
    variance = F.lit(n_a * n_b / 12.0) * (F.lit(n + 1.0) - F.col("tie_term") / F.lit(float(n) * max(n - 1, 1)))
    shift = F.col("u") - n_a * n_b / 2.0
    return (
        genes.withColumn("rank_sum_a", rank_sum)
        .withColumn("u", statistic)
        .withColumn("tie_term", tie_term)
        .withColumn("variance", variance)
        .withColumn("z", F.when(F.col("variance") > 1e-9, (shift - F.signum(shift) * 0.5) / F.sqrt("variance")))
        .withColumn("pct_1", F.col("nz_a") / n_a)
        .withColumn("pct_2", F.col("nz_b") / n_b)
        .withColumn("mean_a", F.col("sum_a") / n_a)
        .withColumn("mean_b", F.col("sum_b") / n_b)
        .withColumn("avg_log2FC", F.log2((F.col("sum_a") + 1) / n_a) - F.log2((F.col("sum_b") + 1) / n_b))
    )


def find_markers(
    data: CellDataset,
    contrast: Contrast,
    test: str = "wilcox",
    min_pct: float = 0.0,
    min_log2fc: float = 0.0,
    condition: str = "condition",
    normalized: DataFrame | None = None,
) -> DataFrame:
    """Rank-sum markers of A against B with Bonferroni over all features."""
    require(test == "wilcox", "Only the wilcox test is available")
    normalized = log_normalize(data.counts) if normalized is None else normalized
    genes = data.features.select("gene").distinct().count()
    stats = rank_sums(normalized, data.cells, data.features, contrast, condition)
    stats = stats.filter(
        (F.greatest("pct_1", "pct_2") >= min_pct) & (F.abs("avg_log2FC") >= min_log2fc)
    )
    p = tail_p("normal", F.col("z"))
    return stats.withColumn("p_val", p).select(
        "gene",
        F.col("avg_log2FC").alias("sc_log2FC"),
        "p_val",
        "pct_1",
        "pct_2",
        F.when(F.col("p_val").isNotNull(), F.least(F.lit(1.0), F.col("p_val") * genes)).alias("p_val_adj"),
    )
