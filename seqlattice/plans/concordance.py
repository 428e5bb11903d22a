"""Bulk and single-cell concordance: signature, scores and metrics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlattice.contracts import expect, expect_positive_totals, require
from seqlattice.operators import bulk as B
from seqlattice.operators import markers as M
from seqlattice.operators import signature as S
from seqlattice.operators.counts import CellDataset
from seqlattice.schemas import Contrast
from seqlattice.session import materialize
from seqlattice.sources.writers import metrics_table, write_tsv


@dataclass(frozen=True)
class Settings:
    contrast: Contrast
    top_n: int = 100
    fdr_threshold: float = 0.05
    min_abs_log2fc: float = 1.0
    require_deg: bool = False
    require_full: bool = True
    min_total: int = 1
    pseudocount: float = 1.0
    exclude_regex: str = r"^MT-|^RP[SL]"
    min_pct: float = 0.0
    min_marker_log2fc: float = 0.0
    ctrl: int = 50
    nbin: int = 24
    seed: int = 123
    keep_column: str | None = None
    feature_column: str | None = None

    def __post_init__(self):
        require(0 < self.fdr_threshold <= 1, "The FDR threshold must be in (0, 1]")
        require(self.min_abs_log2fc >= 0 and self.pseudocount > 0, "Effect bounds must be non-negative")
        require(self.top_n >= 1 and self.ctrl >= 1 and self.nbin >= 1, "Sizes must be positive")
        require(0 <= self.min_pct <= 1, "The detection share must be in [0, 1]")


ORDERS = {
    "bulk_all_tested_genes": ("FDR", "-abs(logFC)", "gene"),
    "bulk_deg": ("FDR", "-abs(logFC)", "gene"),
    "bulk_sample_metadata": ("sample",),
    "single_cell_descriptive_pseudobulk": ("gene",),
    "single_cell_group_summary": ("condition",),
    "single_cell_markers": ("gene",),
    "bulk_single_cell_matched_genes": ("FDR", "-abs(bulk_log2FC)", "gene"),
    "bulk_top_genes": ("signature", "rank_within_direction"),
    "single_cell_resistance_scores": ("cell",),
    "resistance_score_group_summary": ("level", "condition"),
    "concordance_metrics": ("scope",),
    "volcano": ("FDR", "-abs(bulk_log2FC)", "gene"),
    "dot_plot": ("signature", "rank_within_direction", "condition"),
    "concordance_plot": ("gene",),
    "analysis_parameters": ("parameter",),
}


@dataclass(frozen=True)
class Concordance:
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def write(self, path: str) -> None:
        """Each table in its own order: tests and matches by FDR, then effect; the others by their names."""
        for name, table in self.tables.items():
            order = [F.expr(c) for c in ORDERS[name]]
            write_tsv(table, f"{path}/{name}", table.columns, order=order, null="NA")


def bulk_test(counts: DataFrame, genes: DataFrame, samples: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Tested genes with statistics and mean levels, and the library table."""
    contrast = settings.contrast
    kept = materialize(B.filter_by_expr(counts, samples))
    require(kept.select("gene").distinct().limit(2).count() == 2, "The expression filter leaves less than two genes")
    factors = materialize(B.tmm_factors(kept))
    tested = B.ql_test(kept, samples, factors, contrast)
    levels = B.mean_cpm(B.cpm(kept, factors), samples, contrast)
    table = (
        tested.join(levels, "gene")
        .join(genes, "gene")
        .withColumn("bulk_comparison", F.lit(f"{contrast.a}_vs_{contrast.b}"))
        .drop("deviance_full", "deviance_null", "df_residual")
    )
    libraries = samples.join(B.library_sizes(counts), "sample").join(
        factors.select("sample", "norm_factor", "effective_library_size"), "sample"
    )
    return table, libraries


def run(
    counts: DataFrame,
    genes: DataFrame,
    samples: DataFrame,
    cells: CellDataset,
    settings: Settings,
    de_table: DataFrame | None = None,
) -> Concordance:
    """The whole comparison; a pre-computed ``de_table`` is the ranking source if given.

    ``cells.cells`` needs ``condition``. Cells of other conditions are scored, but not tested.
    """
    contrast = settings.contrast
    expect_positive_totals(counts, "sample", "count", "A bulk sample has zero total counts")
    tested, libraries = bulk_test(counts, genes, samples, settings)
    tested = materialize(tested)

    data = M.keep_cells(cells, settings.keep_column) if settings.keep_column else cells
    label = F.col("condition").isNotNull() & (F.col("condition") != "")
    expect(data.cells, label, "Cells kept for scoring without a condition")
    if settings.feature_column:
        data = data.collapse(settings.feature_column)
    data = CellDataset(materialize(data.counts), materialize(data.features.select("gene").distinct()), materialize(data.cells))
    require(not data.cells.isEmpty(), "The keep column leaves no cell")
    data.check_counts()

    summary, groups = M.pseudobulk(data, contrast, settings.pseudocount)
    normalized = M.log_normalize(data.counts)
    markers = materialize(
        M.find_markers(
            data, contrast, min_pct=settings.min_pct, min_log2fc=settings.min_marker_log2fc, normalized=normalized
        )
    )
    source = de_table if de_table is not None else tested
    best = materialize(S.best_per_symbol(source, ordinal="ordinal"))
    matched = materialize(
        S.match_genes(best, summary, markers, contrast, settings.fdr_threshold, settings.min_abs_log2fc)
    )
    chosen = S.select_signature(
        matched,
        contrast,
        settings.top_n,
        settings.min_total,
        settings.require_deg,
        settings.exclude_regex,
        settings.require_full,
    )
    scores = materialize(
        S.module_score(
            normalized, data.cells, data.features, chosen.select("signature", "gene"), settings.ctrl, settings.nbin, settings.seed
        )
    )
    metrics = S.all_scopes(S.concordance(S.concordance_scopes(matched, chosen, settings.min_total)))
    deg = B.deg(tested, settings.fdr_threshold, settings.min_abs_log2fc)
    parameters = {
        "condition_a": contrast.a,
        "condition_b": contrast.b,
        "fdr_threshold": settings.fdr_threshold,
        "min_abs_log2fc": settings.min_abs_log2fc,
        "top_n_per_direction": settings.top_n,
        "bulk_signature_source": "precomputed_bulk_de_table" if de_table is not None else "recomputed",
        "exclude_gene_regex": settings.exclude_regex,
        "bulk_genes_before_filter": genes.count(),
        "bulk_genes_after_filter": tested.count(),
        "recomputed_bulk_deg_count": deg.count(),
        "matched_gene_count": matched.count(),
        "selected_gene_count": chosen.count(),
        "module_score_seed": settings.seed,
        "module_score_ctrl": settings.ctrl,
        "module_score_nbin": settings.nbin,
    }
    return Concordance(
        {
            "bulk_all_tested_genes": tested,
            "bulk_deg": deg,
            "bulk_sample_metadata": libraries,
            "single_cell_descriptive_pseudobulk": summary,
            "single_cell_group_summary": groups,
            "single_cell_markers": markers,
            "bulk_single_cell_matched_genes": matched,
            "bulk_top_genes": chosen,
            "single_cell_resistance_scores": scores,
            "resistance_score_group_summary": S.score_summary(scores, contrast),
            "concordance_metrics": metrics,
            "volcano": S.volcano_table(best, chosen, contrast, settings.fdr_threshold, settings.min_abs_log2fc),
            "dot_plot": S.dot_table(chosen, contrast),
            "concordance_plot": S.concordance_table(matched, chosen, contrast, settings.min_total),
            "analysis_parameters": metrics_table(counts.sparkSession, parameters),
        }
    )
