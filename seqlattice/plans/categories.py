"""Intergenic category report: junctions, read metadata, gene intervals and called cells."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlattice.contracts import expect
from seqlattice.operators.fusion import (
    annotate_pairs,
    annotation_report,
    attach_metadata,
    category_summary,
    category_support,
)
from seqlattice.session import materialize
from seqlattice.sources.writers import write_tsv


@dataclass(frozen=True)
class CategoryReport:
    annotated: DataFrame
    support: DataFrame
    summary: DataFrame

    def write(self, path: str) -> None:
        report = annotation_report(self.annotated)
        write_tsv(report, f"{path}/annotated_intergenic_junctions", report.columns, order=["source_line"])
        write_tsv(self.support, f"{path}/category_read_support", self.support.columns, order=["category", "original_qname"])
        columns = [c for c in self.summary.columns if c != "ordinal"]
        write_tsv(self.summary, f"{path}/category_summary", columns, order=["ordinal"], null="NA", single_file=True)


def run(
    junctions: DataFrame,
    metadata: DataFrame,
    genes: DataFrame,
    called: DataFrame,
    a: str = "BCR",
    b: str = "ABL1",
    bin_size: int = 1_000_000,
) -> CategoryReport:
    """Malformed junctions and junctions without metadata are errors."""
    expect(junctions.select("source_line", "raw_record", "malformed"), ~F.col("malformed"), "Malformed junction records")
    tagged = attach_metadata(junctions, metadata)
    annotated = materialize(annotate_pairs(tagged, genes, a, b, bin_size=bin_size))
    support = materialize(category_support(annotated, called))
    return CategoryReport(annotated, support, category_summary(support, metadata, called, a, b))
