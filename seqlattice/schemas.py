"""Fixed schemas and the small parameter objects shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

MANIFEST = "sample STRING, r1 STRING, r2 STRING"
UMI_COUNTS = "gene STRING, cell STRING, count STRING"
READ_METADATA = "star_read_name STRING, original_qname STRING, CB STRING, UB STRING, CR STRING, UR STRING"
DATASET_MANIFEST = (
    "dataset STRING, path STRING, format STRING, group STRING, assay STRING, feature_column STRING"
)
BULK_SAMPLES = "sample STRING, condition STRING"

RETAINED_TAGS = ("CB", "UB", "CR", "UR")
ASSIGNMENT_STATUSES = (
    "Assigned",
    "Unassigned_NoFeatures",
    "Unassigned_Ambiguity",
    "Unassigned_MultiMapping",
)
SAFE_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"


@dataclass(frozen=True)
class Region:
    """A named closed interval with the strand a transcript is expected on."""

    name: str
    chrom: str
    start: int
    end: int
    strand: str = "+"

    def __post_init__(self):
        if self.start > self.end:
            raise ValueError(f"{self.name}: start must be <= end")
        if self.strand not in ("+", "-"):
            raise ValueError(f"{self.name}: strand must be '+' or '-'")


# Default target regions (GRCh38).
BCR = Region("BCR", "chr22", 23179704, 23318037, "+")
ABL1 = Region("ABL1", "chr9", 130713946, 130887675, "+")


@dataclass(frozen=True)
class Contrast:
    """Condition labels of a two-group comparison; effects are ``a`` over ``b``."""

    a: str
    b: str

    def __post_init__(self):
        if not self.a or not self.b or self.a == self.b:
            raise ValueError("The two condition labels must be non-empty and distinct")
        if any(ch in label for label in (self.a, self.b) for ch in "\t\n"):
            raise ValueError("Condition labels must not contain tabs or newlines")


@dataclass(frozen=True)
class GeneColumns:
    """Names of the gene columns in a wide bulk matrix."""

    gene_id: str = "gene_id"
    gene_name: str = "gene_name"
    gene_biotype: str = "gene_biotype"


@dataclass(frozen=True)
class DeColumns:
    """Names of the columns of a pre-computed differential-expression table."""

    gene_id: str = "EnsemblID"
    gene_name: str = "gene_name"
    gene_biotype: str = "gene_biotype"
    log_fc: str = "logFC"
    p_value: str = "PValue"
    fdr: str = "FDR"
