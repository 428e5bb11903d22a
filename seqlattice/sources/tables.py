"""Delimited tables, sparse matrices and file hashes."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Sequence

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from seqlattice.contracts import (
    COUNT_MESSAGE,
    de_rule,
    expect,
    expect_conditions,
    expect_positive_totals,
    expect_unique,
    filled,
    id_rule,
    require,
    require_columns,
    stored,
    whole_count,
)
from seqlattice.operators.ordering import row_numbers
from seqlattice.schemas import SAFE_ID, Contrast, DeColumns, GeneColumns
from seqlattice.sources.listing import absolute, store
from seqlattice.sources.text import read_lines, sample_of

DATASET_COLUMNS = ("dataset", "path", "format", "group", "assay", "feature_column")
DATASET_FORMATS = ("parquet", "10x_dir")


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    sep: str = "\t",
    exact: Sequence[str] | None = None,
    subset: Sequence[str] = (),
    ordinal: bool = False,
) -> DataFrame:
    """A headed text table, every column a string; the header is checked before any row is used.

    ``ordinal`` numbers the rows through all files, the files in name order. The scan itself deals large files first, so its own order
    of rows is no file order.
    """
    table = spark.read.csv(path, sep=sep, header=True, inferSchema=False, quote='"', escape='"')
    require_columns(table, exact=exact, subset=subset)
    if ordinal:
        places = {"_file": F.col("_metadata.file_path"), "_at": F.col("_metadata.file_block_start"), "_id": F.monotonically_increasing_id()}
        table = row_numbers(table.withColumns(places), [], list(places), "ordinal").drop(*places)
    return table


def read_manifest(
    spark: SparkSession,
    path: str,
    required: Sequence[str] = ("sample", "r1", "r2"),
    exact: bool = True,
    check_files: bool = False,
) -> DataFrame:
    """Samples in file order with ``ordinal``; blank rows are skipped.

    Relative mate files are looked up next to the manifest. ``check_files`` asks the store for each.
    """
    table = read_table(spark, path, exact=required if exact else None, subset=required, ordinal=True)
    trimmed = table.select("ordinal", *[F.coalesce(F.trim(c), F.lit("")).alias(c) for c in table.columns if c != "ordinal"])
    samples = trimmed.filter(F.concat(*required) != "")
    checks = {"Unsafe value in sample": id_rule("sample", SAFE_ID)}
    if {"r1", "r2"} <= set(required):
        checks["Both mate files must be given and differ"] = filled("r1") & filled("r2") & (F.col("r1") != F.col("r2"))
    samples = stored(samples, checks, least="No samples in the manifest")
    expect_unique(samples, ["sample"], "Duplicate sample")
    if {"r1", "r2"} <= set(required):
        base = os.path.dirname(absolute(path))
        for mate in ("r1", "r2"):
            found = F.col(mate)
            samples = samples.withColumn(
                mate, F.when(found.rlike(r"^(/|[A-Za-z0-9+.-]+:)"), found).otherwise(F.concat(F.lit(f"{base}/"), found))
            )
        if check_files:
            # Two names per manifest line.
            for row in samples.select("r1", "r2").collect():
                for name in row:
                    system, inner = store(name)
                    info = system.get_file_info(inner)
                    require(info.type == fs.FileType.File and info.size > 0, f"Missing or empty mate file: {name}")
    return samples


def read_umi_counts(
    spark: SparkSession,
    paths: str | Sequence[str],
    suffix: str = r"_counts\.tsv(?:\.gz)?",
    check_cell: bool = True,
) -> DataFrame:
    """``gene, cell, count`` of all samples at once; each file may only hold its own sample."""
    table = read_table(spark, paths, subset=("gene", "cell", "count"))
    rows = table.select(
        sample_of(F.col("_metadata.file_path"), suffix).alias("sample"), "gene", F.trim("cell").alias("cell"), "count"
    )
    checks = {COUNT_MESSAGE: whole_count("count")}
    if check_cell:
        checks |= {"Unexpected cell id": F.col("cell") == F.col("sample"), "Missing gene identifier": filled("gene")}
    rows = stored(rows, checks)
    return rows.select("gene", F.col("cell"), F.expr("CAST(try_cast(count AS DOUBLE) AS BIGINT)").alias("count"))


def read_assignment_summary(spark: SparkSession, paths: str | Sequence[str], suffix: str) -> DataFrame:
    """Assigned reads per sample; the last ``Assigned`` line of a file counts."""
    lines = read_lines(spark, paths).withColumn("f", F.split("value", "\t")).filter(F.size("f") >= 2)
    rows = lines.select(sample_of(F.col("file"), suffix).alias("sample"), "line_no", F.col("f")[0].alias("k"), F.col("f")[1].alias("v"))
    last = rows.groupBy("sample").agg(F.max_by(F.col("v"), F.when(F.col("k") == "Assigned", F.col("line_no"))).alias("v"))
    value = F.expr("try_cast(v AS BIGINT)")
    expect(last, value.isNotNull() & (value >= 0), "No valid Assigned row")
    return last.select("sample", value.alias("featurecounts_assigned"))


def read_bulk_matrix(
    spark: SparkSession,
    path: str,
    samples: Sequence[str],
    columns: GeneColumns = GeneColumns(),
    suffix: str = "",
) -> tuple[DataFrame, DataFrame]:
    """A wide bulk matrix as ``(counts(gene, sample, count), genes)``.

    ``gene`` is the gene id made unique in file order.
    """
    from seqlattice.operators.counts import make_unique

    wanted = [f"{s}{suffix}" for s in samples]
    gene = [columns.gene_id, columns.gene_name, columns.gene_biotype]
    table = read_table(spark, path, subset=[*gene, *wanted], ordinal=True)
    genes = table.select(
        "ordinal", *[F.col(c).alias(n) for c, n in zip(gene, ("gene_id", "gene_name", "gene_biotype"), strict=True)], *wanted
    )
    genes = stored(genes, {"Bulk rows without a gene id": F.coalesce("gene_id", F.lit("")) != ""})
    named = make_unique(genes, "gene_id", "ordinal", "gene")
    long = named.select(
        "gene",
        F.explode(
            F.array(*[F.struct(F.lit(s).alias("sample"), F.col(f"`{c}`").alias("count")) for s, c in zip(samples, wanted, strict=True)])
        ).alias("_c"),
    ).select("gene", "_c.*")
    long = stored(long, {COUNT_MESSAGE: whole_count("count", 1e-8)})
    counts = long.withColumn("count", F.expr("CAST(round(CAST(count AS DOUBLE)) AS BIGINT)"))
    expect_positive_totals(counts, "sample", "count", "A bulk sample has zero total counts")
    return counts, named.select("gene", "ordinal", "gene_id", "gene_name", "gene_biotype")


def read_bulk_samples(spark: SparkSession, path: str, contrast: Contrast, min_replicates: int = 2) -> DataFrame:
    table = read_table(spark, path, exact=("sample", "condition"), ordinal=True)
    expect(table, (F.coalesce("sample", F.lit("")) != "") & F.col("condition").isNotNull(), "Missing sample or condition")
    expect_unique(table, ["sample"], "Duplicate bulk sample")
    expect_conditions(table, (contrast.a, contrast.b), min_replicates)
    return table


def read_de_table(
    spark: SparkSession, path: str, columns: DeColumns = DeColumns(), multiplier: float = 1.0
) -> DataFrame:
    """A pre-computed differential-expression table; effects are multiplied by ``multiplier``."""
    require(multiplier == multiplier and abs(multiplier) not in (0.0, float("inf")), "The multiplier must be finite and non-zero")
    sep = "," if re.search(r"\.csv(\.gz)?$", path, re.IGNORECASE) else "\t"
    names = [columns.gene_id, columns.gene_name, columns.gene_biotype, columns.log_fc, columns.p_value, columns.fdr]
    table = read_table(spark, path, sep=sep, subset=names, ordinal=True)

    def number(name: str):
        return F.expr(f"try_cast(`{name}` AS DOUBLE)")

    rows = table.select(
        "ordinal",
        F.col(columns.gene_id).alias("gene_id"),
        F.col(columns.gene_name).alias("gene_name"),
        F.col(columns.gene_biotype).alias("gene_biotype"),
        (number(columns.log_fc) * multiplier).alias("logFC"),
        number(columns.p_value).alias("PValue"),
        number(columns.fdr).alias("FDR"),
    )
    return stored(rows, {"Invalid identifiers, fold changes or probabilities": de_rule()})


def read_read_metadata(spark: SparkSession, path: str) -> DataFrame:
    from seqlattice.operators.fusion import check_metadata

    names = ("star_read_name", "original_qname", "CB", "UB", "CR", "UR")
    table = read_table(spark, path, subset=names)
    return check_metadata(table.select(*[F.coalesce(c, F.lit("")).alias(c) for c in names]))


def read_candidates(spark: SparkSession, path: str, a: str = "BCR", b: str = "ABL1") -> DataFrame:
    """``sample, candidate`` (0/1) from the candidate column, else from the call; blanks are an error."""
    table = read_table(spark, path, subset=("sample",))
    column = f"expected_{a}_{b}_candidate"
    require(column in table.columns or f"{column}_call" in table.columns, "No candidate column")
    if column in table.columns:
        value = F.expr(f"try_cast(trim(`{column}`) AS INT)")
    else:
        value = F.col(f"{column}_call").startswith("candidate_").cast("int")
    rows = stored(table.select("sample", value.alias("candidate")), {"A candidate flag is neither 0 nor 1": F.col("candidate").isin(0, 1)})
    return expect_unique(rows, ["sample"], "Duplicate candidate sample")


def read_cell_metadata(spark: SparkSession, path: str) -> DataFrame:
    table = read_table(spark, path, subset=("sample",))
    table = stored(table, {"Empty sample id": F.coalesce("sample", F.lit("")) != ""})
    return expect_unique(table, ["sample"], "Duplicate sample id")


def read_dataset_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Datasets to merge: at least two, unique, each in a known format."""
    table = read_table(spark, path, exact=DATASET_COLUMNS, ordinal=True)
    given = F.lit(True)
    for name in DATASET_COLUMNS[:5]:
        given = given & (F.coalesce(name, F.lit("")) != "")
    expect(table, given & F.col("format").isin(*DATASET_FORMATS), "Invalid dataset row")
    expect_unique(table, ["dataset"], "Duplicate dataset")
    rows = table.limit(2).count()
    require(rows >= 2, "At least two datasets are needed")
    return table


def _ordinals(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Lines numbered through all parts of a folder, the parts in name order."""
    lines = read_lines(spark, path)
    # One row per part file.
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    parts = lines.groupBy("file").agg(F.count(F.lit(1)).alias("_n")).select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = lines.join(parts, "file").withColumn("f", F.split("value", "\t"))
    return numbered.select((F.col("line_no") + F.col("_before")).alias("ordinal"), *[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_mtx(
    spark: SparkSession, matrix: str, features: str, barcodes: str, modality: str | None = None, check: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matrix-market entries ``(i, j, x)``, features and barcodes by 1-based ordinal.

    With ``modality`` only features of that type are kept. A folder of part files also works.
    """
    lines = read_lines(spark, matrix)
    body = lines.filter(~F.col("value").startswith("%") & (F.trim("value") != ""))
    head = lines.filter(F.col("value").startswith("%%MatrixMarket")).select("file")
    first = body.join(head, "file", "left_semi").orderBy("line_no").first()
    require(first is not None, "The matrix has no size line")
    rows, columns, entries = (int(v) for v in first["value"].split())
    is_size = (F.col("file") == first["file"]) & (F.col("line_no") == first["line_no"])
    cut = body.filter(~is_size).withColumn("f", F.split(F.trim("value"), r"\s+"))
    triples = cut.select(
        F.expr("CAST(f[0] AS BIGINT)").alias("i"), F.expr("CAST(f[1] AS BIGINT)").alias("j"), F.expr("try_cast(f[2] AS DOUBLE)").alias("x")
    )
    genes = _ordinals(spark, features, ("gene_id", "gene_name", "gene_type"))
    cells = _ordinals(spark, barcodes, ("cell",))
    if check:
        require(genes.count() == rows, "Feature count does not match matrix rows")
        require(cells.count() == columns, "Barcode count does not match matrix columns")
        for name, table, size in (("feature", genes, rows), ("barcode", cells, columns)):
            seen = table.agg(F.count_distinct("ordinal").alias("n"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high")).first()
            require(size == 0 or (seen["n"], seen["low"], seen["high"]) == (size, 1, size), f"The {name} numbers are not 1 to {size}")
        require(triples.count() == entries, "Entry count does not match the size line")
        triples = stored(triples, {COUNT_MESSAGE: whole_count("x", 1e-8)})
    typed = triples.withColumn("x", F.round("x").cast("bigint"))
    if modality is not None:
        genes = genes.filter(F.col("gene_type") == modality)
        require(not genes.isEmpty(), f"No features of type {modality}")
        typed = typed.join(genes.select(F.col("ordinal").alias("i")), "i", "left_semi")
    return typed, genes, cells


def read_10x(spark: SparkSession, folder: str, suffix: str = ".gz") -> tuple[DataFrame, DataFrame, DataFrame]:
    """A 10x folder: gene-expression features, names from column 2."""
    triples, genes, cells = read_mtx(
        spark,
        f"{folder}/matrix.mtx{suffix}",
        f"{folder}/features.tsv{suffix}",
        f"{folder}/barcodes.tsv{suffix}",
        modality="Gene Expression",
    )
    return triples, genes, cells


def _sha256():
    @F.pandas_udf(StringType())
    def digest(paths: pd.Series) -> pd.Series:
        def one(path: str) -> str:
            system, inner = store(path)
            state = hashlib.sha256()
            with system.open_input_stream(inner, compression=None) as stream:
                while block := stream.read(1 << 20):
                    state.update(block)
            return state.hexdigest()

        return paths.map(one)

    return digest


def hash_files(spark: SparkSession, inputs: DataFrame, path: str = "path", label: str = "dataset") -> DataFrame:
    """SHA-256 and size of every file under the inputs ``ordinal, label, path``.

    Only names are listed by the planner; tasks stream the contents, so files of any size fit.
    """
    listed = []
    # One row per manifest line.
    for row in inputs.select("ordinal", label, path).collect():
        place = absolute(row[path]).rstrip("/")
        system, inner = store(place)
        info = system.get_file_info(inner)
        require(info.type != fs.FileType.NotFound, f"Missing input: {place}")
        files = [info]
        if info.type == fs.FileType.Directory:
            files = [f for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File]
        require(bool(files), f"No file below {place}")
        for found in files:
            relative = "." if found.path == inner else found.path[len(inner.rstrip("/")) + 1 :]
            whole = place if relative == "." else f"{place}/{relative}"
            listed.append((row["ordinal"] + 1, row[label], place, relative, found.size, whole))
    table = spark.createDataFrame(
        listed, "manifest_row BIGINT, label STRING, input_path STRING, relative_file STRING, bytes BIGINT, _file STRING"
    )
    spread = table.repartition(max(1, min(len(listed), 10_000)), "_file")
    return spread.withColumn("sha256", _sha256()("_file")).drop("_file")
