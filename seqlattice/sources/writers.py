"""Text sinks. Each writes a folder of part files in order; Parquet is the form for further work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlattice.contracts import require, stored
from seqlattice.functions.reads import fastq_record
from seqlattice.operators.counts import CellDataset, gene_totals, wide_counts
from seqlattice.operators.ordering import row_numbers
from seqlattice.session import materialize


def write_tsv(
    df: DataFrame,
    path: str,
    columns: Sequence[str],
    order: Sequence[str] = (),
    null: str = "",
    single_file: bool = False,
    mode: str = "errorifexists",
    compression: str = "none",
) -> None:
    """Headed TSV in a fixed column order. ``single_file`` is for reports, which are small."""
    if order:
        df = df.orderBy(*order)
    out = df.select(*columns)
    if single_file:
        out = out.coalesce(1)
    out.write.mode(mode).csv(
        path, sep="\t", header=True, nullValue=null, emptyValue="", quote="", compression=compression
    )


def write_mtx(
    data: CellDataset,
    path: str,
    samples: DataFrame | None = None,
    single_file: bool = False,
    mode: str = "errorifexists",
) -> None:
    """``matrix.mtx``, ``features.tsv`` and ``barcodes.tsv``; genes sorted, cells in sample order.

    The part files of the matrix, put together in name order, form one matrix-market file.
    """
    genes = materialize(row_numbers(data.features, [], ["gene"], "i"))
    if samples is None:
        cells = row_numbers(data.cells.select("cell"), [], ["cell"], "j")
    else:
        cells = row_numbers(samples.select(F.col("sample").alias("cell"), "ordinal"), [], ["ordinal"], "j")
    cells = materialize(cells.select("cell", "j"))
    entries = data.counts.filter("count > 0").join(genes.select("gene", "i"), "gene").join(cells, "cell").select("i", "j", "count")
    entries = materialize(entries)
    found = entries.count()
    require(found > 0, "No positive counts to write")
    banner = entries.sparkSession.createDataFrame(
        [
            (0, 0, "%%MatrixMarket matrix coordinate integer general"),
            (0, 1, f"{genes.count()} {cells.count()} {found}"),
        ],
        "i BIGINT, j BIGINT, value STRING",
    )
    lines = banner.unionByName(entries.select("i", "j", F.concat_ws(" ", "i", "j", "count").alias("value")))

    def put(rows: DataFrame, order: Sequence[str], name: str) -> None:
        ranged = rows.coalesce(1) if single_file else rows.repartitionByRange(*order)
        ranged.sortWithinPartitions(*order).select("value").write.mode(mode).text(f"{path}/{name}")

    put(lines, ["i", "j"], "matrix.mtx")
    blank = {"gene_id": F.col("gene"), "gene_name": F.col("gene"), "gene_type": F.lit("NA")}
    fields = [F.col(c) if c in genes.columns else blank[c] for c in blank]
    put(genes.select("i", F.concat_ws("\t", *fields).alias("value")), ["i"], "features.tsv")
    put(cells.select("j", F.col("cell").alias("value")), ["j"], "barcodes.tsv")


def write_wide_counts(counts: DataFrame, path: str, samples: Sequence[str], mode: str = "errorifexists") -> None:
    """Gene-by-sample TSV, genes sorted, samples in the given order, gzip."""
    table = wide_counts(gene_totals(counts), samples)
    write_tsv(table, path, ["gene_id", *samples], order=["gene_id"], mode=mode, compression="gzip")


def write_fastq(df: DataFrame, path: str, by: Sequence[str] = (), order: Sequence[str] = (), mode: str = "errorifexists", compression: str = "gzip") -> None:
    """FASTQ parts of ``name, seq, qual`` rows, gzip unless told otherwise, one folder per value of ``by``.

    With ``order`` the parts of a folder, put together in name order, keep the reads in that order.
    """
    record = df.select(*by, *order, fastq_record("name", "seq", "qual").alias("value"))
    keys = [*by, *order]
    if keys:
        record = record.repartitionByRange(*keys).sortWithinPartitions(*keys)
    writer = record.select(*by, "value").write.mode(mode).option("compression", compression)
    (writer.partitionBy(*by) if by else writer).text(path)


def write_split_fastq(split: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The four outputs of the UMI split (class by mate) for every sample."""
    mates = F.array(
        *[
            F.struct(F.lit(f"R{n}").alias("mate"), F.col(f"seq{n}").alias("seq"), F.col(f"qual{n}").alias("qual"))
            for n in (1, 2)
        ]
    )
    rows = split.select("sample", "umi_class", "ordinal", "name", F.explode(mates).alias("_m"))
    rows = rows.select("sample", "umi_class", "ordinal", "name", "_m.*")
    write_fastq(rows, path, by=["sample", "umi_class", "mate"], order=["ordinal"], mode=mode)


def write_primary(reads: DataFrame, fastq_path: str, metadata_path: str, mode: str = "errorifexists") -> None:
    """Primary reads as FASTQ and their metadata table, from the same rows."""
    require(fastq_path != metadata_path, "The outputs must differ")
    table = stored(reads, {"Bases and qualities differ in number": F.length("seq") == F.length("qual")}, least="There are no reads to write")
    order = ["ordinal"] if "ordinal" in table.columns else []
    write_fastq(table.withColumnRenamed("star_read_name", "name"), fastq_path, order=order, mode=mode)
    write_tsv(table, metadata_path, ["star_read_name", "original_qname", "CB", "UB", "CR", "UR"], mode=mode)


def write_subset(chosen: DataFrame, prefix: str, path: str, mode: str = "errorifexists") -> None:
    """De-identified mates of a subset, renamed in input order."""
    from seqlattice.functions.reads import output_name

    mates = F.array(
        *[
            F.struct(
                F.lit(f"R{n}").alias("mate"),
                output_name(prefix, "output_index", n).alias("name"),
                F.col(f"seq{n}").alias("seq"),
                F.col(f"qual{n}").alias("qual"),
            )
            for n in (1, 2)
        ]
    )
    rows = chosen.select("output_index", F.explode(mates).alias("_m")).select("output_index", "_m.*")
    write_fastq(rows, path, by=["mate"], order=["output_index"], mode=mode)


def metrics_table(spark, values: dict[str, object], names: tuple[str, str] = ("parameter", "value")) -> DataFrame:
    """Key/value rows with values as text; missing values are null."""
    rows = [(k, None if v is None else str(v)) for k, v in values.items()]
    return spark.createDataFrame(rows, f"{names[0]} STRING, {names[1]} STRING")


def write_coordinates(table: DataFrame, path: str, mode: str = "errorifexists") -> None:
    columns = ["cell", "original_sample", "dataset", "group", "fusion_candidate"]
    axes = [c for c in table.columns if c.startswith("PC_")]
    write_tsv(table, path, [*columns, *axes], order=["cell"], mode=mode)
