"""Line-oriented formats: numbered lines, SAM, chimeric junctions, GTF, barcodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlattice.contracts import expect, expect_unique, id_rule, require, stored
from seqlattice.session import materialize

JUNCTION_FIELDS = 14


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``file, line_no, value`` with 1-based physical line numbers.

    Big plain files stay split. The lines are written out once with their split and their place in it, so the counts
    per split and the lines themselves come from one and the same scan, whatever splits the planner would choose another time;
    each split is then shifted by the lines of the splits before it. The counts are one row per split.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    scan = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_id"),
        "value",
    )
    lines = materialize(scan)
    splits = lines.groupBy("file", "_at").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    shifts = splits.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return lines.join(shifts, ["file", "_at"]).select(
        "file", (F.col("_id") - F.col("_first") + F.col("_shift") + 1).alias("line_no"), "value"
    )


def read_parts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``folder, line_no, value``: lines numbered through all files of a folder, the files in name order."""
    lines = read_lines(spark, paths).withColumn("folder", F.regexp_extract("file", "^(.*)/[^/]*$", 1))
    # One row per file.
    before = Window.partitionBy("folder").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = lines.groupBy("folder", "file").agg(F.count(F.lit(1)).alias("_n"))
    shifts = sizes.select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return lines.join(shifts, "file").select("folder", (F.col("line_no") + F.col("_before")).alias("line_no"), "value")


def _blank(value: str = "value"):
    return F.trim(F.col(value)) == ""


def sample_of(path, suffix: str):
    """Sample id in a file name, in front of ``suffix``."""
    return F.regexp_extract(path, rf"([^/]+){suffix}$", 1)


# --- SAM -----------------------------------------------------------------------------------------


def parse_tags(fields):
    """``TAG:TYPE:VALUE`` fields as a map; a repeated tag keeps its last value."""
    parts = F.transform(fields, lambda f: F.split(f, ":", 3))
    valid = F.transform(F.filter(parts, lambda p: F.size(p) == 3), lambda p: F.struct(p[0].alias("key"), p[2].alias("value")))

    def last(pairs):
        later = lambda i: F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0)))
        return F.filter(pairs, lambda p, i: ~F.exists(later(i), lambda q: q["key"] == p["key"]))

    # As a lambda's variable the pairs are made once for a row, not again for each of them.
    return F.map_from_entries(F.get(F.transform(F.array(valid), last), F.lit(0)))


def parse_sam(lines: DataFrame, check: bool = True) -> DataFrame:
    """Alignments of ``file, line_no, value`` lines, tags as a map. With ``check`` they are parsed once, written, and read back from there."""
    body = lines.filter(~_blank() & ~F.col("value").startswith("@"))
    cut = body.withColumn("f", F.split("value", "\t"))

    def number(i: int, kind: str):
        return F.expr(f"try_cast(get(f, {i}) AS {kind})")

    def field(i: int):
        return F.get("f", F.lit(i))

    table = cut.select(
        "file",
        F.col("line_no").alias("ordinal"),
        field(0).alias("qname"),
        number(1, "INT").alias("flag"),
        field(2).alias("rname"),
        number(3, "BIGINT").alias("pos"),
        number(4, "INT").alias("mapq"),
        field(5).alias("cigar"),
        field(6).alias("rnext"),
        number(7, "BIGINT").alias("pnext"),
        number(8, "BIGINT").alias("tlen"),
        field(9).alias("seq"),
        field(10).alias("qual"),
        parse_tags(F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0)))).alias("tags"),
    )
    if not check:
        return table
    # The eleventh field is there only if all before it are.
    return stored(table, {"Malformed SAM record": F.col("qual").isNotNull() & F.col("flag").isNotNull()})


def read_sam(spark: SparkSession, paths: str | Sequence[str], check: bool = True) -> DataFrame:
    """SAM text files as a table, one row per alignment."""
    return parse_sam(read_lines(spark, paths), check)


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """An alignment table stored as Parquet."""
    return spark.read.parquet(path)


# --- junctions -----------------------------------------------------------------------------------


def parse_junctions(lines: DataFrame) -> DataFrame:
    """Junction records of ``sample, line_no, value`` lines; unusable ones are kept and flagged."""
    records = lines.filter((F.col("value") != "") & ~F.col("value").rlike(r"^\s*#")).withColumn("f", F.split("value", "\t"))
    # The fields of a chimeric junction record.
    names = (
        "chrom1 pos1 strand1 chrom2 pos2 strand2 junction_type repeat_left repeat_right read_name "
        "start1 cigar1 start2 cigar2"
    ).split()
    whole = r"^\s*[+-]?[0-9]+\s*$"
    columns = []
    for i, name in enumerate(names):
        value = F.get("f", F.lit(i))
        if name in ("pos1", "pos2"):
            value = F.when(value.rlike(whole), F.expr(f"try_cast(trim(get(f, {i})) AS BIGINT)"))
        columns.append(value.alias(name))
    return records.select(
        "sample", F.col("line_no").alias("source_line"), *columns, F.col("value").alias("raw_record"), F.size("f").alias("_width")
    ).withColumn("malformed", (F.col("_width") < JUNCTION_FIELDS) | F.col("pos1").isNull() | F.col("pos2").isNull()).drop("_width")


def read_junctions(
    spark: SparkSession, paths: str | Sequence[str], suffix: str = r"_Chimeric\.out\.junction(?:\.gz)?", sample: str | None = None
) -> DataFrame:
    """Chimeric junction files; ``source_line`` counts comments and blank lines too."""
    named = F.lit(sample) if sample is not None else sample_of(F.col("file"), suffix)
    return parse_junctions(read_lines(spark, paths).withColumn("sample", named))


# --- GTF -----------------------------------------------------------------------------------------


def attribute(text: str, key: str):
    """Last value of a GTF attribute; null if absent."""
    found = F.regexp_extract_all(text, F.lit(rf'(?:^|;)\s*{key} \s*"?([^";]*)"?\s*(?=;|$)'), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def parse_gtf(lines: DataFrame) -> DataFrame:
    """Features of ``file, line_no, value`` lines; ``width`` is the number of fields found."""
    body = lines.filter(~_blank() & ~F.col("value").startswith("#"))
    cut = body.withColumn("f", F.split("value", "\t"))

    def field(i: int):
        return F.get("f", F.lit(i))

    return cut.select(
        "file",
        F.col("line_no").alias("ordinal"),
        F.size("f").alias("width"),
        field(0).alias("chrom"),
        field(1).alias("source"),
        field(2).alias("feature"),
        F.expr("try_cast(get(f, 3) AS BIGINT)").alias("start"),
        F.expr("try_cast(get(f, 4) AS BIGINT)").alias("end"),
        field(6).alias("strand"),
        field(8).alias("attributes"),
    ).select(
        "*",
        attribute("attributes", "gene_id").alias("gene_id"),
        attribute("attributes", "gene_name").alias("gene_name"),
        attribute("attributes", "gene_biotype").alias("gene_biotype"),
        attribute("attributes", "gene_type").alias("gene_type"),
    )


def read_gtf(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return parse_gtf(read_lines(spark, paths))


def gene_annotation(gtf: DataFrame) -> DataFrame:
    """``gene_id, gene_name, gene_type``: the last gene feature, else the first feature of the gene."""
    named = gtf.filter((F.col("width") >= 9) & (F.coalesce("gene_id", F.lit("")) != ""))
    is_gene = (F.col("feature") == "gene").cast("int")
    rank = F.struct(is_gene, F.when(is_gene == 1, F.col("ordinal")).otherwise(-F.col("ordinal")))
    entry = F.struct(
        F.coalesce("gene_name", "gene_id").alias("gene_name"),
        F.coalesce("gene_biotype", "gene_type", F.lit("NA")).alias("gene_type"),
    )
    return named.groupBy("gene_id").agg(F.max_by(entry, rank).alias("_e")).select("gene_id", "_e.*")


def gene_intervals(gtf: DataFrame, check: bool = True) -> DataFrame:
    """Gene features as closed intervals."""
    if check:
        gtf = stored(gtf, {"Malformed GTF record": F.col("width") == 9})
    genes = gtf.filter(F.col("feature") == "gene").select(
        "chrom", "start", "end", F.coalesce("gene_id", F.lit("")).alias("gene_id"), F.coalesce("gene_name", "gene_id").alias("gene_name"), "strand"
    )
    if check:
        fine = (F.col("gene_id") != "") & (F.col("gene_name") != "") & (F.col("start") >= 1) & (F.col("end") >= F.col("start"))
        genes = stored(genes, {"Invalid gene feature": fine}, least="The GTF has no gene features")
    return genes


def exon_intervals(gtf: DataFrame, feature: str = "exon") -> DataFrame:
    return gtf.filter((F.col("feature") == feature) & (F.coalesce("gene_id", F.lit("")) != "")).select(
        "chrom", "start", "end", "gene_id"
    )


# --- barcodes ------------------------------------------------------------------------------------


def read_barcodes(spark: SparkSession, path: str, regex: str | None = None, expect_count: int | None = None) -> DataFrame:
    """Called-cell barcodes: first field per line, header words skipped, non-empty and unique."""
    value = F.split(F.trim("value"), "\t")[0].alias("barcode")
    found = spark.read.text(path).select(value)
    found = found.filter((F.col("barcode") != "") & ~F.lower("barcode").isin("barcode", "cell_barcode"))
    checks = {"Unexpected barcode form": id_rule("barcode", regex)} if regex else {}
    found = stored(found, checks, least="The barcode list is empty")
    expect_unique(found, ["barcode"], "Duplicate barcode")
    if expect_count is not None:
        seen = found.count()
        require(seen == expect_count, f"Expected {expect_count} barcodes, found {seen}")
    return found
