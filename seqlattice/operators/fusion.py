"""Two-ended junction records: targeted fusion evidence and intergenic categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlattice.contracts import ContractError, expect, expect_unique, require
from seqlattice.functions.reads import extract_tag
from seqlattice.functions.regions import contains, on_contigs
from seqlattice.operators.ranges import range_join
from seqlattice.schemas import ABL1, BCR, Region
from seqlattice.session import materialize

OUTSIDE = "outside_target_intervals"


def classify_pair(junctions: DataFrame, a: Region = BCR, b: Region = ABL1) -> DataFrame:
    """Order the two ends as (a, b) and flag interval, strand and orientation matches.

    If both orders fit, the reported one (end 1 in ``a``) wins.
    """
    forward = contains("chrom1", "pos1", a) & contains("chrom2", "pos2", b)
    backward = contains("chrom1", "pos1", b) & contains("chrom2", "pos2", a)
    orders = (f"{a.name}_then_{b.name}", f"{b.name}_then_{a.name}")
    report = F.when(forward, orders[0]).when(backward, orders[1]).otherwise(OUTSIDE)

    def end(side: str, field: str):
        ahead, behind = ("1", "2") if side == "a" else ("2", "1")
        return F.when(forward, F.col(field + ahead)).when(backward, F.col(field + behind))

    ordered = junctions.withColumn("report_order", report)
    for side in ("a", "b"):
        for field in ("chrom", "pos", "strand"):
            ordered = ordered.withColumn(f"canonical_{side}_{field}", end(side, field))
    interval = F.col("report_order") != OUTSIDE
    strand = F.coalesce(
        (F.col("canonical_a_strand") == a.strand) & (F.col("canonical_b_strand") == b.strand), F.lit(False)
    )
    return (
        ordered.withColumn("interval_match", interval.cast("int"))
        .withColumn("strand_match", (interval & strand).cast("int"))
        .withColumn("expected_orientation", (interval & strand).cast("int"))
        .withColumn("reverse_report", (F.col("report_order") == orders[1]).cast("int"))
    )


def scan_junctions(junctions: DataFrame, a: Region = BCR, b: Region = ABL1) -> DataFrame:
    """Well-formed records on the two target contigs, classified, with the UMI of the read name."""
    kept = junctions.filter(~F.col("malformed")) if "malformed" in junctions.columns else junctions
    kept = kept.filter(on_contigs("chrom1", "chrom2", a, b))
    return classify_pair(kept.withColumn("UB", extract_tag("read_name", "UB")), a, b)


def report_columns(scanned: DataFrame, a: Region = BCR, b: Region = ABL1, stems: tuple[str, str] = ("bcr", "abl")) -> DataFrame:
    """The record report: input fields, flags and canonical ends, named after the two regions."""
    one, two = stems
    flags = {
        f"{one}_{two}_interval_match": "interval_match",
        f"{one}_{two}_strand_match": "strand_match",
        f"{one}_{two}_expected_orientation": "expected_orientation",
        f"{two}_{one}_reverse_report": "reverse_report",
    }
    ends = {
        f"canonical_{region.name.lower()}_{field}": f"canonical_{side}_{field}"
        for side, region in (("a", a), ("b", b))
        for field in ("chrom", "pos", "strand")
    }
    plain = (
        "sample source_line chrom1 pos1 strand1 chrom2 pos2 strand2 junction_type repeat_left repeat_right "
        "read_name UB start1 cigar1 start2 cigar2 report_order"
    ).split()
    renamed = [F.col(old).alias(new) for new, old in {**flags, **ends}.items()]
    return scanned.select(*plain, *renamed, "raw_record")


def evidence_summary(
    junctions: DataFrame, manifest: DataFrame, a: Region = BCR, b: Region = ABL1, min_umi: int = 2
) -> DataFrame:
    """One row per manifest sample with record counts, distinct evidence and the call.

    ``manifest`` has ``sample`` and may have ``mapping_status`` (``missing_junction_file`` or
    ``incomplete_mapping`` for samples without usable input; null or ``complete`` otherwise).

    One pass over the records: rows that are no evidence collapse to one row per sample before the
    shuffle, and only the rest is expanded for the distinct counts, so a huge sample stays spread out.
    """
    require(min_umi >= 1, "The minimum UMI count must be at least 1")
    malformed = F.col("malformed") if "malformed" in junctions.columns else F.lit(False)
    usable = ~malformed & on_contigs("chrom1", "chrom2", a, b)
    records = classify_pair(junctions.withColumn("_malformed", malformed), a, b)
    hit = usable & (F.col("expected_orientation") == 1)
    ends = [f"canonical_{s}_{f}" for s in "ab" for f in ("chrom", "pos", "strand")]
    records = records.select(
        "sample",
        F.col("_malformed"),
        hit.alias("_hit"),
        F.when(hit, F.col("read_name")).alias("_name"),
        *[F.when(hit, F.col(e)).alias(e) for e in ends],
    )
    merged = records.groupBy("sample", "_malformed", "_hit", "_name", *ends).agg(F.count(F.lit(1)).alias("_n"))
    merged = merged.withColumn("_ub", F.when(F.col("_hit"), F.nullif(extract_tag("_name", "UB"), F.lit(""))))
    counted = merged.groupBy("sample").agg(
        F.sum("_n").alias("_total"),
        F.sum(F.when(F.col("_malformed"), F.col("_n"))).alias("_bad"),
        F.sum(F.when(F.col("_hit"), F.col("_n"))).alias("_hits"),
        F.count_distinct("_name").alias("_names"),
        F.count_distinct("_ub").alias("_umis"),
        F.count_distinct(*ends).alias("_breaks"),
    )
    given = F.col("mapping_status") if "mapping_status" in manifest.columns else F.lit(None).cast("string")
    samples = manifest.select(
        *[c for c in manifest.columns if c in ("sample", "ordinal")], F.coalesce(given, F.lit("complete")).alias("_given")
    )
    joined = samples.join(counted, "sample", "left")
    evaluated = F.col("_given") == "complete"

    def number(name: str):
        return F.when(evaluated, F.coalesce(F.col(name), F.lit(0))).otherwise(F.lit(0)).cast("bigint")

    joined = joined.select(
        *samples.columns,
        *[number(c).alias(c) for c in ("_total", "_bad", "_hits", "_names", "_umis", "_breaks")],
    )
    status = F.when(~evaluated, F.col("_given")).when(F.col("_bad") > 0, "malformed_junction_records").otherwise("complete")
    call = (
        F.when(F.col("mapping_status") == "missing_junction_file", "not_evaluated_missing_junction")
        .when(F.col("mapping_status") == "incomplete_mapping", "not_evaluated_incomplete_mapping")
        .when(F.col("mapping_status") == "malformed_junction_records", "not_evaluated_malformed_junctions")
        .when(F.col("_hits") == 0, "not_detected")
        .when(F.col("_umis") >= min_umi, "candidate_ge_min_umi")
        .otherwise("candidate_low_umi")
    )
    pair = f"expected_{a.name}_{b.name}_candidate"
    carried = ["ordinal"] if "ordinal" in samples.columns else []
    return joined.withColumn("mapping_status", status).select(
        *carried,
        "sample",
        "mapping_status",
        F.col("_total").alias("chimeric_records_total"),
        F.col("_bad").alias("malformed_records"),
        F.col("_hits").alias("expected_orientation_read_records"),
        F.col("_names").alias("unique_read_names"),
        F.col("_umis").alias("unique_UB"),
        F.col("_breaks").alias("unique_junctions"),
        F.when(F.col("mapping_status") == "complete", (F.col("_hits") > 0).cast("int")).alias(pair),
        call.alias(f"{pair}_call"),
    )


def enforce_policy(summary: DataFrame, fail_on_missing: bool = True, fail_on_malformed: bool = True) -> DataFrame:
    """Raise at the end for samples that could not be evaluated.

    An unfinished mapping counts as missing.
    """
    refused = []
    if fail_on_missing:
        refused += ["missing_junction_file", "incomplete_mapping"]
    if fail_on_malformed:
        refused += ["malformed_junction_records"]
    if refused:
        view = summary.select("sample", "mapping_status")
        expect(view, ~F.col("mapping_status").isin(refused), "Samples could not be evaluated")
    return summary


# --- intergenic categories ----------------------------------------------------------------------


def category_names(a: str, b: str) -> tuple[str, ...]:
    return ("whole_intergene", f"{a}_any", f"{b}_any", f"{a}_{b}")


def pair_categories(a: str, b: str) -> Column:
    """Sorted category names of ``gene1_name`` and ``gene2_name`` as one of four constant arrays, so nothing is built per row."""
    has_a = (F.col("gene1_name") == a) | (F.col("gene2_name") == a)
    has_b = (F.col("gene1_name") == b) | (F.col("gene2_name") == b)
    whole, any_a, any_b, both = category_names(a, b)

    def constant(*names: str):
        return F.array(*[F.lit(n) for n in sorted(names)])

    return (
        F.when(has_a & has_b, constant(whole, any_a, any_b, both))
        .when(has_a, constant(whole, any_a))
        .when(has_b, constant(whole, any_b))
        .otherwise(constant(whole))
    )


def attach_metadata(junctions: DataFrame, metadata: DataFrame, check: bool = True) -> DataFrame:
    """Cell and molecule tags of the read behind each junction; a read without metadata is an error."""
    keys = metadata.select(F.col("star_read_name").alias("read_name"), "original_qname", "CB", "UB")
    joined = junctions.drop("UB", "CB", "original_qname").join(keys, "read_name", "left")
    if check:
        view = joined.select("source_line", "read_name", "original_qname")
        expect(view, F.col("original_qname").isNotNull(), "Junctions without read metadata")
    return joined


def annotate_pairs(
    junctions: DataFrame,
    genes: DataFrame,
    a: str = "BCR",
    b: str = "ABL1",
    record_key: Sequence[str] = ("source_line",),
    bin_size: int = 1_000_000,
    **join_options,
) -> DataFrame:
    """Every pair of different genes under the two ends of a junction, with its categories.

    ``genes``: ``chrom, start, end, gene_id, gene_name, strand``. The second end is joined on the rows
    of the first, so there is no self-join; with a broadcast annotation the junctions never move. The distinct
    intervals are looked at several times, so they are written once.
    """
    identity = ["gene_id", "gene_name", "strand"]
    intervals = materialize(genes.select("chrom", "start", "end", *identity).dropDuplicates())
    repeats = not intervals.groupBy(*identity).count().filter("count > 1").isEmpty()
    found = junctions
    for n in ("1", "2"):
        side = intervals.select(
            F.col("chrom").alias(f"chrom{n}"), "start", "end", *[F.col(c).alias(f"_{c}_{n}") for c in identity]
        )
        found = range_join(
            found,
            side,
            on=[f"chrom{n}"],
            position=f"pos{n}",
            bin_size=bin_size,
            **join_options,
        ).drop("start", "end")
    found = found.filter(F.col("_gene_id_1") != F.col("_gene_id_2"))
    if repeats:
        # A gene given as several overlapping intervals counts once per end.
        found = found.dropDuplicates([*record_key, *[f"_{c}_{n}" for n in "12" for c in identity]])
    for n in ("1", "2"):
        for c in identity:
            found = found.withColumnRenamed(f"_{c}_{n}", f"gene{n}_{c.removeprefix('gene_')}")
    return found.withColumn("categories", pair_categories(a, b))


def annotation_report(annotated: DataFrame) -> DataFrame:
    columns = (
        "source_line original_qname CB UB chrom1 pos1 strand1 gene1_id gene1_name gene1_strand "
        "chrom2 pos2 strand2 gene2_id gene2_name gene2_strand"
    ).split()
    return annotated.select(*columns, F.array_join("categories", ",").alias("categories"))


def category_support(annotated: DataFrame, called: DataFrame) -> DataFrame:
    """One row per category and read; the last record of a read gives its tags."""
    rows = annotated.select(F.explode("categories").alias("category"), "original_qname", "source_line", "CB", "UB")
    # The read name leads the key: it tells rows apart in the sort's key prefix.
    last = rows.groupBy("original_qname", "category").agg(F.max(F.struct("source_line", "CB", "UB")).alias("_last"))
    barcodes = called.select(F.col("barcode").alias("CB"), F.lit(1).alias("called_cell")).dropDuplicates()
    return (
        last.select("category", "original_qname", "_last.CB", "_last.UB")
        .join(barcodes, "CB", "left")
        .select("category", "original_qname", "CB", "UB", F.coalesce("called_cell", F.lit(0)).alias("called_cell"))
    )


def called_pairs(metadata: DataFrame, called: DataFrame) -> DataFrame:
    """Number of distinct cell/UMI pairs over all primary reads of called cells, as one row."""
    barcodes = called.select(F.col("barcode").alias("CB"))
    given = (F.col("CB").cast("string") != "") & (F.col("UB").cast("string") != "")
    tagged = metadata.filter(given).join(barcodes, "CB", "left_semi")
    return tagged.agg(F.count_distinct("CB", "UB").alias("pairs"))


def category_summary(
    support: DataFrame, metadata: DataFrame, called: DataFrame, a: str = "BCR", b: str = "ABL1"
) -> DataFrame:
    """Reads, molecules and cells per category with explicit denominators; all categories appear."""
    spark = support.sparkSession
    is_called = F.col("called_cell") == 1
    counted = support.groupBy("category").agg(
        F.count(F.lit(1)).alias("_all"),
        F.count_if(is_called).alias("_called"),
        F.count_distinct(
            F.when(is_called & (F.coalesce("UB", F.lit("")) != ""), F.struct("CB", "UB"))
        ).alias("_pairs"),
        F.count_distinct(F.when(is_called, F.col("CB"))).alias("_cells"),
    )
    names = spark.createDataFrame([(n, i) for i, n in enumerate(category_names(a, b))], "category STRING, ordinal INT")
    # Two single numbers; both are needed whole by every output row.
    pairs = called_pairs(metadata, called).first()["pairs"]
    cells = called.select("barcode").distinct().count()

    def number(name: str):
        return F.coalesce(F.col(name), F.lit(0)).cast("bigint")

    def percent(part: str, whole: int):
        return F.try_divide(100.0 * number(part), F.lit(whole).cast("double"))

    return names.join(counted, "category", "left").select(
        "ordinal",
        "category",
        number("_all").alias("physical_reads_all"),
        number("_called").alias("physical_reads_called_cells"),
        number("_pairs").alias("fusion_cb_umi_pairs"),
        F.lit(pairs).cast("bigint").alias("total_called_cb_umi_pairs"),
        percent("_pairs", pairs).alias("fusion_umi_percent"),
        number("_cells").alias("positive_called_cells"),
        F.lit(cells).cast("bigint").alias("total_called_cells"),
        percent("_cells", cells).alias("positive_cell_percent"),
    )


def check_metadata(metadata: DataFrame) -> DataFrame:
    """Read metadata: keys present, and repeated keys only as identical rows."""
    if metadata.isEmpty():
        raise ContractError("The metadata table of the reads is empty")
    expect(metadata, F.col("star_read_name") != "", "A metadata row names no read")
    distinct = metadata.dropDuplicates()
    expect_unique(distinct, ["star_read_name"], "One read has several different metadata rows")
    return distinct
