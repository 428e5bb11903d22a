"""Driver tables read as reads, alignments, junctions, intervals, counts and samples.

The SQL twins used by the checks stand next to each view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlattice.operators.counts import GROUP_ROWS, CellDataset
from seqlattice.schemas import Contrast, Region

ANCHOR, UMI_LENGTH = "the ", 8
REGION_A = Region("BCR", "chr22", 10_000, 400_000, "+")
REGION_B = Region("ABL1", "chr9", 5_000, 300_000, "+")
CONTRAST = Contrast("A", "B")
BIN = 512
CONTIG = 4_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def line_fields(spark, folder) -> DataFrame:
    columns = "orderkey partkey suppkey linenumber quantity extendedprice discount tax returnflag linestatus".split()
    return table(spark, folder, "lineitem").select(*[f"l_{c}" for c in columns])


def _ordered_lines(spark, folder) -> DataFrame:
    """Lines with their order: both tables are large, so they are shuffled on the order key and never broadcast."""
    orders = table(spark, folder, "orders").hint("merge")
    return line_fields(spark, folder).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


# --- reads: documents ----------------------------------------------------------------------------


def read_pairs(spark, folder) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.select(
        F.col("source").alias("sample"),
        F.col("doc_id").alias("ordinal"),
        F.concat(F.lit("doc"), "doc_id").alias("read_id"),
        F.col("text").alias("seq1"),
        F.col("text").alias("qual1"),
        F.col("lang").alias("seq2"),
        F.col("lang").alias("qual2"),
    )


# --- junctions: lineitem joined with orders ------------------------------------------------------


def junctions(spark, folder) -> DataFrame:
    lines = _ordered_lines(spark, folder)
    flag, status = F.col("l_returnflag"), F.col("o_orderstatus")
    umi = F.when(F.col("l_tax") > 0, F.concat(F.lit("|UB:"), F.substring(F.md5(F.col("l_partkey").cast("string")), 1, 4)))
    return lines.select(
        F.col("l_suppkey").alias("sample"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_line"),
        F.when(flag == "A", "chr22").when(flag == "N", "chr9").otherwise("chr1").alias("chrom1"),
        (F.col("l_quantity") * 10000 + F.col("l_partkey")).cast("bigint").alias("pos1"),
        F.when(F.col("l_linestatus") == "F", "+").otherwise("-").alias("strand1"),
        F.when(status == "F", "chr9").when(status == "O", "chr22").otherwise("chr1").alias("chrom2"),
        F.floor("o_totalprice").cast("bigint").alias("pos2"),
        F.when(F.col("o_orderpriority") < "4", "+").otherwise("-").alias("strand2"),
        F.concat(
            F.lit("r"), "l_orderkey", F.lit("_"), "l_linenumber", F.lit("|CB:"), "l_suppkey", F.coalesce(umi, F.lit(""))
        ).alias("read_name"),
        ((F.col("l_quantity") == 50) & (F.col("l_tax") == 0.08) & (F.col("l_discount") == 0.1)).alias("malformed"),
    )


JUNCTIONS_SQL = """
junctions AS (
  SELECT l_suppkey AS sample, l_orderkey * 10 + l_linenumber AS source_line,
    CASE l_returnflag WHEN 'A' THEN 'chr22' WHEN 'N' THEN 'chr9' ELSE 'chr1' END AS chrom1,
    CAST(l_quantity * 10000 + l_partkey AS BIGINT) AS pos1,
    CASE l_linestatus WHEN 'F' THEN '+' ELSE '-' END AS strand1,
    CASE o_orderstatus WHEN 'F' THEN 'chr9' WHEN 'O' THEN 'chr22' ELSE 'chr1' END AS chrom2,
    CAST(floor(o_totalprice) AS BIGINT) AS pos2,
    CASE WHEN o_orderpriority < '4' THEN '+' ELSE '-' END AS strand2,
    'r' || l_orderkey || '_' || l_linenumber || '|CB:' || l_suppkey
      || CASE WHEN l_tax > 0 THEN '|UB:' || substr(md5(CAST(l_partkey AS VARCHAR)), 1, 4) ELSE '' END AS read_name,
    (l_quantity = 50 AND l_tax = 0.08 AND l_discount = 0.1) AS malformed
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
classified AS (
  SELECT *, CASE WHEN a1 AND b2 THEN 'BCR_then_ABL1' WHEN b1 AND a2 THEN 'ABL1_then_BCR'
              ELSE 'outside_target_intervals' END AS report_order,
    CASE WHEN a1 AND b2 THEN pos1 WHEN b1 AND a2 THEN pos2 END AS canonical_a_pos,
    CASE WHEN a1 AND b2 THEN strand1 WHEN b1 AND a2 THEN strand2 END AS canonical_a_strand,
    CASE WHEN a1 AND b2 THEN pos2 WHEN b1 AND a2 THEN pos1 END AS canonical_b_pos,
    CASE WHEN a1 AND b2 THEN strand2 WHEN b1 AND a2 THEN strand1 END AS canonical_b_strand,
    regexp_extract(read_name, '\\|UB:([^|]+)', 1) AS ub,
    ((chrom1 = 'chr22' AND chrom2 = 'chr9') OR (chrom1 = 'chr9' AND chrom2 = 'chr22')) AS on_contigs
  FROM (SELECT *,
      chrom1 = 'chr22' AND pos1 BETWEEN 10000 AND 400000 AS a1, chrom2 = 'chr22' AND pos2 BETWEEN 10000 AND 400000 AS a2,
      chrom1 = 'chr9' AND pos1 BETWEEN 5000 AND 300000 AS b1, chrom2 = 'chr9' AND pos2 BETWEEN 5000 AND 300000 AS b2
    FROM junctions)
)
"""


def fusion_manifest(spark, folder) -> DataFrame:
    status = F.when(F.col("s_nationkey") == 0, "missing_junction_file").when(F.col("s_nationkey") == 1, "incomplete_mapping")
    return table(spark, folder, "supplier").select(F.col("s_suppkey").alias("sample"), status.alias("mapping_status"))


# --- intervals: part; points: lineitem and orders ------------------------------------------------


def gene_intervals(spark, folder) -> DataFrame:
    start = F.col("p_partkey") * 20
    return table(spark, folder, "part").select(
        F.concat(F.lit("c"), F.floor(start / CONTIG).cast("bigint")).alias("chrom"),
        start.alias("start"),
        (start + F.col("p_size")).alias("end"),
        F.col("p_partkey").alias("gene_id"),
        F.col("p_brand").alias("gene_name"),
        F.when(F.col("p_retailprice") < 1000, "+").otherwise("-").alias("strand"),
    )


def _contig(position):
    return F.concat(F.lit("c"), F.floor(position / CONTIG).cast("bigint"))


def gene_junctions(spark, folder) -> DataFrame:
    lines = _ordered_lines(spark, folder)
    one = (F.col("l_partkey") * 20 + F.col("l_quantity")).cast("bigint")
    two = F.col("o_custkey") * 20 + F.col("l_linenumber") * 7
    umi = F.when(F.col("l_tax") > 0, F.substring(F.md5(F.col("l_partkey").cast("string")), 1, 4)).otherwise("")
    return lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_line"),
        F.concat(F.lit("q"), "l_orderkey").alias("original_qname"),
        F.col("l_suppkey").alias("CB"),
        umi.alias("UB"),
        _contig(one).alias("chrom1"),
        one.alias("pos1"),
        F.col("l_linestatus").alias("strand1"),
        _contig(two).alias("chrom2"),
        two.alias("pos2"),
        F.col("o_orderstatus").alias("strand2"),
    )


def cell_tags(spark, folder) -> DataFrame:
    umi = F.when(F.col("l_tax") > 0, F.substring(F.md5(F.col("l_partkey").cast("string")), 1, 4)).otherwise("")
    return table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("CB"), umi.alias("UB"))


def called_cells(spark, folder) -> DataFrame:
    return table(spark, folder, "supplier").filter("s_acctbal > 1000").select(F.col("s_suppkey").alias("barcode"))


GENES_SQL = """
genes AS (
  SELECT 'c' || CAST(floor(p_partkey * 20 / 4000.0) AS BIGINT) AS chrom, p_partkey * 20 AS gstart,
    p_partkey * 20 + p_size AS gend, p_partkey AS gene_id, p_brand AS gene_name
  FROM part
)
"""
PAIRS_SQL = (
    GENES_SQL
    + """,
ends AS (
  SELECT l_orderkey * 10 + l_linenumber AS source_line, 'q' || l_orderkey AS original_qname, l_suppkey AS cb,
    CASE WHEN l_tax > 0 THEN substr(md5(CAST(l_partkey AS VARCHAR)), 1, 4) ELSE '' END AS ub,
    CAST(l_partkey * 20 + l_quantity AS BIGINT) AS pos1, o_custkey * 20 + l_linenumber * 7 AS pos2
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
first_end AS MATERIALIZED (
  SELECT e.*, g1.gene_id AS gene1_id, g1.gene_name AS gene1_name
  FROM ends e JOIN genes g1 ON g1.chrom = 'c' || CAST(floor(pos1 / 4000.0) AS BIGINT) AND pos1 BETWEEN g1.gstart AND g1.gend
),
pairs AS MATERIALIZED (
  SELECT e.*, g2.gene_id AS gene2_id, g2.gene_name AS gene2_name
  FROM first_end e JOIN genes g2 ON g2.chrom = 'c' || CAST(floor(pos2 / 4000.0) AS BIGINT) AND pos2 BETWEEN g2.gstart AND g2.gend
  WHERE e.gene1_id <> g2.gene_id
),
categorised AS (
  SELECT p.*, 'whole_intergene' AS category FROM pairs p
  UNION ALL SELECT p.*, 'Brand#1_any' FROM pairs p WHERE 'Brand#1' IN (gene1_name, gene2_name)
  UNION ALL SELECT p.*, 'Brand#2_any' FROM pairs p WHERE 'Brand#2' IN (gene1_name, gene2_name)
  UNION ALL SELECT p.*, 'Brand#1_Brand#2' FROM pairs p
    WHERE 'Brand#1' IN (gene1_name, gene2_name) AND 'Brand#2' IN (gene1_name, gene2_name)
),
last_records AS MATERIALIZED (
  SELECT category, original_qname, cb, ub FROM (
    SELECT *, row_number() OVER (PARTITION BY category, original_qname ORDER BY source_line DESC, cb DESC, ub DESC) AS rn
    FROM categorised) WHERE rn = 1
),
called AS (SELECT s_suppkey AS barcode FROM supplier WHERE s_acctbal > 1000)
"""
)


# --- counts: lineitem; cells: supplier -----------------------------------------------------------


def line_counts(spark, folder) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("cell"), F.col("l_quantity").cast("bigint").alias("count")
    )


def cells(spark, folder) -> DataFrame:
    label = F.when(F.col("s_nationkey") % 3 == 0, "A").when(F.col("s_nationkey") % 3 == 1, "B").otherwise("C")
    keep = F.when(F.col("s_acctbal") > 0, " Yes ").otherwise("f")
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("cell"), label.alias("condition"), keep.alias("analysis_keep")
    )


def part_dataset(spark, folder) -> CellDataset:
    """Genes are part keys; every part is a feature."""
    features = table(spark, folder, "part").select(F.col("p_partkey").alias("gene"))
    counts = line_counts(spark, folder)
    # The number of lines stands in the file's footer.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-counts.count() // GROUP_ROWS))
    return CellDataset.from_counts(counts, features, cells(spark, folder), parts)


def symbol_features(spark, folder) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("gene"), F.concat_ws("_", "p_name", "p_brand").alias("gene_name")
    )


def de_table(spark, folder) -> DataFrame:
    """Pseudo fold changes and FDRs from whole-number arithmetic on the part key."""
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(
        key.alias("ordinal"),
        key.alias("gene_id"),
        F.concat_ws("_", "p_name", "p_brand").alias("gene_name"),
        (((key * 104729) % 2001 - 1000) / 250.0).alias("logFC"),
        (((key * 7919) % 10007) / 100070.0).alias("FDR"),
    )


COUNTS_SQL = """
cells AS (
  SELECT s_suppkey AS cell, CASE s_nationkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS condition
  FROM supplier WHERE s_acctbal > 0
),
raw_counts AS (
  SELECT l_partkey AS gene, l_suppkey AS cell, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS count
  FROM lineitem JOIN cells ON cell = l_suppkey GROUP BY 1, 2
),
features AS (SELECT p_partkey AS gene FROM part)
"""
SYMBOL_SQL = """
cells AS (
  SELECT s_suppkey AS cell, CASE s_nationkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS condition
  FROM supplier WHERE s_acctbal > 0
),
symbols AS (SELECT p_partkey, p_name || '_' || p_brand AS gene FROM part),
raw_counts AS (
  SELECT gene, l_suppkey AS cell, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS count
  FROM lineitem JOIN cells ON cell = l_suppkey JOIN symbols ON l_partkey = p_partkey GROUP BY 1, 2
),
features AS (SELECT DISTINCT gene FROM symbols)
"""
NORMAL_SQL = """,
totals AS (SELECT cell, sum(count) AS total FROM raw_counts GROUP BY 1),
normal AS (
  SELECT gene, cell, count, count / total::DOUBLE * 10000.0 AS scaled, ln(1 + count / total::DOUBLE * 10000.0) AS value
  FROM raw_counts JOIN totals USING (cell)
)
"""
DE_SQL = """,
de AS (
  SELECT p_partkey AS ordinal, p_partkey AS gene_id, p_name || '_' || p_brand AS gene_name,
    ((p_partkey * 104729) % 2001 - 1000) / 250.0::DOUBLE AS logfc, ((p_partkey * 7919) % 10007) / 100070.0::DOUBLE AS fdr
  FROM part
),
best AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY gene_name ORDER BY fdr, abs(logfc) DESC, ordinal) AS rn FROM de) WHERE rn = 1
)
"""


# --- bulk libraries: lineitem by flag and status -------------------------------------------------


def bulk_counts(spark, folder) -> DataFrame:
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_partkey").alias("gene"), F.concat("l_returnflag", "l_linestatus").alias("sample"))
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("count"))
    )


def bulk_samples(spark, folder) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus").distinct()
    return lines.select(
        F.concat("l_returnflag", "l_linestatus").alias("sample"),
        F.when(F.col("l_linestatus") == "F", "A").otherwise("B").alias("condition"),
    )


BULK_SQL = """
bulk AS (
  SELECT l_partkey AS gene, l_returnflag || l_linestatus AS sample, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS count
  FROM lineitem GROUP BY 1, 2
),
design AS (
  SELECT DISTINCT l_returnflag || l_linestatus AS sample, CASE l_linestatus WHEN 'F' THEN 'A' ELSE 'B' END AS condition
  FROM lineitem
),
libs AS (SELECT sample, sum(count)::DOUBLE AS lib FROM bulk GROUP BY 1)
"""
