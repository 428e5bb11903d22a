"""Two-ended records, range joins and read-to-gene assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlattice.operators import fusion as X
from seqlattice.operators import ranges as G
from seqlattice.sources.text import parse_junctions
from workload import tables as W

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


@query(
    "junction_parse",
    """
    WITH x AS (
      SELECT l_suppkey AS sample, l_orderkey * 10 + l_linenumber AS source_line,
        CASE WHEN l_linenumber = 7 THEN NULL WHEN l_tax = 0.08 THEN NULL ELSE l_partkey END AS pos1, l_linenumber, l_tax
      FROM lineitem WHERE l_returnflag <> 'N' OR l_linestatus = 'F')
    SELECT sample, count(*) AS records, count(*) FILTER (pos1 IS NULL) AS malformed_records,
      CAST(sum(pos1) AS BIGINT) AS position_sum, max(source_line) AS last_line
    FROM x GROUP BY 1
    """,
)
def junction_parse(spark, folder):
    """Lines with 13 or 14 fields, bad positions and comments, as text."""
    position = F.when(F.col("l_tax") == 0.08, "1.5").otherwise(F.col("l_partkey").cast("string"))
    fields = ["chr22", position, "+", "chr9", F.col("l_partkey") + 9, "-", "1", "0", "0", F.concat(F.lit("r"), "l_orderkey"),
              "1", "10M", "2"]
    tail = F.when(F.col("l_linenumber") == 7, "").otherwise("\t20M")
    text = F.concat(F.concat_ws("\t", *[F.lit(f) if isinstance(f, str) else f for f in fields]), tail)
    comment = (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O")
    lines = W.line_fields(spark, folder).select(
        F.col("l_suppkey").alias("sample"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"),
        F.when(comment, F.concat(F.lit(" # "), text)).otherwise(text).alias("value"),
    )
    parsed = parse_junctions(lines)
    return parsed.groupBy("sample").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if("malformed").alias("malformed_records"),
        F.sum(F.when(~F.col("malformed"), F.col("pos1"))).alias("position_sum"),
        F.max("source_line").alias("last_line"),
    )


@query(
    "fusion_records",
    "WITH "
    + W.JUNCTIONS_SQL
    + """
    SELECT sample, source_line, chrom1, pos1, strand1, chrom2, pos2, strand2, ub AS "UB", report_order,
      CASE WHEN canonical_a_pos IS NULL THEN 0 ELSE 1 END AS interval_match,
      CASE WHEN canonical_a_strand = '+' AND canonical_b_strand = '+' THEN 1 ELSE 0 END AS strand_match,
      CASE WHEN canonical_a_strand = '+' AND canonical_b_strand = '+' THEN 1 ELSE 0 END AS expected_orientation,
      CASE WHEN report_order = 'ABL1_then_BCR' THEN 1 ELSE 0 END AS reverse_report, canonical_a_pos, canonical_b_pos
    FROM classified WHERE on_contigs AND NOT malformed
    """,
)
def fusion_records(spark, folder):
    scanned = X.scan_junctions(W.junctions(spark, folder), W.REGION_A, W.REGION_B)
    return scanned.select(
        "sample", "source_line", "chrom1", "pos1", "strand1", "chrom2", "pos2", "strand2", "UB", "report_order",
        "interval_match", "strand_match", "expected_orientation", "reverse_report", "canonical_a_pos", "canonical_b_pos",
    )


@query(
    "fusion_summary",
    "WITH "
    + W.JUNCTIONS_SQL
    + """,
    hits AS (SELECT *, on_contigs AND NOT malformed AND coalesce(canonical_a_strand = '+' AND canonical_b_strand = '+', FALSE) AS hit
             FROM classified),
    counted AS (
      SELECT sample, count(*) AS total, count(*) FILTER (malformed) AS bad, count(*) FILTER (hit) AS hits,
        count(DISTINCT read_name) FILTER (hit) AS names, count(DISTINCT ub) FILTER (hit AND ub <> '') AS umis,
        count(DISTINCT (canonical_a_pos, canonical_a_strand, canonical_b_pos, canonical_b_strand)) FILTER (hit) AS breaks
      FROM hits GROUP BY 1),
    joined AS (
      SELECT s_suppkey AS sample,
        CASE s_nationkey WHEN 0 THEN 'missing_junction_file' WHEN 1 THEN 'incomplete_mapping' ELSE 'complete' END AS given, counted.* EXCLUDE (sample)
      FROM supplier LEFT JOIN counted ON s_suppkey = sample),
    statused AS (
      SELECT sample, CASE WHEN given = 'complete' AND bad > 0 THEN 'malformed_junction_records' ELSE given END AS mapping_status,
        CASE WHEN given = 'complete' THEN coalesce(total, 0) ELSE 0 END AS total, CASE WHEN given = 'complete' THEN coalesce(bad, 0) ELSE 0 END AS bad,
        CASE WHEN given = 'complete' THEN coalesce(hits, 0) ELSE 0 END AS hits, CASE WHEN given = 'complete' THEN coalesce(names, 0) ELSE 0 END AS names,
        CASE WHEN given = 'complete' THEN coalesce(umis, 0) ELSE 0 END AS umis, CASE WHEN given = 'complete' THEN coalesce(breaks, 0) ELSE 0 END AS breaks
      FROM joined)
    SELECT sample, mapping_status, total AS chimeric_records_total, bad AS malformed_records,
      hits AS expected_orientation_read_records, names AS unique_read_names, umis AS "unique_UB", breaks AS unique_junctions,
      CASE WHEN mapping_status = 'complete' THEN CASE WHEN hits > 0 THEN 1 ELSE 0 END END AS "expected_BCR_ABL1_candidate",
      CASE mapping_status WHEN 'missing_junction_file' THEN 'not_evaluated_missing_junction'
        WHEN 'incomplete_mapping' THEN 'not_evaluated_incomplete_mapping'
        WHEN 'malformed_junction_records' THEN 'not_evaluated_malformed_junctions'
        ELSE CASE WHEN hits = 0 THEN 'not_detected' WHEN umis >= 12 THEN 'candidate_ge_min_umi' ELSE 'candidate_low_umi' END
      END AS "expected_BCR_ABL1_candidate_call"
    FROM statused
    """,
)
def fusion_summary(spark, folder):
    return X.evidence_summary(
        W.junctions(spark, folder), W.fusion_manifest(spark, folder), W.REGION_A, W.REGION_B, min_umi=12
    )


@query(
    "interval_overlap",
    "WITH "
    + W.GENES_SQL
    + """,
    points AS (SELECT CAST(l_partkey * 20 + l_quantity AS BIGINT) AS pos, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
    SELECT gene_id, count(*) AS hits, CAST(sum(q) AS BIGINT) AS quantity
    FROM points JOIN genes ON chrom = 'c' || CAST(floor(pos / 4000.0) AS BIGINT) AND pos BETWEEN gstart AND gend
    GROUP BY 1
    """,
)
def interval_overlap(spark, folder):
    position = (F.col("l_partkey") * 20 + F.col("l_quantity")).cast("bigint")
    points = W.line_fields(spark, folder).select(
        W._contig(position).alias("chrom"), position.alias("pos"), F.col("l_quantity").cast("bigint").alias("q")
    )
    genes = W.gene_intervals(spark, folder).select("chrom", "start", "end", "gene_id")
    hits = G.range_join(points, genes, bin_size=W.BIN)
    return hits.groupBy("gene_id").agg(F.count(F.lit(1)).alias("hits"), F.sum("q").alias("quantity"))


def _annotated(spark, folder):
    return X.annotate_pairs(
        W.gene_junctions(spark, folder),
        W.gene_intervals(spark, folder),
        "Brand#1",
        "Brand#2",
        record_key=["source_line", "pos1", "pos2", "CB"],
        bin_size=W.BIN,
    )


@query(
    "intergenic_pairs",
    "WITH "
    + W.PAIRS_SQL
    + """,
    labelled AS (SELECT source_line, gene1_name, gene2_name,
        CASE WHEN 'Brand#1' IN (gene1_name, gene2_name) AND 'Brand#2' IN (gene1_name, gene2_name)
               THEN 'Brand#1_Brand#2,Brand#1_any,Brand#2_any,whole_intergene'
             WHEN 'Brand#1' IN (gene1_name, gene2_name) THEN 'Brand#1_any,whole_intergene'
             WHEN 'Brand#2' IN (gene1_name, gene2_name) THEN 'Brand#2_any,whole_intergene'
             ELSE 'whole_intergene' END AS categories FROM pairs)
    SELECT gene1_name, gene2_name, categories, count(*) AS pairs, count(DISTINCT source_line) AS lines
    FROM labelled GROUP BY 1, 2, 3
    """,
)
def intergenic_pairs(spark, folder):
    counted = _annotated(spark, folder).groupBy("gene1_name", "gene2_name").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_distinct("source_line").alias("lines")
    )
    # The categories follow from the names, so they are not a key of the rows that move.
    categories = F.array_join(X.pair_categories("Brand#1", "Brand#2"), ",")
    return counted.select("gene1_name", "gene2_name", categories.alias("categories"), "pairs", "lines")


@query(
    "category_support",
    "WITH "
    + W.PAIRS_SQL
    + """
    SELECT category, original_qname, cb AS "CB", ub AS "UB",
      CASE WHEN cb IN (SELECT barcode FROM called) THEN 1 ELSE 0 END AS called_cell FROM last_records
    """,
)
def category_support(spark, folder):
    return X.category_support(_annotated(spark, folder), W.called_cells(spark, folder))


@query(
    "category_summary",
    "WITH "
    + W.PAIRS_SQL
    + """,
    denominators AS (
      SELECT (SELECT count(DISTINCT (l_suppkey, l_partkey_tag)) FROM (
                SELECT l_suppkey, substr(md5(CAST(l_partkey AS VARCHAR)), 1, 4) AS l_partkey_tag FROM lineitem
                WHERE l_tax > 0 AND l_suppkey IN (SELECT barcode FROM called))) AS all_pairs,
        (SELECT count(*) FROM called) AS all_cells),
    marked AS (SELECT *, cb IN (SELECT barcode FROM called) AS is_called FROM last_records),
    names(category) AS (VALUES ('whole_intergene'), ('Brand#1_any'), ('Brand#2_any'), ('Brand#1_Brand#2')),
    counted AS (
      SELECT names.category, count(original_qname) AS n_all, count(*) FILTER (is_called) AS n_called,
        count(DISTINCT (cb, ub)) FILTER (is_called AND ub <> '') AS n_pairs, count(DISTINCT cb) FILTER (is_called) AS n_cells
      FROM names LEFT JOIN marked USING (category) GROUP BY 1)
    SELECT category, n_all AS physical_reads_all, n_called AS physical_reads_called_cells, n_pairs AS fusion_cb_umi_pairs,
      all_pairs AS total_called_cb_umi_pairs, round(100.0 * n_pairs / all_pairs, 6)::DOUBLE AS fusion_umi_percent,
      n_cells AS positive_called_cells, all_cells AS total_called_cells,
      round(100.0 * n_cells / all_cells, 6)::DOUBLE AS positive_cell_percent
    FROM counted, denominators
    """,
)
def category_summary(spark, folder):
    called = W.called_cells(spark, folder)
    support = X.category_support(_annotated(spark, folder), called)
    summary = X.category_summary(support, W.cell_tags(spark, folder), called, "Brand#1", "Brand#2").drop("ordinal")
    for name in ("fusion_umi_percent", "positive_cell_percent"):
        summary = summary.withColumn(name, F.round(name, 6))
    return summary


KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def _assigned(spark, folder):
    position = (F.col("l_partkey") * 20 + F.col("l_quantity")).cast("bigint")
    alignments = W.line_fields(spark, folder).select(
        *KEY,
        F.when(F.col("l_linestatus") == "F", 1).when(F.col("l_tax") == 0.01, 9).otherwise(3).alias("flag"),
        W._contig(position).alias("rname"),
        position.alias("pos"),
        F.when(F.col("l_tax") == 0.0, 3).otherwise(255).alias("mapq"),
        F.concat(F.lit("2S"), 4 + F.col("l_linenumber"), F.lit("M1I2D"), 3 * F.col("l_linenumber"), F.lit("N3M")).alias("cigar"),
        F.when(F.col("l_discount") >= 0.09, 2).otherwise(1).alias("nh"),
    )
    exons = W.gene_intervals(spark, folder).select("chrom", "start", "end", "gene_id")
    return G.assign_reads(alignments, exons, KEY)


@query(
    "read_gene_assign",
    "WITH "
    + W.GENES_SQL
    + """,
    a AS (SELECT row_number() OVER () AS id, CAST(l_partkey * 20 + l_quantity AS BIGINT) AS pos, l_linenumber AS n,
            CASE WHEN l_linestatus = 'F' THEN 1 WHEN l_tax = 0.01 THEN 9 ELSE 3 END AS flag,
            CASE WHEN l_discount >= 0.09 THEN 2 ELSE 1 END AS nh
          FROM lineitem WHERE l_tax <> 0.0),
    blocks AS (
      SELECT id, 'c' || CAST(floor(pos / 4000.0) AS BIGINT) AS contig, pos AS f, pos + 5 + n AS t FROM a
      UNION ALL SELECT id, 'c' || CAST(floor(pos / 4000.0) AS BIGINT), pos + 6 + 4 * n, pos + 8 + 4 * n FROM a),
    hits AS (SELECT id, min(gene_id) AS low, max(gene_id) AS high
             FROM blocks JOIN genes ON chrom = contig AND f <= gend AND t >= gstart GROUP BY 1),
    s AS (SELECT CASE WHEN flag = 9 THEN 'Unassigned_Singleton' WHEN nh > 1 THEN 'Unassigned_MultiMapping'
                  WHEN low IS NULL THEN 'Unassigned_NoFeatures' WHEN low <> high THEN 'Unassigned_Ambiguity' ELSE 'Assigned' END AS status, low
          FROM a LEFT JOIN hits USING (id))
    SELECT status, CASE WHEN status = 'Assigned' THEN low END AS gene_id, count(*) AS reads FROM s GROUP BY 1, 2
    """,
)
def read_gene_assign(spark, folder):
    return _assigned(spark, folder).groupBy("status", "gene_id").agg(F.count(F.lit(1)).alias("reads"))
