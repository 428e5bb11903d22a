"""Count matrices, names, quality control and exact order statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seqlattice.operators import counts as C
from seqlattice.operators import ordering as O
from seqlattice.operators import qc as Q
from seqlattice.sources import datasets
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
    "gene_totals",
    "SELECT l_partkey AS gene, l_suppkey AS cell, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS count FROM lineitem GROUP BY 1, 2",
)
def gene_totals(spark, folder):
    return C.gene_totals(W.line_counts(spark, folder))


LIBRARIES = ["AF", "AO", "NF", "NO", "RF", "RO"]


@query(
    "gene_matrix",
    "SELECT l_partkey AS gene_id, "
    + ", ".join(
        f"CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag || l_linestatus = '{s}'), 0) AS BIGINT) AS \"{s}\""
        for s in LIBRARIES
    )
    + " FROM lineitem GROUP BY 1",
)
def gene_matrix(spark, folder):
    counts = W.bulk_counts(spark, folder).withColumnRenamed("sample", "cell")
    return C.wide_counts(counts, LIBRARIES)


@query(
    "annotate_features",
    """
    SELECT p_partkey AS gene_id, coalesce(c_name, CAST(p_partkey AS VARCHAR)) AS gene_name, coalesce(c_mktsegment, 'NA') AS gene_type
    FROM part LEFT JOIN customer ON c_custkey = p_partkey
    """,
)
def annotate_features(spark, folder):
    genes = W.table(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("gene_id"))
    annotation = W.table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("gene_id"), F.col("c_name").alias("gene_name"), F.col("c_mktsegment").alias("gene_type")
    )
    return C.annotate_features(genes, annotation).withColumn("gene_id", F.col("gene_id").cast("bigint"))


@query(
    "collapse_features",
    """
    SELECT p_brand AS gene, l_suppkey AS cell, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS count
    FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type <> 'ECONOMY' GROUP BY 1, 2
    """,
)
def collapse_features(spark, folder):
    names = W.table(spark, folder, "part").select(
        F.col("p_partkey").alias("gene"), F.when(F.col("p_type") != "ECONOMY", F.col("p_brand")).otherwise("").alias("gene_name")
    )
    return C.collapse_features(C.gene_totals(W.line_counts(spark, folder)), names)


@query(
    "unique_names",
    """
    SELECT p_partkey AS ordinal, replace(CASE WHEN n = 1 THEN name ELSE name || '.' || (n - 1) END, '_', '-') AS feature
    FROM (SELECT p_partkey, replace(p_name, ' ', '_') AS name,
            row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)
    """,
)
def unique_names(spark, folder):
    features = W.table(spark, folder, "part").select(
        F.col("p_partkey").alias("ordinal"), F.translate("p_name", " ", "_").alias("gene_id")
    )
    return C.feature_names(features).select("ordinal", "feature")


@query(
    "min_cells_features",
    """
    WITH x AS (SELECT l_partkey AS gene, l_orderkey AS cell, sum(CAST(l_quantity AS BIGINT)) AS count FROM lineitem GROUP BY 1, 2),
    k AS (SELECT * FROM x WHERE cell IN (SELECT cell FROM x GROUP BY 1 HAVING count(*) >= 4))
    SELECT gene, count(*) AS cells, CAST(sum(count) AS BIGINT) AS total FROM k GROUP BY 1 HAVING count(*) >= 25
    """,
)
def min_cells_features(spark, folder):
    counts = W.table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("gene"), F.col("l_orderkey").alias("cell"), F.col("l_quantity").cast("bigint").alias("count")
    )
    kept = C.CellDataset.from_counts(counts).filter_sparse(min_cells=25, min_features=4)
    return kept.counts.groupBy("gene").agg(F.count(F.lit(1)).alias("cells"), F.sum("count").alias("total"))


@query(
    "merged_datasets",
    """
    SELECT CAST(gene AS VARCHAR) AS gene, dataset, "group", count(*) AS cells, CAST(sum(count) AS BIGINT) AS total FROM (
      SELECT l_partkey AS gene, l_suppkey AS cell, 'one' AS dataset, 'x' AS "group", sum(CAST(l_quantity AS BIGINT)) AS count
      FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL
      UNION ALL
      SELECT l_partkey, l_suppkey, 'two', 'y', sum(CAST(l_quantity AS BIGINT)) FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL)
    GROUP BY ALL
    """,
)
def merged_datasets(spark, folder):
    lines = W.table(spark, folder, "lineitem")

    def part(status):
        rows = lines.filter(F.col("l_linestatus") == status).select(
            F.col("l_partkey").cast("string").alias("gene"), F.col("l_suppkey").alias("cell"), F.col("l_quantity").cast("bigint").alias("count")
        )
        return C.CellDataset.from_counts(rows)

    merged = C.merge_datasets({"one": part("F"), "two": part("O")}, {"one": "x", "two": "y"})
    labels = merged.cells.select("cell", "dataset", "group")
    return merged.counts.join(labels, "cell").groupBy("gene", "dataset", "group").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("count").alias("total")
    )


def _samples(spark, folder):
    return W.table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("sample")).agg(
        F.count(F.lit(1)).alias("featurecounts_assigned"), F.sum(F.col("l_quantity").cast("bigint")).alias("total_deduplicated_umis")
    )


SAMPLES_SQL = """
samples AS (SELECT l_suppkey AS sample, count(*) AS reads, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS umis FROM lineitem GROUP BY 1)
"""


@query(
    "qc_flags",
    "WITH "
    + SAMPLES_SQL
    + """
    SELECT sample, reads AS featurecounts_assigned, umis AS total_deduplicated_umis, (reads <= 600)::INT AS assigned_read_pass,
      (umis <= 15300)::INT AS deduplicated_umi_pass, (reads <= 600 AND umis <= 15300)::INT AS raw_qc_keep,
      CASE WHEN reads <= 600 AND umis <= 15300 THEN 'keep' ELSE 'raw_qc_removal' END AS raw_qc_status
    FROM samples
    """,
)
def qc_flags(spark, folder):
    return Q.qc_flags(_samples(spark, folder), assigned_threshold=600, umi_threshold=15300)


@query(
    "qc_retention",
    "WITH "
    + SAMPLES_SQL
    + """
    SELECT count(*) AS sample_count, CAST(sum((reads <= 600 AND umis <= 15300)::INT) AS BIGINT) AS retained_sample_count,
      CAST(sum((NOT (reads <= 600 AND umis <= 15300))::INT) AS BIGINT) AS removed_sample_count FROM samples
    """,
)
def qc_retention(spark, folder):
    return Q.retention(qc_flags(spark, folder))


@query(
    "qc_thresholds",
    "WITH "
    + SAMPLES_SQL
    + """
    SELECT 'assigned_reads' AS name, 0.65::DOUBLE AS probability, round(quantile_cont(reads::DOUBLE, 0.65), 6) AS value FROM samples
    UNION ALL SELECT 'deduplicated_umis', 0.70, round(quantile_cont(umis::DOUBLE, 0.70), 6) FROM samples
    """,
)
def qc_thresholds(spark, folder):
    columns = {
        "assigned_reads": ("featurecounts_assigned", Q.ASSIGNED_PERCENTILE),
        "deduplicated_umis": ("total_deduplicated_umis", Q.UMI_PERCENTILE),
    }
    return Q.empirical_thresholds(_samples(spark, folder), columns).withColumn("value", F.round("value", 6))


@query(
    "umi_totals",
    """
    SELECT c_custkey AS sample, CAST(coalesce(sum(CAST(o_totalprice AS BIGINT)), 0) AS BIGINT) AS total
    FROM customer LEFT JOIN (SELECT o_custkey, floor(o_totalprice) AS o_totalprice FROM orders) ON o_custkey = c_custkey GROUP BY 1
    """,
)
def umi_totals(spark, folder):
    counts = W.table(spark, folder, "orders").select(F.col("o_custkey").alias("cell"), F.floor("o_totalprice").alias("count"))
    return Q.umi_totals(counts, W.table(spark, folder, "customer").select(F.col("c_custkey").alias("sample")))


@query(
    "quantile_type7",
    """
    SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.65), 6) AS p65, round(quantile_cont(l_extendedprice, 0.70), 6) AS p70,
      max(l_extendedprice) AS p100
    FROM lineitem GROUP BY 1
    """,
)
def quantile_type7(spark, folder):
    lines = W.table(spark, folder, "lineitem")
    found = O.quantiles(lines, ["l_returnflag"], "l_extendedprice", {"p65": 0.65, "p70": 0.70, "p100": 1.0})
    return found.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("p65", "p70", "p100")])


@query(
    "average_ranks",
    """
    SELECT l_returnflag, l_quantity, round(avg(r), 6) AS mean_rank, count(*) AS n FROM (
      SELECT l_returnflag, l_quantity, rank() OVER w + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS r
      FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity)) GROUP BY 1, 2
    """,
)
def average_ranks(spark, folder):
    lines = W.table(spark, folder, "lineitem").select("l_returnflag", "l_quantity")
    ranked = O.average_rank(lines, ["l_returnflag"], "l_quantity", "r")
    return ranked.groupBy("l_returnflag", "l_quantity").agg(
        F.round(F.avg("r"), 6).alias("mean_rank"), F.count(F.lit(1)).alias("n")
    )


@query(
    "bh_fdr",
    """
    WITH p AS (SELECT p_partkey, ((p_partkey * 7919) % 997) / 9970.0::DOUBLE AS p FROM part),
    r AS (SELECT *, row_number() OVER (ORDER BY p, p_partkey) AS rk, count(*) OVER () AS n FROM p)
    SELECT p_partkey, p, round(least(1.0, min(p * n / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 9) AS fdr FROM r
    """,
)
def bh_fdr(spark, folder):
    key = F.col("p_partkey")
    p = W.table(spark, folder, "part").select("p_partkey", (((key * 7919) % 997) / 9970.0).alias("p"))
    return O.benjamini_hochberg(p, "p", "fdr").select("p_partkey", "p", F.round("fdr", 9).alias("fdr"))


@query(
    "bh_fdr_nulls",
    """
    WITH p AS (SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN ((p_partkey * 7919) % 997) / 9970.0::DOUBLE END AS p FROM part),
    r AS (SELECT *, row_number() OVER (ORDER BY p, p_partkey) AS rk, count(*) OVER () AS n FROM p WHERE p IS NOT NULL)
    SELECT p_partkey, p, round(least(1.0, min(p * n / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 9) AS fdr FROM r
    UNION ALL SELECT p_partkey, p, NULL FROM p WHERE p IS NULL
    """,
)
def bh_fdr_nulls(spark, folder):
    key = F.col("p_partkey")
    p = W.table(spark, folder, "part").select("p_partkey", F.when(F.col("p_size") % 5 > 0, ((key * 7919) % 997) / 9970.0).alias("p"))
    return O.benjamini_hochberg(p, "p", "fdr").select("p_partkey", "p", F.round("fdr", 9).alias("fdr"))


@query(
    "average_ranks_nulls",
    """
    WITH o AS (SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS g, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS v, o_orderkey FROM orders)
    SELECT o_orderkey, round(rank() OVER w + (count(*) OVER (PARTITION BY g, v) - 1) / 2.0, 6) AS mean_rank
    FROM o WHERE v IS NOT NULL WINDOW w AS (PARTITION BY g ORDER BY v)
    UNION ALL SELECT o_orderkey, NULL FROM o WHERE v IS NULL
    """,
)
def average_ranks_nulls(spark, folder):
    orders = W.table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("g"),
        F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).alias("v"),
    )
    return O.average_rank(orders, ["g"], "v", "r").select("o_orderkey", F.round("r", 6).alias("mean_rank"))


def _tracking(spark, folder, legacy):
    key = F.get_json_object("props", "$.k")
    events = W.table(spark, folder, "events")
    kind = F.col("event_type")
    alignments = events.select(
        F.col("user_id").alias("sample"),
        F.when(kind == "error", 4).otherwise(0).alias("flag"),
        F.when(F.col("value") > 30, "mouse_chr1").otherwise("chr1").alias("rname"),
        F.when(kind == "click", "Assigned").when(kind == "view", "Unassigned_NoFeatures").when(kind == "signup", "Unassigned_Secondary").alias("XS"),
        F.col("user_id").cast("string").alias("CB"),
        F.when(F.col("value") > 2, key).alias("UB"),
        F.when(kind == "click", F.substring(key, 1, 1)).alias("XT"),
    )
    step = (
        F.when(kind == "click", "raw_umi").when(kind == "view", "raw_noumi").when(kind == "signup", "trimmed_umi").otherwise("trimmed_noumi")
    )
    records = events.select(F.col("user_id").alias("sample"), step.alias("step"), F.when(F.col("value") > 10, 2).otherwise(1).alias("mate"))
    counts = events.select(F.col("user_id").alias("cell"), F.col("event_id").alias("count"))
    manifest = W.table(spark, folder, "customer").select(F.col("c_custkey").alias("sample"))
    return Q.read_tracking(Q.record_counts(records), alignments, counts, manifest, legacy)


def _tracking_sql(raw: str) -> str:
    return f"""
    WITH e AS (
      SELECT user_id AS sample, event_id, event_type, value, regexp_extract(props, '([0-9]+)', 1) AS k,
        CASE WHEN value > 30 THEN 'mouse' ELSE 'human' END AS species,
        CASE event_type WHEN 'click' THEN 'Assigned' WHEN 'view' THEN 'Unassigned_NoFeatures' ELSE 'Unassigned_Other' END AS status,
        CASE event_type WHEN 'click' THEN 'raw_umi' WHEN 'view' THEN 'raw_noumi' WHEN 'signup' THEN 'trimmed_umi' ELSE 'trimmed_noumi' END AS fq
      FROM events WHERE user_id IN (SELECT c_custkey FROM customer)),
    m AS (SELECT c_custkey AS sample FROM customer),
    steps(step) AS (VALUES ('raw_umi'), ('raw_noumi'), ('trimmed_umi'), ('trimmed_noumi')),
    fq AS (SELECT m.sample, 0 AS section, steps.step, CAST(count(e.event_id) FILTER (value <= 10 OR ({raw})) AS VARCHAR) AS value
           FROM m CROSS JOIN steps LEFT JOIN e ON e.sample = m.sample AND e.fq = steps.step GROUP BY 1, 3),
    st AS (SELECT sample, 1 AS section, 'reads_' || species || '_' || status AS step, count(*) AS n FROM e
           WHERE event_type <> 'error' GROUP BY ALL),
    hm AS (SELECT sample, coalesce(sum(n) FILTER (step = 'reads_human_Assigned'), 0) AS h, coalesce(sum(n) FILTER (step = 'reads_mouse_Assigned'), 0) AS x
           FROM st GROUP BY 1),
    tg AS (SELECT m.sample, count(e.event_id) FILTER (event_type = 'click' AND value > 2) AS reads,
             count(DISTINCT (k, substr(k, 1, 1))) FILTER (event_type = 'click' AND value > 2) AS umis
           FROM m LEFT JOIN e ON e.sample = m.sample GROUP BY 1)
    SELECT * FROM fq
    UNION ALL SELECT sample, section, step, CAST(n AS VARCHAR) FROM st
    UNION ALL SELECT sample, 2, 'Percent_Human_Assigned', printf('%.2f%%', 100.0 * h / (h + x)) FROM hm WHERE h + x > 0
    UNION ALL SELECT sample, 3, 'Tagged_Reads', CAST(reads AS VARCHAR) FROM tg
    UNION ALL SELECT sample, 4, 'UMIs_tagged', CAST(umis AS VARCHAR) FROM tg
    UNION ALL SELECT m.sample, 5, 'UMIs_deduplicated', CAST(CAST(coalesce(sum(event_id), 0) AS BIGINT) AS VARCHAR)
      FROM m LEFT JOIN e ON e.sample = m.sample GROUP BY 1
    """


@query("read_tracking", _tracking_sql("FALSE"))
def read_tracking(spark, folder):
    return _tracking(spark, folder, legacy=False)


@query("read_tracking_legacy", _tracking_sql("starts_with(steps.step, 'raw_')"))
def read_tracking_legacy(spark, folder):
    return _tracking(spark, folder, legacy=True)


@query("file_hashes")
def file_hashes(spark, folder):
    from seqlattice.sources.tables import hash_files

    inputs = spark.createDataFrame([(1, "driver", folder)], "ordinal BIGINT, dataset STRING, path STRING")
    return hash_files(spark, inputs).drop("input_path")


# --- stored datasets -----------------------------------------------------------------------------

_MERGED = """
  x AS (SELECT dataset || '_' || CAST(l_suppkey AS VARCHAR) AS cell, l_suppkey, dataset, CASE dataset WHEN 'one' THEN 'x' ELSE 'y' END AS "group", l_partkey AS gene, sum(CAST(l_quantity AS BIGINT)) AS count
        FROM (SELECT *, CASE l_linestatus WHEN 'F' THEN 'one' ELSE 'two' END AS dataset FROM lineitem) GROUP BY ALL),
  t AS (SELECT cell, CAST(sum(count) AS BIGINT) AS total, count(*) AS genes FROM x GROUP BY 1)
"""


def _merged(spark, folder):
    """Two datasets in one, cells labelled by dataset, group and candidate."""
    lines = W.table(spark, folder, "lineitem")
    sides = {}
    for name, status in (("one", "F"), ("two", "O")):
        counts = lines.filter(F.col("l_linestatus") == status).select(
            F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("cell"), F.col("l_quantity").cast("bigint").alias("count")
        )
        sides[name] = C.CellDataset.from_counts(counts)
    candidates = W.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("sample"), (F.col("s_nationkey") % 2).cast("int").alias("candidate"))
    return C.attach_candidates(C.merge_datasets(sides, {"one": "x", "two": "y"}), candidates, "x")


def _stored(spark, folder):
    from seqlattice.session import checkpoint_folder

    place = f"{checkpoint_folder(spark)}/dataset-{uuid.uuid4().hex}"
    datasets.write_dataset(_merged(spark, folder), place, buckets=8)
    return datasets.read_dataset(spark, place)


@query(
    "dataset_roundtrip",
    f"""
    WITH {_MERGED}
    SELECT x.cell, dataset, "group", CAST(s_nationkey % 2 AS INT) AS fusion_candidate, genes, total, round(sum(ln(1 + count / total * 10000.0::DOUBLE)), 6) AS log_sum
    FROM x JOIN t USING (cell) JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL
    """,
)
def dataset_roundtrip(spark, folder):
    """Two merged datasets with labels, written in buckets, read back, normalised and summed up by cell without a shuffle of counts."""
    stored = _stored(spark, folder)
    sums = stored.normalized().groupBy("cell").agg(F.count(F.lit(1)).alias("genes"), F.sum("count").alias("total"), F.round(F.sum("value"), 6).alias("log_sum"))
    return stored.cells.hint("merge").join(sums, "cell").select("cell", "dataset", "group", "fusion_candidate", "genes", "total", "log_sum")


@query(
    "dataset_group_moments",
    f"""
    WITH {_MERGED},
    n AS (SELECT count(DISTINCT cell) AS n FROM x WHERE "group" = 'y'),
    s AS (SELECT gene, sum(count) AS s, sum(count * count) AS q, count(*) AS k FROM x WHERE "group" = 'y' GROUP BY 1)
    SELECT g.gene, coalesce(k, 0) AS nonzero, coalesce(s, 0) / n AS mean, round(greatest(0, (coalesce(q, 0) - coalesce(s, 0)::DOUBLE * coalesce(s, 0) / n) / (n - 1)), 6) AS variance
    FROM (SELECT DISTINCT gene FROM x) g LEFT JOIN s USING (gene), n
    """,
)
def dataset_group_moments(spark, folder):
    """Moments of all genes over the cells of one group of a stored dataset."""
    return _stored(spark, folder).select_cells(F.col("group") == "y").moments().withColumn("variance", F.round("variance", 6))
