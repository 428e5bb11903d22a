"""Bulk expression statistics on six libraries."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlattice.operators import bulk as B
from seqlattice.session import materialize
from workload import tables as W

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


FLAGS_SQL = """,
flags AS (
  SELECT gene, count(*) FILTER (count / lib * 1e6 >= 10.0 / (SELECT median(lib) FROM libs) * 1e6) AS libraries_above,
    CAST(sum(count) AS BIGINT) AS total
  FROM bulk JOIN libs USING (sample) GROUP BY 1),
kept AS (SELECT gene FROM flags WHERE libraries_above >= 3 AND total >= 15),
kept_counts AS (SELECT * FROM bulk WHERE gene IN (SELECT gene FROM kept)),
kept_libs AS (SELECT sample, sum(count)::DOUBLE AS lib FROM kept_counts GROUP BY 1)
"""


@query("library_sizes", "WITH " + W.BULK_SQL + "SELECT sample, CAST(lib AS BIGINT) AS library_size FROM libs")
def library_sizes(spark, folder):
    return B.library_sizes(W.bulk_counts(spark, folder))


@query(
    "filter_by_expr",
    "WITH " + W.BULK_SQL + FLAGS_SQL + "SELECT *, (libraries_above >= 3 AND total >= 15)::INT AS kept FROM flags",
)
def filter_by_expr(spark, folder):
    flags = B.expression_flags(W.bulk_counts(spark, folder), W.bulk_samples(spark, folder))
    return flags.withColumn("kept", F.col("kept").cast("int"))


def _kept(spark, folder):
    # Used several times: written once.
    counts = materialize(W.bulk_counts(spark, folder))
    return materialize(B.filter_by_expr(counts, W.bulk_samples(spark, folder)))


QUARTILES_SQL = """,
grid AS (SELECT gene, sample, coalesce(count, 0) AS count FROM (SELECT DISTINCT gene FROM kept_counts) g CROSS JOIN kept_libs
         LEFT JOIN kept_counts USING (gene, sample)),
quart AS (SELECT sample, lib, quantile_cont(count::DOUBLE, 0.75) / lib AS q FROM grid JOIN kept_libs USING (sample) GROUP BY sample, lib),
ref AS (SELECT sample FROM quart ORDER BY abs(q - (SELECT avg(q) FROM quart)), sample LIMIT 1)
"""


@query(
    "upper_quartiles",
    "WITH " + W.BULK_SQL + FLAGS_SQL + QUARTILES_SQL
    + "SELECT sample, CAST(lib AS BIGINT) AS library_size, round(q, 10) AS upper_quartile FROM quart",
)
def upper_quartiles(spark, folder):
    kept = _kept(spark, folder)
    found = B.upper_quartiles(kept, B.library_sizes(kept))
    return found.withColumn("upper_quartile", F.round("upper_quartile", 10))


FACTORS_SQL = QUARTILES_SQL + """,
pts AS (
  SELECT y.sample, log2((y.count / ly.lib) / (r.count / lr.lib)) AS m, (log2(y.count / ly.lib) + log2(r.count / lr.lib)) / 2 AS a,
    (ly.lib - y.count) / ly.lib / y.count + (lr.lib - r.count) / lr.lib / r.count AS v
  FROM kept_counts y JOIN kept_libs ly ON ly.sample = y.sample
  JOIN kept_counts r ON r.gene = y.gene AND r.sample = (SELECT sample FROM ref) JOIN kept_libs lr ON lr.sample = r.sample
  WHERE y.count > 0 AND r.count > 0),
ranked AS (
  SELECT *, count(*) OVER (PARTITION BY sample) AS n,
    rank() OVER (PARTITION BY sample ORDER BY m) + (count(*) OVER (PARTITION BY sample, m) - 1) / 2.0 AS rm,
    rank() OVER (PARTITION BY sample ORDER BY a) + (count(*) OVER (PARTITION BY sample, a) - 1) / 2.0 AS ra,
    max(abs(m)) OVER (PARTITION BY sample) AS widest FROM pts),
raw AS (
  SELECT sample, CASE WHEN max(widest) < 1e-6 THEN 0 ELSE
    sum(m / v) FILTER (WHERE rm BETWEEN floor(n * 0.3) + 1 AND n - floor(n * 0.3) AND ra BETWEEN floor(n * 0.05) + 1 AND n - floor(n * 0.05))
    / sum(1 / v) FILTER (WHERE rm BETWEEN floor(n * 0.3) + 1 AND n - floor(n * 0.3) AND ra BETWEEN floor(n * 0.05) + 1 AND n - floor(n * 0.05)) END AS f
  FROM ranked GROUP BY 1),
factors AS (SELECT sample, lib, pow(2.0, f - (SELECT avg(f) FROM raw)) AS factor, lib * pow(2.0, f - (SELECT avg(f) FROM raw)) AS eff
            FROM raw JOIN kept_libs USING (sample))
"""


def _factors(spark, folder):
    kept = _kept(spark, folder)
    return kept, B.tmm_factors(kept)


@query(
    "tmm_factors",
    "WITH " + W.BULK_SQL + FLAGS_SQL + FACTORS_SQL
    + "SELECT sample, CAST(lib AS BIGINT) AS library_size, round(factor, 8) AS norm_factor, round(eff, 2) AS effective_library_size FROM factors",
)
def tmm_factors(spark, folder):
    factors = _factors(spark, folder)[1]
    return factors.select(
        "sample", "library_size", F.round("norm_factor", 8).alias("norm_factor"), F.round("effective_library_size", 2).alias("effective_library_size")
    )


@query(
    "bulk_cpm",
    "WITH " + W.BULK_SQL + FLAGS_SQL + FACTORS_SQL
    + """
    SELECT gene, round(coalesce(sum(count / eff * 1e6) FILTER (condition = 'A'), 0) / 3, 6) AS condition_a_mean_CPM,
      round(coalesce(sum(count / eff * 1e6) FILTER (condition = 'B'), 0) / 3, 6) AS condition_b_mean_CPM
    FROM kept_counts JOIN factors USING (sample) JOIN design USING (sample) GROUP BY 1
    """,
)
def bulk_cpm(spark, folder):
    kept, factors = _factors(spark, folder)
    means = B.mean_cpm(B.cpm(kept, factors), W.bulk_samples(spark, folder), W.CONTRAST)
    return means.select("gene", *[F.round(c, 6).alias(c) for c in means.columns[1:]])


@query(
    "ql_statistics",
    "WITH " + W.BULK_SQL + FLAGS_SQL + """,
    eff AS (SELECT sample, lib AS e, condition FROM kept_libs JOIN design USING (sample)),
    g AS (SELECT sum(e) FILTER (condition = 'A') AS ea, sum(e) FILTER (condition = 'B') AS eb FROM eff),
    s AS (SELECT gene, coalesce(sum(count) FILTER (condition = 'A'), 0)::DOUBLE AS a, coalesce(sum(count) FILTER (condition = 'B'), 0)::DOUBLE AS b,
            sum(count * ln(count / e)) AS own FROM kept_counts JOIN eff USING (sample) GROUP BY 1),
    d AS (SELECT gene, a, b, ea, eb, greatest(0, 2 * (own - CASE WHEN a > 0 THEN a * ln(a / ea) ELSE 0 END - CASE WHEN b > 0 THEN b * ln(b / eb) ELSE 0 END)) AS full_d,
            greatest(0, 2 * (own - (a + b) * ln((a + b) / (ea + eb)))) AS null_d FROM s, g)
    SELECT gene, round(log2(((a + 0.125) / ea) / ((b + 0.125) / eb)), 6) AS "logFC", round(log2((a + b + 0.25) / (ea + eb) * 1e6), 6) AS "logCPM",
      round(full_d, 4) AS deviance_full, round(null_d, 4) AS deviance_null, 4 AS df_residual,
      round((null_d - full_d) / (full_d / 4), 4) AS "F"
    FROM d
    """,
)
def ql_statistics(spark, folder):
    kept = _kept(spark, folder)
    sizes = B.library_sizes(kept).withColumn("effective_library_size", F.col("library_size").cast("double"))
    stats = B.ql_statistics(kept, W.bulk_samples(spark, folder), sizes, W.CONTRAST)
    digits = {"logFC": 6, "logCPM": 6, "deviance_full": 4, "deviance_null": 4, "F": 4}
    return stats.select("gene", "df_residual", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query(
    "ql_p_values",
    "WITH " + W.BULK_SQL + FLAGS_SQL + """,
    eff AS (SELECT sample, lib AS e, condition FROM kept_libs JOIN design USING (sample)),
    g AS (SELECT sum(e) FILTER (condition = 'A') AS ea, sum(e) FILTER (condition = 'B') AS eb FROM eff),
    s AS (SELECT gene, coalesce(sum(count) FILTER (condition = 'A'), 0)::DOUBLE AS a, coalesce(sum(count) FILTER (condition = 'B'), 0)::DOUBLE AS b,
            sum(count * ln(count / e)) AS own FROM kept_counts JOIN eff USING (sample) GROUP BY 1),
    d AS (SELECT gene, a, b, ea, eb, greatest(0, 2 * (own - CASE WHEN a > 0 THEN a * ln(a / ea) ELSE 0 END - CASE WHEN b > 0 THEN b * ln(b / eb) ELSE 0 END)) AS full_d,
            greatest(0, 2 * (own - (a + b) * ln((a + b) / (ea + eb)))) AS null_d FROM s, g),
    f AS (SELECT gene, CASE WHEN full_d > 0 THEN (null_d - full_d) / (full_d / 4) END AS f FROM d),
    t AS (SELECT gene, f / (1 + f / 4) AS u FROM f),
    p AS (SELECT gene, coalesce(1 - 0.75 * sqrt(u) * (1 - u / 12), 1) AS p FROM t),
    r AS (SELECT *, row_number() OVER (ORDER BY p, gene) AS rk, count(*) OVER () AS n FROM p)
    SELECT gene, round(p, 7) AS "PValue", round(least(1.0, min(p * n / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 7) AS "FDR" FROM r
    """,
)
def ql_p_values(spark, folder):
    """With two groups of three libraries the F distribution has 1 and 4 degrees of freedom, whose tail SQL can write out."""
    kept = _kept(spark, folder)
    sizes = B.library_sizes(kept).withColumn("effective_library_size", F.col("library_size").cast("double"))
    tested = B.ql_test(kept, W.bulk_samples(spark, folder), sizes, W.CONTRAST)
    return tested.select("gene", F.round("PValue", 7).alias("PValue"), F.round("FDR", 7).alias("FDR"))


@query("ql_test")
def ql_test(spark, folder):
    kept, factors = _factors(spark, folder)
    return B.ql_test(kept, W.bulk_samples(spark, folder), factors, W.CONTRAST)


@query(
    "deg",
    "WITH p AS (SELECT 1)" + W.DE_SQL + "SELECT ordinal, logfc AS \"logFC\", fdr AS \"FDR\" FROM de WHERE fdr < 0.05 AND abs(logfc) >= 1",
)
def deg(spark, folder):
    return B.deg(W.de_table(spark, folder)).select("ordinal", "logFC", "FDR")
