"""Single-cell statistics, signatures, concordance and embedding."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from seqlattice.operators import embedding as E
from seqlattice.operators import markers as M
from seqlattice.operators import signature as S
from seqlattice.session import materialize
from workload import tables as W

QUERIES, ORACLES = {}, {}
TOP, CTRL, NBIN, SEED = 20, 10, 24, 123


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def _rounded(df, digits: dict[str, int]):
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


def _parts(spark, folder):
    return M.keep_cells(W.part_dataset(spark, folder), "analysis_keep")


def _symbols(spark, folder):
    data = W.part_dataset(spark, folder)
    named = replace(data, features=W.symbol_features(spark, folder)).collapse("gene_name")
    return M.keep_cells(named, "analysis_keep")


BULK_SC_SQL = """,
lib AS (SELECT condition, CAST(sum(count) AS BIGINT) AS size FROM raw_counts JOIN cells USING (cell) GROUP BY 1),
num AS (SELECT condition, count(*) AS n FROM cells GROUP BY 1),
pseudo AS (
  SELECT gene, CAST(coalesce(sum(count) FILTER (condition = 'A'), 0) AS BIGINT) AS ca, CAST(coalesce(sum(count) FILTER (condition = 'B'), 0) AS BIGINT) AS cb,
    count(*) FILTER (condition = 'A' AND count > 0) AS da, count(*) FILTER (condition = 'B' AND count > 0) AS db
  FROM features LEFT JOIN raw_counts USING (gene) LEFT JOIN cells USING (cell) GROUP BY 1),
sc AS (
  SELECT gene, ca, cb, ca / (SELECT size FROM lib WHERE condition = 'A')::DOUBLE * 1e6 AS cpm_a, cb / (SELECT size FROM lib WHERE condition = 'B')::DOUBLE * 1e6 AS cpm_b,
    da / (SELECT n FROM num WHERE condition = 'A')::DOUBLE AS rate_a, db / (SELECT n FROM num WHERE condition = 'B')::DOUBLE AS rate_b FROM pseudo)
"""


@query(
    "pseudobulk",
    "WITH " + W.COUNTS_SQL + BULK_SC_SQL
    + """
    SELECT gene, ca AS condition_a_counts, cb AS condition_b_counts, round(cpm_a, 6) AS "condition_a_CPM", round(cpm_b, 6) AS "condition_b_CPM",
      round(rate_a, 6) AS condition_a_detection_rate, round(rate_b, 6) AS condition_b_detection_rate,
      round(log2(cpm_a + 1) - log2(cpm_b + 1), 6) AS "descriptive_sc_log2FC", 'A_vs_B' AS sc_comparison FROM sc
    """,
)
def pseudobulk(spark, folder):
    table, _ = M.pseudobulk(_parts(spark, folder), W.CONTRAST)
    return _rounded(table, {c: 6 for c in table.columns if c.endswith(("CPM", "rate", "FC"))})


@query(
    "group_summary",
    "WITH " + W.COUNTS_SQL + BULK_SC_SQL
    + "SELECT condition, n AS retained_cells, size AS pseudobulk_library_size FROM num JOIN lib USING (condition) WHERE condition <> 'C'",
)
def group_summary(spark, folder):
    return M.pseudobulk(_parts(spark, folder), W.CONTRAST)[1]


@query(
    "log_normalize",
    "WITH " + W.COUNTS_SQL + W.NORMAL_SQL + "SELECT gene, cell, round(value, 6) AS value FROM normal",
)
def log_normalize(spark, folder):
    return M.log_normalize(_parts(spark, folder).counts).select("gene", "cell", F.round("value", 6).alias("value"))


RANKS_SQL = """,
ab AS (SELECT gene, round(value, 12) AS value, scaled, condition FROM normal JOIN cells USING (cell) WHERE condition IN ('A', 'B')),
size AS (SELECT count(*) FILTER (condition = 'A')::DOUBLE AS na, count(*) FILTER (condition = 'B')::DOUBLE AS nb FROM cells),
ranked AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0 AS r FROM ab),
ties AS (SELECT gene, sum(t * t * t - t) AS ties FROM (SELECT gene, value, count(*)::DOUBLE AS t FROM ab GROUP BY 1, 2) GROUP BY 1),
per AS (
  SELECT f.gene, count(r) FILTER (condition = 'A') AS za, count(r) FILTER (condition = 'B') AS zb, coalesce(sum(r) FILTER (condition = 'A'), 0) AS within,
    coalesce(sum(scaled) FILTER (condition = 'A'), 0) AS sa, coalesce(sum(scaled) FILTER (condition = 'B'), 0) AS sb
  FROM features f LEFT JOIN ranked USING (gene) GROUP BY 1),
full_ranks AS (
  SELECT gene, za, zb, sa, sb, na, nb, na + nb AS n, na + nb - za - zb AS z0, coalesce(ties, 0) AS ties,
    (na - za) * (na + nb - za - zb + 1) / 2 + within + za * (na + nb - za - zb) AS rank_sum_a
  FROM per LEFT JOIN ties USING (gene), size),
tested AS (
  SELECT *, rank_sum_a - na * (na + 1) / 2 AS u, ties + z0 * z0 * z0 - z0 AS tie_term,
    na * nb / 12 * (n + 1 - (ties + z0 * z0 * z0 - z0) / (n * (n - 1))) AS variance FROM full_ranks),
markers AS (
  SELECT *, CASE WHEN variance > 1e-9 THEN (u - na * nb / 2 - sign(u - na * nb / 2) * 0.5) / sqrt(variance) END AS z,
    log2((sa + 1) / na) - log2((sb + 1) / nb) AS log2fc FROM tested)
"""


@query(
    "wilcoxon_statistics",
    "WITH " + W.COUNTS_SQL + W.NORMAL_SQL + RANKS_SQL
    + """
    SELECT gene, round(u, 4) AS u, round(z, 6) AS z, round(za / na, 6) AS pct_1, round(zb / nb, 6) AS pct_2, round(log2fc, 6) AS "avg_log2FC" FROM markers
    """,
)
def wilcoxon_statistics(spark, folder):
    data = _parts(spark, folder)
    stats = M.rank_sums(M.log_normalize(data.counts), data.cells, data.features, W.CONTRAST)
    return _rounded(stats.select("gene", "u", "z", "pct_1", "pct_2", "avg_log2FC"), {"u": 4, "z": 6, "pct_1": 6, "pct_2": 6, "avg_log2FC": 6})


@query("wilcoxon_markers")
def wilcoxon_markers(spark, folder):
    return M.find_markers(_parts(spark, folder), W.CONTRAST)


@query(
    "best_per_symbol",
    "WITH p AS (SELECT 1)" + W.DE_SQL + "SELECT gene_name, gene_id, logfc AS \"logFC\", fdr AS \"FDR\" FROM best",
)
def best_per_symbol(spark, folder):
    return S.best_per_symbol(W.de_table(spark, folder)).select("gene_name", "gene_id", "logFC", "FDR")


MATCHED_SQL = """,
matched AS (
  SELECT b.gene_name AS gene, b.logfc AS bulk, b.fdr, sc.*EXCLUDE (gene), log2fc, ca + cb AS total, (fdr < 0.05 AND abs(logfc) >= 1) AS is_deg
  FROM best b JOIN sc ON sc.gene = b.gene_name JOIN markers m ON m.gene = b.gene_name),
selected AS (
  SELECT * FROM (
    SELECT *, CASE WHEN bulk > 0 THEN 'condition_a_high' ELSE 'condition_b_high' END AS signature,
      row_number() OVER (PARTITION BY bulk > 0 ORDER BY fdr, abs(bulk) DESC, gene) AS rk
    FROM matched WHERE total >= 50 AND is_deg AND bulk <> 0 AND NOT regexp_matches(gene, '^red |^RP')) WHERE rk <= 20)
"""
CHAIN_SQL = "WITH " + W.SYMBOL_SQL + W.NORMAL_SQL + RANKS_SQL + BULK_SC_SQL + W.DE_SQL + MATCHED_SQL


def _matched(spark, folder):
    data = _symbols(spark, folder)
    data = type(data)(materialize(data.counts), materialize(data.features), data.cells)
    normalized = M.log_normalize(data.counts)
    table, _ = M.pseudobulk(data, W.CONTRAST)
    stats = M.rank_sums(normalized, data.cells, data.features, W.CONTRAST)
    markers = stats.select("gene", F.col("avg_log2FC").alias("sc_log2FC"), "pct_1", "pct_2")
    best = S.best_per_symbol(W.de_table(spark, folder))
    matched = S.match_genes(best, table, markers, W.CONTRAST)
    return data, normalized, best, materialize(matched)


def _selected(matched):
    return S.select_signature(matched, W.CONTRAST, TOP, min_total=50, require_deg=True, exclude="^red |^RP", require_full=False)


@query(
    "matched_genes",
    CHAIN_SQL
    + 'SELECT gene, bulk AS "bulk_log2FC", fdr AS "FDR", round(log2fc, 6) AS "sc_log2FC", total AS sc_total_counts, is_deg::INT AS "bulk_DEG" FROM matched',
)
def matched_genes(spark, folder):
    matched = _matched(spark, folder)[3]
    return matched.select(
        "gene", "bulk_log2FC", "FDR", F.round("sc_log2FC", 6).alias("sc_log2FC"), "sc_total_counts", F.col("bulk_DEG").cast("int").alias("bulk_DEG")
    )


@query(
    "signature_topn",
    CHAIN_SQL
    + """SELECT gene, signature, rk AS rank_within_direction, bulk AS "bulk_log2FC", fdr AS "FDR",
      CASE signature WHEN 'condition_a_high' THEN 'A' ELSE 'B' END AS high_condition FROM selected""",
)
def signature_topn(spark, folder):
    chosen = _selected(_matched(spark, folder)[3])
    return chosen.select("gene", "signature", "rank_within_direction", "bulk_log2FC", "FDR", "high_condition")


SCOPES_SQL = """,
scoped AS (
  SELECT 'all_matched_expressed_genes' AS scope, bulk AS x, log2fc AS y FROM matched WHERE total >= 50
  UNION ALL SELECT 'all_bulk_deg_candidates', bulk, log2fc FROM matched WHERE total >= 50 AND is_deg
  UNION ALL SELECT 'selected_genes_combined', bulk, log2fc FROM selected
  UNION ALL SELECT 'selected_condition_a_high', bulk, log2fc FROM selected WHERE signature = 'condition_a_high'
  UNION ALL SELECT 'selected_condition_b_high', bulk, log2fc FROM selected WHERE signature = 'condition_b_high'),
sr AS (
  SELECT *, rank() OVER (PARTITION BY scope ORDER BY x) + (count(*) OVER (PARTITION BY scope, x) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY scope ORDER BY y) + (count(*) OVER (PARTITION BY scope, y) - 1) / 2.0 AS ry FROM scoped)
"""


@query(
    "concordance_metrics",
    CHAIN_SQL + SCOPES_SQL
    + """
    SELECT scope, count(*) AS n_genes, round(corr(x, y), 6) AS pearson_r, round(corr(rx, ry), 6) AS spearman_rho,
      round(avg((sign(x) = sign(y))::INT), 6) AS direction_concordance, round(regr_slope(y, x), 6) AS linear_slope,
      round(regr_intercept(y, x), 6) AS linear_intercept FROM sr GROUP BY 1
    """,
)
def concordance_metrics(spark, folder):
    matched = _matched(spark, folder)[3]
    metrics = S.concordance(S.concordance_scopes(matched, _selected(matched), min_total=50)).drop("pearson_p_value")
    return _rounded(metrics, {c: 6 for c in metrics.columns[2:]})


@query("concordance_p_values")
def concordance_p_values(spark, folder):
    matched = _matched(spark, folder)[3]
    return S.all_scopes(S.concordance(S.concordance_scopes(matched, _selected(matched), min_total=50)))


@query(
    "volcano_table",
    CHAIN_SQL
    + """
    SELECT b.gene_name AS gene, b.logfc AS "bulk_log2FC", b.fdr AS "FDR", s.signature AS selected_signature, coalesce(s.rk <= 8, FALSE)::INT AS labelled,
      CASE s.signature WHEN 'condition_b_high' THEN 'Selected B-high' WHEN 'condition_a_high' THEN 'Selected A-high'
        ELSE CASE WHEN b.fdr < 0.05 AND b.logfc <= -1 THEN 'Other B-high DEG' WHEN b.fdr < 0.05 AND b.logfc >= 1 THEN 'Other A-high DEG' ELSE 'Other genes' END END AS display_group,
      round(-log10(greatest(b.fdr, 2.2250738585072014e-308)), 6) AS "minus_log10_FDR"
    FROM best b LEFT JOIN selected s ON s.gene = b.gene_name
    """,
)
def volcano_table(spark, folder):
    _, _, best, matched = _matched(spark, folder)
    return _rounded(S.volcano_table(best, _selected(matched), W.CONTRAST), {"minus_log10_FDR": 6})


@query(
    "concordance_table",
    CHAIN_SQL
    + """
    SELECT m.gene, m.bulk AS "bulk_log2FC", round(m.log2fc, 6) AS "sc_log2FC", m.is_deg::INT AS "bulk_DEG", s.signature AS selected_signature,
      coalesce(s.rk <= 7, FALSE)::INT AS labelled,
      CASE s.signature WHEN 'condition_b_high' THEN 'Selected B-high' WHEN 'condition_a_high' THEN 'Selected A-high'
        ELSE CASE WHEN m.is_deg AND m.bulk < 0 THEN 'Other B-high DEG' WHEN m.is_deg AND m.bulk > 0 THEN 'Other A-high DEG' ELSE 'Other genes' END END AS display_group
    FROM matched m LEFT JOIN selected s ON s.gene = m.gene WHERE m.total >= 50
    """,
)
def concordance_table(spark, folder):
    matched = _matched(spark, folder)[3]
    table = S.concordance_table(matched, _selected(matched), W.CONTRAST, min_total=50)
    return _rounded(table, {"sc_log2FC": 6}).withColumn("bulk_DEG", F.col("bulk_DEG").cast("int"))


@query(
    "dot_table",
    CHAIN_SQL
    + """
    SELECT gene, signature, rk AS rank_within_direction, 'A' AS condition, round(rate_a, 6) AS detection_rate, round(log2(cpm_a + 1), 6) AS "log2_CPM_plus1"
    FROM selected WHERE rk <= 15
    UNION ALL SELECT gene, signature, rk, 'B', round(rate_b, 6), round(log2(cpm_b + 1), 6) FROM selected WHERE rk <= 15
    """,
)
def dot_table(spark, folder):
    table = S.dot_table(_selected(_matched(spark, folder)[3]), W.CONTRAST)
    return _rounded(table, {"detection_rate": 6, "log2_CPM_plus1": 6})


SCORE_SQL = """,
means AS (SELECT gene, round(coalesce(sum(value), 0) / (SELECT count(*) FROM cells)::DOUBLE, 12) AS mean
          FROM features LEFT JOIN normal USING (gene) GROUP BY 1),
bins AS (SELECT gene, ntile(24) OVER (ORDER BY mean, gene) AS bin FROM means),
dealt AS (SELECT gene, bin, row_number() OVER (PARTITION BY bin ORDER BY md5('123:' || gene), gene) AS seat, count(*) OVER (PARTITION BY bin) AS size FROM bins),
picks AS (
  SELECT s.signature, d.bin, (CAST('0x' || substr(md5('123:' || s.gene || ':start'), 1, 8) AS BIGINT) + step) % d.size + 1 AS seat
  FROM selected s JOIN dealt d ON d.gene = s.gene, range(10) t(step) WHERE step < d.size),
controls AS (SELECT DISTINCT signature, gene FROM picks JOIN dealt USING (bin, seat)),
weights AS (
  SELECT signature, gene, 1.0::DOUBLE / count(*) OVER (PARTITION BY signature) AS w FROM selected
  UNION ALL SELECT signature, gene, -1.0::DOUBLE / count(*) OVER (PARTITION BY signature) FROM controls),
scores AS (
  SELECT cell, condition, coalesce(sum(value * w) FILTER (signature = 'condition_a_high'), 0) AS a, coalesce(sum(value * w) FILTER (signature = 'condition_b_high'), 0) AS b
  FROM cells LEFT JOIN normal USING (cell) LEFT JOIN weights USING (gene) GROUP BY 1, 2)
"""


def _scores(spark, folder):
    data, normalized, _, matched = _matched(spark, folder)
    signatures = _selected(matched).select("signature", "gene")
    return S.module_score(normalized, data.cells, data.features, signatures, CTRL, NBIN, SEED)


@query(
    "module_score",
    CHAIN_SQL + SCORE_SQL
    + """SELECT cell, condition, round(a, 6) AS condition_a_high_module_score, round(b, 6) AS condition_b_high_module_score,
      round(a - b, 6) AS resistance_score FROM scores""",
)
def module_score(spark, folder):
    scores = _scores(spark, folder)
    return _rounded(scores, {c: 6 for c in scores.columns[2:]})


@query(
    "score_summary",
    """
    SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END AS level, c_mktsegment AS condition, count(*) AS n_samples,
      round(avg(o_totalprice), 4) AS mean_o_totalprice, round(quantile_cont(o_totalprice, 0.5), 4) AS median_o_totalprice,
      round(stddev_samp(o_totalprice), 4) AS sd_o_totalprice, round(quantile_cont(o_totalprice, 0.25), 4) AS q25_o_totalprice,
      round(quantile_cont(o_totalprice, 0.75), 4) AS q75_o_totalprice
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
    """,
)
def score_summary(spark, folder):
    from seqlattice.schemas import Contrast

    scores = W.table(spark, folder, "orders").join(W.table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    scores = scores.select(F.col("c_mktsegment").alias("condition"), "o_totalprice")
    table = S.score_summary(scores, Contrast("MACHINERY", "BUILDING"), "o_totalprice")
    return _rounded(table, {c: 4 for c in table.columns[3:]})


@query(
    "gene_moments",
    "WITH " + W.COUNTS_SQL
    + """, n AS (SELECT count(*)::DOUBLE AS n FROM cells)
    SELECT gene, count(count) AS nonzero, round(coalesce(sum(count), 0) / n, 6) AS mean,
      round((coalesce(sum(count * count), 0) - coalesce(sum(count), 0)::DOUBLE * coalesce(sum(count), 0) / n) / (n - 1), 6) AS variance
    FROM features LEFT JOIN raw_counts USING (gene), n GROUP BY gene, n
    """,
)
def gene_moments(spark, folder):
    data = _parts(spark, folder)
    return _rounded(E.gene_moments(data.counts, data.features, data.cells.count()), {"mean": 6, "variance": 6})


@query("variable_features")
def variable_features(spark, folder):
    return E.variable_features(_parts(spark, folder), 300)


@query(
    "scaled",
    "WITH " + W.COUNTS_SQL + W.NORMAL_SQL
    + """, n AS (SELECT count(*)::DOUBLE AS n FROM cells),
    st AS (SELECT gene, sum(value) / n AS mean, sqrt(greatest(0, (sum(value * value) - sum(value) * sum(value) / n) / (n - 1))) AS sd
           FROM normal, n GROUP BY gene, n)
    SELECT gene, cell, round(least(10, (value - mean) / CASE WHEN sd > 1e-12 THEN sd ELSE 1 END), 5) AS z,
      round(-mean / CASE WHEN sd > 1e-12 THEN sd ELSE 1 END, 5) AS z0 FROM normal JOIN st USING (gene)
    """,
)
def scaled(spark, folder):
    data = _parts(spark, folder)
    table = E.scale_genes(M.log_normalize(data.counts), data.features.select("gene"), data.cells.count())
    return _rounded(table, {"z": 5, "z0": 5})


@query("pca")
def pca(spark, folder):
    data = _parts(spark, folder)
    cells = data.cells.count()
    top = materialize(E.variable_features(data, 300, cells))
    scaled_rows = E.scale_genes(M.log_normalize(data.counts), top.select("gene", "rank"), cells)
    pcs = E.principal_components(scaled_rows, data.cells, top.count(), 10)
    return pcs.select("cell", F.posexplode("pcs").alias("component", "value"))


@query(
    "knn_cosine",
    """
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    p AS (SELECT a.vec_id AS id, b.vec_id AS neighbor, round(list_cosine_similarity(a.e, b.e), 10) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, neighbor) AS rank FROM p)
    SELECT id AS cell, neighbor, round(s, 6) AS similarity, rank FROM r WHERE rank <= 15
    """,
)
def knn_cosine(spark, folder):
    vectors = W.table(spark, folder, "embeddings").select(F.col("vec_id").alias("cell"), F.col("embedding").alias("vector"))
    return E.knn_cosine(vectors, 15, block_rows=50).withColumn("similarity", F.round("similarity", 6))
