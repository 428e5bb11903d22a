"""Reads, tags, subsets and text formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlattice.functions import reads as R
from seqlattice.operators import counts as C
from seqlattice.operators import reads as O
from seqlattice.sources import text as T
from workload.tables import ANCHOR, UMI_LENGTH, read_pairs, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


@query(
    "umi_split",
    """
    SELECT doc_id AS ordinal, 'doc' || doc_id || '|CB:' || source || '|UB:' || umi AS name, umi,
      CASE WHEN umi <> '' THEN 'umi' ELSE 'non_umi' END AS umi_class,
      CASE WHEN p > 0 THEN substr(text, p + 12) ELSE text END AS seq1
    FROM (SELECT *, CASE WHEN p > 0 THEN substr(text, p + 4, 8) ELSE '' END AS umi
          FROM (SELECT *, instr(text, 'the ') AS p FROM documents))
    """,
)
def umi_split(spark, folder):
    split = O.annotate_names(O.split_umi(read_pairs(spark, folder), ANCHOR, UMI_LENGTH))
    return split.select("ordinal", "name", "umi", "umi_class", "seq1")


@query(
    "umi_stats",
    """
    SELECT source AS sample, count(*) AS total_reads, count(*) FILTER (p > 0) AS tso_reads,
      count(*) FILTER (umi <> '') AS umi_reads, count(*) FILTER (umi = '') AS non_umi_reads,
      round(count(*) FILTER (umi <> '') / count(*)::DOUBLE, 6) AS umi_fraction,
      count(*) FILTER (p > 0 AND length(text) >= p - 1 + 12) AS complete_reads
    FROM (SELECT *, CASE WHEN p > 0 THEN substr(text, p + 4, 8) ELSE '' END AS umi
          FROM (SELECT *, instr(text, 'the ') AS p FROM documents))
    GROUP BY 1
    """,
)
def umi_stats(spark, folder):
    pairs = read_pairs(spark, folder)
    stats = O.umi_stats(O.split_umi(pairs, ANCHOR, UMI_LENGTH), ["sample"])
    complete = pairs.groupBy("sample").agg(
        F.count_if(R.has_complete_umi("seq1", ANCHOR, UMI_LENGTH)).alias("complete_reads")
    )
    return stats.withColumn("umi_fraction", F.round("umi_fraction", 6)).join(complete, "sample")


@query(
    "read_id_normalize",
    """
    SELECT page_id, regexp_replace(regexp_extract(url || '/' || (1 + page_id % 2) || ' 1:N:0', '^\\S+'), '/[12]$', '') AS read_id
    FROM pages
    """,
)
def read_id_normalize(spark, folder):
    name = F.concat("url", F.lit("/"), 1 + F.col("page_id") % 2, F.lit(" 1:N:0"))
    return table(spark, folder, "pages").select("page_id", R.normalize_id(name).alias("read_id"))


def _event_names(spark, folder):
    key = F.get_json_object("props", "$.k")
    umi = F.when(F.col("event_type") != "error", F.concat(F.lit("|UB:"), key)).otherwise("")
    return table(spark, folder, "events").select(
        "event_id", F.concat(F.lit("e"), "event_id", F.lit("|CB:u"), "user_id", umi).alias("name")
    )


@query(
    "tag_extract",
    """
    SELECT event_id, 'u' || user_id AS "CB",
      CASE WHEN event_type <> 'error' THEN regexp_extract(props, '([0-9]+)', 1) ELSE '' END AS "UB"
    FROM events
    """,
)
def tag_extract(spark, folder):
    return _event_names(spark, folder).select(
        "event_id", R.extract_tag("name", "CB").alias("CB"), R.extract_tag("name", "UB").alias("UB")
    )


@query(
    "tag_completeness",
    """
    SELECT user_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS tagged FROM events GROUP BY 1
    """,
)
def tag_completeness(spark, folder):
    names = _event_names(spark, folder).select(
        R.extract_tag("name", "CB").alias("CB"), R.extract_tag("name", "UB").alias("UB")
    )
    users = names.withColumn("user_id", F.substring("CB", 2, 20).cast("bigint"))
    return O.tag_completeness(users, ["user_id"])


def _sam_lines(spark, folder):
    """Parts written out as SAM text lines."""
    seq = F.upper(F.translate(F.concat("p_name", "p_type", "p_brand"), " #", "NN"))
    flag = (F.col("p_size") % 4) * 16 + F.when(F.col("p_size") > 45, 256).otherwise(0)
    fields = [
        F.concat(F.col("p_name"), F.lit("~"), F.col("p_partkey")), flag, F.lit("chr1"), F.col("p_partkey") + 1, F.lit(255),
        F.concat(F.length(seq), F.lit("M")), F.lit("*"), F.lit(0), F.lit(0), seq, F.reverse(seq),
        F.concat(F.lit("CB:Z:"), F.translate("p_brand", "#", "*")), F.concat(F.lit("NH:i:"), "p_size"),
        F.concat(F.lit("UB:Z:"), "p_type"),
    ]
    # Parts are dealt first: their file may be one piece for the scan, and a line is far longer than its part.
    return table(spark, folder, "part").repartition("p_partkey").select(
        F.lit("part").alias("file"), F.col("p_partkey").alias("line_no"), F.concat_ws("\t", *fields).alias("value")
    )


@query(
    "sam_primary",
    """
    SELECT p_partkey AS ordinal,
      'Q=' || url_encode(p_name || '~' || p_partkey) || '|CB=' || url_encode(translate(p_brand, '#', '*'))
        || '|UB=' || url_encode(p_type) || '|CR=|UR=' AS star_read_name,
      p_name || '~' || p_partkey AS original_qname, translate(p_brand, '#', '*') AS "CB", p_type AS "UB", '' AS "CR", '' AS "UR",
      substr(CASE WHEN p_size % 2 = 1
        THEN reverse(translate(s, 'ACGTRYMKBDHV', 'TGCAYRKMVHDB')) ELSE s END, 1, 16) AS seq,
      substr(CASE WHEN p_size % 2 = 1 THEN s ELSE reverse(s) END, 1, 16) AS qual
    FROM (SELECT *, upper(translate(p_name || p_type || p_brand, ' #', 'NN')) AS s FROM part) WHERE p_size <= 45
    """,
)
def sam_primary(spark, folder):
    return O.primary_transcripts(T.parse_sam(_sam_lines(spark, folder)), length=16)


@query(
    "mate_pairing",
    """
    WITH u AS (SELECT conv_id, turn // 2 AS ordinal, 'c' || conv_id || '.' || (turn // 2) AS id, text
               FROM conversations WHERE role = 'user'),
         a AS (SELECT conv_id, turn // 2 AS ordinal,
                 'c' || conv_id || '.' || (turn // 2) || CASE WHEN length(text) > 200 THEN '' ELSE 'x' END AS id, text
               FROM conversations WHERE role = 'assistant')
    SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, coalesce(u.ordinal, a.ordinal) AS ordinal,
      u.text AS seq1, a.text AS seq2,
      CASE WHEN u.id IS NULL THEN 'missing_r1' WHEN a.id IS NULL THEN 'missing_r2'
           WHEN u.id <> a.id THEN 'id_mismatch' ELSE 'paired' END AS mate_status
    FROM u FULL OUTER JOIN a ON u.conv_id = a.conv_id AND u.ordinal = a.ordinal
    """,
)
def mate_pairing(spark, folder):
    turns = table(spark, folder, "conversations").withColumn("ordinal", F.floor(F.col("turn") / 2))
    name = F.concat(F.lit("c"), "conv_id", F.lit("."), "ordinal")

    def mate(role, suffix, tail):
        return turns.filter(F.col("role") == role).select(
            "conv_id", "ordinal", F.concat(name, tail, F.lit(suffix)).alias("read_id"), F.col("text").alias("seq"), F.col("text").alias("qual")
        )

    long = F.when(F.length("text") > 200, "").otherwise("x")
    pairs = O.pair_mates(mate("user", "/1", F.lit("")), mate("assistant", "/2", long), sample="conv_id", check=False)
    return pairs.select("conv_id", "ordinal", "seq1", "seq2", "mate_status")


@query(
    "bottom_k_hash",
    """
    SELECT doc_id AS ordinal, row_number() OVER (ORDER BY doc_id) AS output_index,
      'sub_read_' || lpad(CAST(row_number() OVER (ORDER BY doc_id) AS VARCHAR), 6, '0') || '/1' AS name
    FROM (SELECT doc_id FROM documents ORDER BY sha256('7:doc' || doc_id), doc_id LIMIT 100)
    """,
)
def bottom_k_hash(spark, folder):
    chosen = O.bottom_k(read_pairs(spark, folder), "read_id", 100, 7, method="sha256")
    return chosen.select("ordinal", "output_index", R.output_name("sub", "output_index", 1).alias("name"))


@query("bottom_k_blake2b")
def bottom_k_blake2b(spark, folder):
    chosen = O.bottom_k(read_pairs(spark, folder), "read_id", 100, 7)
    return chosen.select("ordinal", "output_index")


@query(
    "subset_summary",
    """
    WITH d AS (SELECT *, instr(text, 'the ') AS p FROM documents),
         s AS (SELECT * FROM d ORDER BY sha256('7:doc' || doc_id), doc_id LIMIT 100)
    SELECT 'sample' AS metric, 'sub' AS value UNION ALL SELECT 'selection_method', 'smallest_sha256_read_id_hashes'
    UNION ALL SELECT 'selection_seed', '7' UNION ALL SELECT 'tso_sequence', 'the ' UNION ALL SELECT 'umi_length', '8'
    UNION ALL SELECT 'source_total_read_pairs', CAST(count(*) AS VARCHAR) FROM d
    UNION ALL SELECT 'source_total_complete_tso_umi_pairs', CAST(count(*) AS VARCHAR) FROM d WHERE p > 0 AND length(text) >= p + 11
    UNION ALL SELECT 'selected_read_pairs', CAST(count(*) AS VARCHAR) FROM s
    UNION ALL SELECT 'selected_complete_tso_umi_pairs', CAST(count(*) AS VARCHAR) FROM s WHERE p > 0 AND length(text) >= p + 11
    """,
)
def subset_summary(spark, folder):
    pairs = read_pairs(spark, folder)
    chosen = O.bottom_k(pairs, "read_id", 100, 7, method="sha256")
    return O.subset_summary(pairs, chosen, "sub", 7, ANCHOR, UMI_LENGTH, method="sha256")


@query(
    "gtf_annotation",
    """
    WITH f AS (
      SELECT p_brand AS gene_id, p_partkey AS ordinal, CASE WHEN p_size <= 25 THEN 'gene' ELSE 'exon' END AS feature,
        CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand END AS gene_name,
        CASE WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 3 = 1 THEN lower(p_type) ELSE 'NA' END AS gene_type
      FROM part)
    SELECT gene_id, gene_name, gene_type FROM (
      SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY (feature = 'gene')::INT DESC,
        CASE WHEN feature = 'gene' THEN -ordinal ELSE ordinal END) AS rn FROM f) WHERE rn = 1
    """,
)
def gtf_annotation(spark, folder):
    size = F.col("p_size")
    attributes = F.concat(
        F.lit('gene_id "'), "p_brand", F.lit('"; tag "basic"; tag "x"; '),
        F.when(size % 2 == 0, F.concat(F.lit('gene_name "'), "p_name", F.lit('"; '))).otherwise(""),
        F.when(size % 3 == 0, F.concat(F.lit('gene_biotype "'), "p_type", F.lit('"; gene_type "none";')))
        .when(size % 3 == 1, F.concat(F.lit('gene_type "'), F.lower("p_type"), F.lit('";')))
        .otherwise(""),
    )
    fields = [F.lit("chr1"), F.lit("x"), F.when(size <= 25, "gene").otherwise("exon"), F.col("p_partkey") + 1,
              F.col("p_partkey") + size, F.lit("."), F.lit("+"), F.lit("."), attributes]
    lines = table(spark, folder, "part").select(
        F.lit("part").alias("file"), F.col("p_partkey").alias("line_no"), F.concat_ws("\t", *fields).alias("value")
    )
    return T.gene_annotation(T.parse_gtf(lines))


def _tagged_events(spark, folder):
    return table(spark, folder, "events").select(
        F.col("user_id").alias("CB"), F.col("event_type").alias("gene_id"), F.lpad(F.get_json_object("props", "$.k"), 2, "0").alias("UB")
    )


@query(
    "umi_unique",
    """
    SELECT event_type AS gene, user_id AS cell, count(DISTINCT lpad(regexp_extract(props, '([0-9]+)', 1), 2, '0')) AS count
    FROM events GROUP BY 1, 2
    """,
)
def umi_unique(spark, folder):
    return C.dedup_umis(_tagged_events(spark, folder))


@query(
    "umi_directional",
    """
    WITH RECURSIVE u AS (
      SELECT event_type AS gene, user_id AS cell, lpad(regexp_extract(props, '([0-9]+)', 1), 2, '0') AS umi, count(*) AS n
      FROM events GROUP BY 1, 2, 3),
    near AS (
      SELECT a.gene, a.cell, a.umi AS big, a.n AS n_big, b.umi AS small, b.n AS n_small
      FROM u a JOIN u b ON a.gene = b.gene AND a.cell = b.cell AND a.umi <> b.umi
      WHERE hamming(a.umi, b.umi) = 1 AND a.n >= 2 * b.n - 1),
    singles AS (SELECT gene, cell, umi FROM u WHERE n = 1),
    reach AS (
      SELECT gene, cell, umi AS node, umi AS other FROM singles
      UNION
      SELECT r.gene, r.cell, r.node, e.small FROM reach r
      JOIN near e ON e.gene = r.gene AND e.cell = r.cell AND e.big = r.other AND e.n_big = 1 AND e.n_small = 1),
    sets AS (SELECT gene, cell, node, min(other) AS root FROM reach GROUP BY 1, 2, 3),
    touched AS (SELECT DISTINCT s.gene, s.cell, s.root FROM sets s
      JOIN near e ON e.gene = s.gene AND e.cell = s.cell AND e.small = s.node AND e.n_big > 1),
    starts AS (
      SELECT gene, cell, umi FROM u WHERE n > 1 AND NOT EXISTS (
        SELECT 1 FROM near e WHERE e.gene = u.gene AND e.cell = u.cell AND e.small = u.umi)
      UNION ALL
      SELECT DISTINCT gene, cell, root FROM sets s WHERE NOT EXISTS (
        SELECT 1 FROM touched t WHERE t.gene = s.gene AND t.cell = s.cell AND t.root = s.root))
    SELECT gene, cell, count(*) AS count FROM starts GROUP BY 1, 2
    """,
)
def umi_directional(spark, folder):
    return C.dedup_umis(_tagged_events(spark, folder), method="directional")
