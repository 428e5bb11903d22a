"""Contracts as tables: how many rows or keys of a driver table break each of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlattice import contracts as C
from seqlattice.functions.reads import parse_keep
from seqlattice.schemas import SAFE_ID
from workload.tables import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return keep


# Quantities as text with faults: below zero, a fraction, no number, missing.
_FAULTY = """
  SELECT *, CASE WHEN l_orderkey % 11 = 0 THEN '-' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) WHEN l_orderkey % 13 = 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.5'
    WHEN l_orderkey % 17 = 0 THEN 'many' WHEN l_orderkey % 19 = 0 THEN NULL ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS quantity FROM lineitem
"""


@query(
    "contract_values",
    f"""
    WITH t AS ({_FAULTY})
    SELECT 'count' AS contract, count(*) FILTER (quantity IS NULL OR NOT regexp_full_match(quantity, '[0-9]+')) AS violations FROM t
    UNION ALL SELECT 'tolerant count', count(*) FILTER (quantity IS NULL OR NOT regexp_full_match(quantity, '[0-9]+(\\.5)?')) FROM t
    UNION ALL SELECT 'id', count(*) FILTER (l_discount > 0.05) FROM t
    UNION ALL SELECT 'condition', count(*) FILTER (l_returnflag NOT IN ('A', 'R')) FROM t
    UNION ALL SELECT 'interval', count(*) FILTER (NOT coalesce(l_partkey >= 1 AND l_partkey + 100 >= l_suppkey * 10, FALSE)) FROM t
    """,
)
def contract_values(spark, folder):
    """Values that are no counts, ids, conditions or intervals, from one aggregate."""
    key, whole = F.col("l_orderkey"), F.col("l_quantity").cast("long").cast("string")
    quantity = F.when(key % 11 == 0, F.concat(F.lit("-"), whole)).when(key % 13 == 0, F.concat(whole, F.lit(".5"))).when(key % 17 == 0, "many")
    rows = table(spark, folder, "lineitem").withColumn("quantity", quantity.when(key % 19 == 0, F.lit(None)).otherwise(whole))
    checks = {
        "count": C.whole_count("quantity"),
        "tolerant count": C.whole_count("quantity", tolerance=0.5),
        "id": F.concat("l_returnflag", F.when(F.col("l_discount") > 0.05, " ").otherwise("_"), "l_linestatus").rlike(r"^[A-Za-z0-9._-]+$"),
        "condition": F.col("l_returnflag").isin("A", "R"),
        "interval": (F.col("l_partkey") >= 1) & (F.col("l_partkey") + 100 >= F.col("l_suppkey") * 10),
    }
    return C.violations(rows, checks)


@query(
    "contract_keys",
    """
    SELECT 'repeated' AS contract, count(*) AS violations FROM (SELECT 1 FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1)
    UNION ALL SELECT 'missing', count(*) FROM (SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))
    UNION ALL SELECT 'total', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_suppkey HAVING NOT sum(l_quantity - 25) > 0)
    """,
)
def contract_keys(spark, folder):
    """Repeated keys, keys without their reference, and groups whose total is not positive."""
    lines = table(spark, folder, "lineitem")
    repeated = C.repeated_keys(lines, ["l_partkey", "l_suppkey"])
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("k"))
    missing = C.missing_keys(customers, table(spark, folder, "orders").select(F.col("o_custkey").alias("k")), ["k"])
    totals = lines.groupBy("l_suppkey").agg(F.sum(F.col("l_quantity") - 25).alias("total")).filter(~(F.col("total") > 0))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("contract"), "violations")
    return count(repeated, "repeated").unionByName(count(missing, "missing")).unionByName(count(totals, "total"))


# Lines as rows of all kinds of tables, with a fault here and there.
_PLANTED = """
  SELECT *, l_returnflag || CASE WHEN l_discount > 0.05 THEN ' ' ELSE '_' END || l_linestatus AS sample,
    CASE WHEN l_partkey % 29 = 0 THEN '  ' WHEN l_partkey % 31 = 0 THEN NULL ELSE 'g' || CAST(l_partkey AS VARCHAR) END AS gene,
    CASE WHEN l_suppkey % 37 = 0 THEN NULL ELSE CAST(l_extendedprice AS DOUBLE) END AS effect, CAST(l_tax AS DOUBLE) * 20 AS p, CAST(l_discount AS DOUBLE) * 11 AS fdr,
    CASE l_linenumber WHEN 1 THEN 'Yes' WHEN 2 THEN ' f ' WHEN 3 THEN 'maybe' WHEN 4 THEN NULL ELSE '1' END AS keep FROM lineitem
"""


@query(
    "contract_rows",
    f"""
    WITH t AS ({_PLANTED})
    SELECT 'id' AS contract, count(*) FILTER (l_discount > 0.05) AS violations FROM t
    UNION ALL SELECT 'owner', count(*) FILTER (l_orderkey % 23 = 0) FROM t
    UNION ALL SELECT 'gene', count(*) FILTER (gene IS NULL OR trim(gene) = '') FROM t
    UNION ALL SELECT 'expression row', count(*) FILTER (NOT coalesce(gene IS NOT NULL AND effect IS NOT NULL AND p <= 1 AND fdr <= 1, FALSE)) FROM t
    UNION ALL SELECT 'bases and qualities', count(*) FILTER (NOT (l_linenumber <> 6 AND CAST(l_quantity AS BIGINT) >= 5)) FROM t
    UNION ALL SELECT 'logical', count(*) FILTER (keep = 'maybe') FROM t
    """,
)
def contract_rows(spark, folder):
    """Unsafe ids, cells of other samples, missing genes, invalid expression rows, uneven reads and unknown logical values, counted by the one job that goes over the lines."""
    part, line, size = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_quantity").cast("int")
    sample = F.concat("l_returnflag", F.when(F.col("l_discount") > 0.05, " ").otherwise("_"), "l_linestatus")
    rows = table(spark, folder, "lineitem").select(
        sample.alias("sample"),
        F.when(F.col("l_orderkey") % 23 == 0, F.concat(sample, F.lit("x"))).otherwise(sample).alias("cell"),
        F.when(part % 29 == 0, "  ").when(part % 31 == 0, F.lit(None)).otherwise(F.concat(F.lit("g"), part)).alias("gene"),
        F.lit("name").alias("gene_name"),
        F.when(F.col("l_suppkey") % 37 == 0, float("nan")).otherwise(F.col("l_extendedprice").cast("double")).alias("logFC"),
        (F.col("l_tax").cast("double") * 20).alias("PValue"),
        (F.col("l_discount").cast("double") * 11).alias("FDR"),
        F.repeat(F.lit("A"), size).alias("seq"),
        F.repeat(F.lit("I"), size - (line == 6).cast("int")).alias("qual"),
        F.when(line == 1, "Yes").when(line == 2, " f ").when(line == 3, "maybe").when(line == 4, F.lit(None)).otherwise("1").alias("keep"),
    )
    checks = {
        "id": C.id_rule("sample", SAFE_ID),
        "owner": F.col("cell") == F.col("sample"),
        "gene": C.filled("gene"),
        "expression row": C.de_rule(gene_id="gene"),
        "bases and qualities": C.read_rule(length=5),
        "logical": F.col("keep").isNull() | parse_keep("keep").isNotNull(),
    }
    watched, seen = C.watch(rows, checks)
    watched.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(list(seen.violations().items()), "contract string, violations long")


@query(
    "contract_groups",
    """
    SELECT 'condition ' || label AS contract, n AS violations
    FROM (SELECT v.label, (SELECT count(*) FROM lineitem WHERE l_returnflag = v.label) AS n FROM (VALUES ('A'), ('R'), ('X')) AS v(label))
    UNION ALL SELECT 'other condition', count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'R', 'X')
    UNION ALL SELECT 'total', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_suppkey HAVING NOT sum(l_quantity - 25) > 0)
    UNION ALL SELECT 'lines', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(*) % 4 <> 0)
    UNION ALL SELECT 'direction ' || side, greatest(4000 - least(4000, (SELECT count(*) FROM customer WHERE CASE side WHEN 'up' THEN c_acctbal > 0 ELSE c_acctbal < 0 END)), 0)
    FROM (VALUES ('up'), ('down')) AS v(side)
    """,
)
def contract_groups(spark, folder):
    """Rows of each condition, keys without a positive total, records cut short, and genes missing in each direction."""
    lines = table(spark, folder, "lineitem")
    labels = C.label_counts(lines, "l_returnflag", ["A", "R", "X"])
    labels = labels.select(F.coalesce(F.concat(F.lit("condition "), "label"), F.lit("other condition")).alias("contract"), F.col("n").alias("violations"))
    totals = C.nonpositive_totals(lines.withColumn("value", F.col("l_quantity") - 25), "l_suppkey", "value")
    short = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines")).filter(~C.lines_rule())
    sides = table(spark, folder, "customer").withColumn("side", F.when(F.col("c_acctbal") > 0, "up").when(F.col("c_acctbal") < 0, "down"))
    asked = C.label_counts(sides.filter("side IS NOT NULL"), "side", ["up", "down"])
    missing = asked.select(F.concat(F.lit("direction "), "label").alias("contract"), (4000 - F.least("n", F.lit(4000))).alias("violations"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("contract"), "violations")
    return labels.unionByName(count(totals, "total")).unionByName(count(short, "lines")).unionByName(missing)
