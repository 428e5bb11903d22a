"""The sweep join against a nested loop, for intervals of any length."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlattice.operators import ranges, sweep


def tables(spark, seed, longest):
    rnd = random.Random(seed)
    limit = 4 * longest
    points = [(i, rnd.choice(["x", "y", "z", None]), None if i % 41 == 0 else longest if i % 3 == 0 else rnd.randint(-5, limit), {"k": i}) for i in range(240)]
    spans = []
    for j in range(70):
        start = rnd.choice([rnd.randint(-20, limit), longest])
        length = rnd.choice([0, 1, rnd.randint(0, longest), longest, -1])
        spans.append((j, rnd.choice(["x", "y", "w", None]), start, None if j % 23 == 0 else start + length))
    return points, spans, spark.createDataFrame(points, "id int, chrom string, pos long, tags map<string,int>").repartition(5), spark.createDataFrame(spans, "gene int, chrom string, start long, end long").repartition(3)


@pytest.mark.parametrize("longest", [1, 60, 10**8])
@pytest.mark.parametrize("slices", ["1", "7", "40"])
def test_pairs_equal_a_nested_loop(spark, longest, slices):
    points, spans, left, right = tables(spark, longest, longest)
    fine = [s for s in spans if s[3] is not None and s[2] <= s[3]]
    inside = lambda p, s: p[1] is not None and p[1] == s[1] and p[2] is not None and s[2] <= p[2] <= s[3]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", slices)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = sweep.sweep_join(left, right)
        assert found.columns == ["id", "chrom", "pos", "tags", "gene", "start", "end"]
        want = sorted((p[0], s[0], s[2], s[3]) for p in points for s in fine if inside(p, s))
        assert sorted((r["id"], r["gene"], r["start"], r["end"]) for r in found.collect()) == want
        outer = sweep.sweep_join(left, right, how="left").collect()
        matched = {w[0] for w in want}
        assert sorted((r["id"], -1 if r["gene"] is None else r["gene"]) for r in outer) == sorted([(a, b) for a, b, _, _ in want] + [(p[0], -1) for p in points if p[0] not in matched])
        assert all(r["tags"] == {"k": r["id"]} for r in outer)
        wide = left.select("id", "chrom", F.col("pos").alias("from"), (F.col("pos") + F.when(F.col("id") % 5 == 0, -1).otherwise(longest // 2 + 1)).alias("to"))
        pairs = sorted((r["id"], r["gene"]) for r in sweep.sweep_overlaps(wide, right).collect())
        reach = lambda p: -1 if p[0] % 5 == 0 else longest // 2 + 1
        assert pairs == sorted((p[0], s[0]) for p in points for s in fine if p[1] is not None and p[1] == s[1] and p[2] is not None and reach(p) >= 0 and p[2] <= s[3] and p[2] + reach(p) >= s[2])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_intervals_are_repeated_by_slice_and_not_by_length(spark):
    points = spark.range(0, 10**9, 10**6).select(F.lit("c").alias("chrom"), F.col("id").alias("pos"))
    genes = spark.createDataFrame([("c", 0, 10**9, "long"), ("c", 5, 6, "short")], "chrom string, start long, end long, gene string")
    found = ranges.range_join(points, genes, bin_size=10)
    assert found.filter("gene = 'long'").count() == 1000 and found.filter("gene = 'short'").count() == 0


def test_keys_and_empty_sides(spark):
    left = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("b", 1, 7)], "chrom string, strand int, pos long")
    right = spark.createDataFrame([("a", 1, 0, 9), ("b", 1, 7, 7), ("b", 2, 0, 9)], "chrom string, strand int, start long, end long")
    found = sweep.sweep_join(left, right, on=("chrom", "strand"))
    assert sorted(map(tuple, found.collect())) == [("a", 1, 5, 0, 9), ("b", 1, 7, 7, 7)]
    assert sweep.sweep_join(left, right.limit(0), on=("chrom", "strand")).collect() == []
    assert len(sweep.sweep_join(left, right.limit(0), on=("chrom", "strand"), how="left").collect()) == 3
    assert sweep.sweep_join(left.limit(0), right, on=("chrom", "strand"), how="left").collect() == []


def test_kernel_on_random_numbers():
    rng = np.random.default_rng(5)
    for _ in range(50):
        n, m = rng.integers(0, 40, 2)
        a, b = rng.integers(-1, 3, n), rng.integers(-1, 3, m)
        x, s = rng.integers(-30, 30, n), rng.integers(-30, 30, m)
        e = s + rng.integers(-3, 20, m)
        point, interval = sweep.hits(a, x, b, s, e)
        assert sorted(zip(point.tolist(), interval.tolist())) == [(i, j) for i in range(n) for j in range(m) if a[i] == b[j] >= 0 and s[j] <= x[i] <= e[j]]
        to = x + rng.integers(-2, 9, n)
        one, two = sweep.overlaps(a, x, to, b, s, e)
        assert sorted(zip(one.tolist(), two.tolist())) == [(i, j) for i in range(n) for j in range(m) if a[i] == b[j] >= 0 and x[i] <= to[i] and s[j] <= e[j] and x[i] <= e[j] and to[i] >= s[j]]


def test_no_genes_at_all(spark):
    reads = spark.createDataFrame([(1, 3, "c", 100, 255, "5M", None), (2, 3, None, None, 255, "*", None)], "id int, flag int, rname string, pos long, mapq int, cigar string, nh int")
    none = spark.createDataFrame([], "chrom string, start long, end long, gene_id string")
    some = spark.createDataFrame([("c", 100, 101, "g")], none.schema)
    assert {r["status"] for r in ranges.assign_reads(reads, none, ["id"]).collect()} == {"Unassigned_NoFeatures"}
    assert sorted(str(r["gene_id"]) for r in ranges.assign_reads(reads, some, ["id"]).collect()) == ["None", "g"]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_large_tables_meet_in_bins_and_move_once(spark, how):
    """Without Python, events or copies of the points: one join on the bins."""
    _, _, left, right = tables(spark, 60, 60)
    right = right.filter("start <= end")
    small = ranges.range_join(left.drop("tags"), right, bin_size=40, how=how)
    found = ranges.range_join(left.drop("tags"), right, bin_size=40, how=how, broadcast_rows=0)
    assert sorted(map(str, found.collect())) == sorted(map(str, small.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "InArrow" not in plan


def test_genes_of_reads_by_bins_near_and_far(spark):
    rnd = random.Random(3)
    exons = [(rnd.choice(["x", "y", None]), s, s + rnd.randint(-1, 90), rnd.choice(["a", "b", "c", None])) for s in (rnd.randint(-200, 9000) for _ in range(150))]
    shapes = ["30M", "10M300N20M", "10M5I700N9M3D8M", "4S6M2000N7M800N3M", "*", "12M100N0M", None]
    reads = [(i, rnd.choice([1, 3, 4, 9, None]), rnd.choice(["x", "y", "z", None]), rnd.choice([rnd.randint(-300, 9000), 511, 512]), 255, rnd.choice(shapes), rnd.choice([1, 1, 2, None])) for i in range(1500)]
    given = spark.createDataFrame(exons, "chrom string, start long, end long, gene_id string")
    table = spark.createDataFrame(reads, "id int, flag int, rname string, pos long, mapq int, cigar string, nh int")
    want = ranges.assign_reads(table, given, ["id"]).orderBy("id").collect()
    found = ranges.assign_reads(table, given, ["id"], broadcast_rows=0).orderBy("id")
    assert found.collect() == want
    short = table.filter("cigar = '30M'")
    plan = ranges.assign_reads(short, given, ["id"], broadcast_rows=0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "InArrow" not in plan
