"""Contracts counted by the job that reads or writes the data."""

import pytest
from pyspark.sql import functions as F

from seqlattice import contracts as C


def table(spark):
    return spark.createDataFrame([(1, "a", 5.0), (2, " ", 6.5), (3, None, -1.0)], "id int, name string, x double").repartition(3)


def test_one_job_counts_rows_and_all_checks(spark, tmp_path):
    checks = {"name": C.filled("name"), "whole": C.whole_count("x"), "id": F.col("id") > 0}
    watched, seen = C.watch(table(spark), checks, least="nothing there")
    watched.write.parquet(str(tmp_path / "t"))
    assert seen.violations() == {"name": 2, "whole": 2, "id": 0}
    with pytest.raises(C.ContractError, match=r"name \(2 rows\).*\"id\":2"):
        seen.verify()
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_stored_and_saved(spark, tmp_path):
    good = table(spark).filter("id = 1")
    assert C.stored(good, {"name": C.filled("name")}, least="no rows").collect() == good.collect()
    with pytest.raises(C.ContractError, match="no rows"):
        C.stored(good.limit(0), {}, least="no rows")
    assert C.stored(good.limit(0), {"name": C.filled("name")}).count() == 0
    C.saved(good, {"whole": C.whole_count("x")}, lambda df: df.write.parquet(str(tmp_path / "a")))
    with pytest.raises(C.ContractError, match="whole"):
        C.saved(table(spark), {"whole": C.whole_count("x")}, lambda df: df.write.parquet(str(tmp_path / "b")))


def test_rules(spark):
    rows = spark.createDataFrame([("g", "n", 1.0, 0.5, 1.0), ("g", "n", float("nan"), 0.5, 0.1), ("g", "", 1.0, 0.5, 0.1), ("g", "n", 1.0, 1.5, 0.1), (None, "n", 1.0, 0.5, 0.1)], "gene_id string, gene_name string, logFC double, PValue double, FDR double")
    assert [r[0] for r in rows.select(F.coalesce(C.de_rule(), F.lit(False))).collect()] == [True, False, False, False, False]
    reads = spark.createDataFrame([("ACGT", "IIII"), ("ACGT", "III"), ("*", "*"), ("AC", "II")], "seq string, qual string")
    assert [r[0] for r in reads.select(C.read_rule(length=3)).collect()] == [True, False, False, False]
    labels = spark.createDataFrame([("A",), ("A",), ("C",), (None,)], "condition string")
    assert sorted(map(str, (tuple(r) for r in C.label_counts(labels, "condition", ["A", "B"]).collect()))) == ["('A', 2)", "('B', 0)", "(None, 2)"]
    with pytest.raises(C.ContractError, match="Unknown"):
        C.expect_conditions(labels, ["A", "B"])
    with pytest.raises(C.ContractError, match="replicates"):
        C.expect_conditions(labels.filter("condition = 'A'"), ["A", "B"])
    totals = spark.createDataFrame([("a", 1), ("a", -1), ("b", 2), ("c", None)], "k string, v int")
    assert sorted(r["k"] for r in C.nonpositive_totals(totals, "k", "v").collect()) == ["a", "c"]
