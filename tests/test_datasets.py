"""Datasets in buckets: the same results, without a shuffle by cell or gene."""

import pytest
from pyspark.sql import functions as F

from seqlattice.contracts import ContractError
from seqlattice.operators.counts import CellDataset, cell_totals
from seqlattice.operators.embedding import gene_moments
from seqlattice.operators.markers import log_normalize
from seqlattice.sources import datasets


def make(spark):
    rows = [(f"g{g}", f"c{c}", (g * 7 + c * 3) % 11) for g in range(30) for c in range(40) if (g + c) % 3]
    counts = spark.createDataFrame(rows, "gene string, cell string, count long").filter("count > 0")
    cells = spark.createDataFrame([(f"c{c}", "x" if c % 2 else "y", c) for c in range(42)], "cell string, `group` string, `size.n` int")
    features = spark.createDataFrame([(f"g{g}", f"name {g}") for g in range(31)], "gene string, gene_name string")
    return CellDataset(counts, features, cells, spark.createDataFrame([("made", 1)], "what string, n int"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def exact_plans(spark):
    """Plans as they are before any stage has run, and no broadcasts, as for large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_stored_tables_give_the_same_results_without_a_shuffle(spark, tmp_path, exact_plans):
    data = make(spark)
    stored = datasets.write_dataset(data, str(tmp_path / "d"), buckets=4)
    again = datasets.read_dataset(spark, str(tmp_path / "d"))
    assert again.buckets == 4 and again.cells.columns == data.cells.columns
    for one, two in ((stored.by_cell, data.counts), (again.by_gene, data.counts), (again.cells, data.cells), (again.features, data.features)):
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert spark.read.parquet(str(tmp_path / "d" / "provenance")).count() == 1

    normal = again.normalized()
    assert "Exchange" not in plan(normal.groupBy("cell").agg(F.sum("value")))
    want = log_normalize(data.counts, cell_totals(data.counts))
    key = lambda df: sorted((r["gene"], r["cell"], r["count"], round(r["value"], 9)) for r in df.collect())
    assert key(normal) == key(want)

    moments = again.moments()
    assert "Exchange" not in plan(moments)
    rounded = lambda df: sorted((r["gene"], r["nonzero"], round(r["mean"], 9), round(r["variance"], 9)) for r in df.collect())
    assert rounded(moments) == rounded(gene_moments(data.counts, data.features, 42))

    some = again.select_cells(F.col("group") == "x")
    assert "Exchange" not in plan(some.normalized())
    plain = data.select_cells(F.col("group") == "x")
    assert key(some.normalized()) == key(log_normalize(plain.counts, cell_totals(plain.counts)))
    assert rounded(some.moments()) == rounded(gene_moments(plain.counts, plain.features, 21))


def test_bucket_numbers_and_missing_datasets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(datasets, "BUCKET_ROWS", 300)
    data = make(spark)
    assert datasets.write_dataset(data, str(tmp_path / "d")).buckets == -(-data.counts.count() // 300) > 1
    with pytest.raises(ContractError):
        datasets.write_dataset(data, str(tmp_path / "e"), buckets=0)
    empty = CellDataset(data.counts.limit(0), data.features.limit(0), data.cells.limit(0))
    stored = datasets.write_dataset(empty, str(tmp_path / "f"))
    assert stored.buckets == 1 and stored.normalized().collect() == [] and stored.moments().collect() == []
