"""A stored dataset makes its counts once."""

from seqlattice.operators.counts import CellDataset
from seqlattice.sources.datasets import write_dataset


def test_counts_are_made_once_for_both_orders(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    counts = spark.createDataFrame([(g, g % 7, 1 + g % 3) for g in range(60)], "gene long, cell long, count long").mapInArrow(seen, "gene long, cell long, count long")
    data = CellDataset(counts, spark.range(60).withColumnRenamed("id", "gene"), spark.range(7).withColumnRenamed("id", "cell"))
    stored = write_dataset(data, str(tmp_path / "d"), buckets=2)
    assert made.value == 60
    rows = lambda table: sorted(tuple(r) for r in table.select("gene", "cell", "count").collect())
    assert rows(stored.by_gene) == rows(stored.by_cell) == [(g, g % 7, 1 + g % 3) for g in range(60)]
