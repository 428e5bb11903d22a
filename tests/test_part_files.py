"""Files are dealt by the number of their lines."""

import glob

from pyspark.sql import functions as F

from workload import roundtrips


def test_more_lines_make_more_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(roundtrips, "PART_LINES", 100)
    lines = spark.range(2000).select("id", F.col("id").cast("string").alias("value"))
    place = roundtrips._put(lines, str(tmp_path / "x"), "id")
    assert len(glob.glob(f"{place}/part-*")) == 20
    assert sorted(int(r["value"]) for r in spark.read.text(place).collect()) == list(range(2000))
