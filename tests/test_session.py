import os
from urllib.parse import urlparse

from seqlattice import checkpoint_folder, materialize, release
from seqlattice.operators.ordering import scan, slice_rows


def test_tables_go_to_the_session_folder_and_can_be_released(spark):
    folder = checkpoint_folder(spark)
    assert folder == spark.sparkContext.getCheckpointDir() == checkpoint_folder(spark)
    table = materialize(spark.range(10))
    (path,) = {os.path.dirname(urlparse(p).path) for p in table.inputFiles()}
    assert path.startswith(urlparse(folder).path) and os.path.isdir(path)
    assert release(spark) >= 1 and not os.path.isdir(path)


def test_scan_does_not_gather_all_rows(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = slice_rows(spark.range(1000), [], ["id"])
        slices = table.groupBy("_slice").count().collect()
        running = scan(table, [], ["id"], "upto", "id", total="all").collect()
        back = scan(table, [], ["id"], "least", "id", how="min", reverse=True, inclusive=False).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(slices) == 4 and max(r["count"] for r in slices) < 500
    assert all(r["upto"] == r["id"] * (r["id"] + 1) // 2 and r["all"] == 499500 for r in running)
    assert all(r["least"] == (r["id"] + 1 if r["id"] < 999 else None) for r in back)
