"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with adaptive execution and Arrow on; ``conf`` wins over the defaults."""
    builder = SparkSession.builder.appName("seqlattice")
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


# Bytes of rows that travel to a Python worker together. Spark's own limit is 64 MB, which a task holds several times over: the
# executor as Arrow vectors and as the bytes that it sends, outside the heap, and the worker as a batch and what it makes of it.
ARROW_BYTES = 4 << 20
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Limit Arrow batches of this session to ARROW_BYTES, or one row that is larger; a limit that the session has stays."""
    if _ARROW_BYTES not in spark.conf.getAll:
        spark.conf.set(_ARROW_BYTES, str(ARROW_BYTES))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's code to the executors, so that functions in Python find it from any working folder.

    Once for each application; a package that is installed there already does no harm.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    place = os.path.join(tempfile.mkdtemp(prefix="spark-"), "seqlattice.zip")
    with zipfile.ZipFile(place, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(place)
    _SHIPPED.add(context.applicationId)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for cut lineage.

    The session's own setting always wins. A temporary folder is made only for a local master,
    where every task runs on this machine; a cluster without the setting is an error.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that every executor can reach")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir()


_WRITTEN: list[str] = []


def materialize(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back, as ``schema`` if its stored form is the same.

    Parquet rather than ``checkpoint()``: the plan runs once, later reads prune columns, and the
    planner knows the real size, so a join broadcasts the table only if it is small enough.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables written by ``materialize`` in this process; results built on them end here."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    count = 0
    while _WRITTEN:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        count += bool(place.getFileSystem(hadoop).delete(place, True))
    return count
