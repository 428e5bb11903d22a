"""Columns of a user's table, whatever they are called."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def col(name: str) -> Column:
    """The top-level column ``name``, which may hold dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame, without: tuple[str, ...] = ()) -> list[Column]:
    """All columns of ``df`` but those called as in ``without``, in any case."""
    gone = {w.lower() for w in without}
    return [col(c) for c in df.columns if c.lower() not in gone]


def free(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted``, each with as many underscores in front as it takes to differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` for any names, of which that method takes only plain ones; ``run`` goes by the order of columns."""
    given, plain = schema.names, [f"c{k}" for k in range(len(schema))]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch.rename_columns(plain)

    fields = [StructField(n, f.dataType, f.nullable) for n, f in zip(plain, schema.fields)]
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).mapInArrow(renamed, StructType(fields)).toDF(*given)
