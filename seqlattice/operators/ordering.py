"""Ranks, running totals, exact quantiles and FDR without a single-task sort.

A window without a partition key (or with one hot key) sorts everything in one task. Here the rows
are range-partitioned over ``by + order``, so a hot group is spread over many slices; each slice is
scanned on its own and shifted by the total of the slices before it. The sliced table is written
out once, so every later use sees the same slices, also after an executor is lost.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlattice.session import materialize

SLICE = "_slice"
_COMBINE = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest}
_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def slice_rows(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range-partition on ``by + order`` (ascending) and record the slice of every row.

    Rows with equal keys share a slice, so aggregate copies first (``weighted``).
    """
    ranged = df.repartitionByRange(*by, *order)
    return materialize(ranged.withColumn(SLICE, F.spark_partition_id()))


def _same(keys: Sequence[str]) -> Column:
    """Equal keys, nulls included, of a table and one whose keys are prefixed."""
    equal = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return reduce(lambda a, b: a & b, equal)


def scan(
    table: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    name: str,
    value: Column | str,
    how: str = "sum",
    reverse: bool = False,
    inclusive: bool = True,
    total: str | None = None,
) -> DataFrame:
    """Add the running ``how`` of ``value`` along ``order`` inside each ``by`` group.

    ``table`` comes from ``slice_rows``. ``reverse`` runs from the last row back. ``total`` names a
    column for the value over the whole group.
    """
    value = F.col(value) if isinstance(value, str) else value
    aggregate, combine = _AGG[how], _COMBINE[how]
    ordering = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    slices = F.col(SLICE).desc() if reverse else F.col(SLICE).asc()
    last = 0 if inclusive else -1

    keys = [*by, SLICE]
    local = Window.partitionBy(*keys).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, last)
    running = table.withColumn("_value", value)
    per_slice = running.groupBy(*keys).agg(aggregate("_value").alias("_slice_value"))
    # One row per slice of a group: never more rows than there are range partitions.
    across = Window.partitionBy(*by).orderBy(slices).rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_slice.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        aggregate("_slice_value").over(across).alias("_before"),
        aggregate("_slice_value").over(Window.partitionBy(*by)).alias("_total"),
    )
    joined = running.withColumn("_local", aggregate("_value").over(local)).join(shifts, _same(keys))
    merged = (
        F.when(F.col("_before").isNull(), F.col("_local"))
        .when(F.col("_local").isNull(), F.col("_before"))
        .otherwise(combine(F.col("_local"), F.col("_before")))
    )
    columns = [c for c in table.columns if c != name]
    extra = [F.col("_total").alias(total)] if total else []
    return joined.select(*columns, merged.alias(name), *extra)


def row_numbers(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str, total: str | None = None) -> DataFrame:
    """1-based position in each group along a total order."""
    sliced = slice_rows(df, by, order)
    return scan(sliced, by, order, name, F.lit(1).cast("bigint"), total=total).drop(SLICE)


def weighted(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Distinct values with their multiplicity ``n``; copies collapse before the shuffle."""
    return df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def average_rank(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the rank of ``value`` in its group, ties sharing their mean rank; a null value is not ranked and gets a null."""
    present = weighted(df.filter(F.col(value).isNotNull()), by, value)
    table = scan(slice_rows(present, by, [value]), by, [value], "_upto", "n")
    ranks = table.select(*by, value, (F.col("_upto") - (F.col("n") - 1) / 2.0).alias(name))
    return _joined_back(df, ranks, [*by, value], name)


def _joined_back(df: DataFrame, found: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``name`` from one row per key; keys may be null, and rows without a match keep a null."""
    other = found.select(*[F.col(k).alias(f"_key_{k}") for k in keys], name)
    order = [*keys, *[c for c in df.columns if c not in keys]]
    return df.join(other, _same(keys), "left").select(*order, name)


def weighted_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probabilities: dict[str, float], n: str = "n"
) -> DataFrame:
    """Exact interpolated quantiles (type 7) of values carrying a multiplicity ``n``."""
    table = scan(slice_rows(df, by, [value]), by, [value], "_upto", n, total="_size")
    first = F.col("_upto") - F.col(n)

    def at(index: Column) -> Column:
        return F.max(F.when((first <= index) & (index < F.col("_upto")), F.col(value)))

    parts = []
    for label, p in probabilities.items():
        target = (F.col("_size") - 1) * F.lit(float(p))
        low = F.floor(target)
        high = F.least(low + 1, F.col("_size") - 1)
        parts += [
            at(low).alias(f"_{label}_low"),
            at(high).alias(f"_{label}_high"),
            F.max(target - low).alias(f"_{label}_part"),
        ]
    found = table.groupBy(*by).agg(*parts)
    return found.select(
        *by,
        *[
            (F.col(f"_{p}_low") + F.col(f"_{p}_part") * (F.col(f"_{p}_high") - F.col(f"_{p}_low"))).alias(p)
            for p in probabilities
        ],
    )


def quantiles(df: DataFrame, by: Sequence[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Exact type-7 quantiles per group; ``probabilities`` maps output name to p."""
    present = df.filter(F.col(value).isNotNull())
    return weighted_quantiles(weighted(present, by, value), by, value, probabilities)


def benjamini_hochberg(df: DataFrame, p: str, name: str) -> DataFrame:
    """Add the false discovery rate over all rows with a p-value; a null stays and gets a null.

    For tied p-values the last rank gives the smallest ratio, so distinct values suffice.
    """
    present = weighted(df.filter(F.col(p).isNotNull()), [], p)
    table = scan(slice_rows(present, [], [p]), [], [p], "_upto", "n", total="_size")
    ratio = F.col(p) * F.col("_size") / F.col("_upto")
    adjusted = scan(table, [], [p], name, F.least(F.lit(1.0), ratio), how="min", reverse=True)
    return _joined_back(df, adjusted.select(p, name), [p], name)
