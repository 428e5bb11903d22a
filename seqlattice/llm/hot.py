"""Look-ups by keys of which a few may hold most rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlattice.llm.names import col

# A key is hot if it holds more than one in HOT of what its caller counts, so there are fewer than HOT hot keys.
HOT = 4096


def lookup(left: DataFrame, right: DataFrame, keys: dict[str, str], hot: Column) -> DataFrame:
    """Rows of ``left`` with the columns of the one row of ``right`` that has their key; others are left out.

    ``keys`` maps columns of ``left`` to those of ``right``, where a key occurs once; a null key is a key. All other names
    differ. ``hot`` says which rows of ``right`` have keys with more than one in ``HOT`` of all rows (fewer than
    ``HOT`` rows, which are broadcast); rows of ``left`` with other keys are joined as Spark plans it. ``left`` and ``right``
    are read twice.
    """
    values = [col(c) for c in right.columns if c not in keys.values()]
    kept = [col(c) for c in left.columns]
    few, rest = F.broadcast(right.filter(hot)), right.filter(~hot)
    same = reduce(lambda a, b: a & b, [col(a).eqNullSafe(col(b)) for a, b in keys.items()])
    near = left.join(few, same).select(*kept, *values)
    far = left.join(few, same, "left_anti").join(rest, same).select(*kept, *values)
    return near.unionByName(far)
