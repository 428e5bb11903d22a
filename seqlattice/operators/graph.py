"""Connected components: by star contraction, and inside bounded groups by task-local labels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlattice.session import materialize


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("src", "dst")).alias("x"), F.max(F.xxhash64("dst", "src")).alias("m")
    ).first()
    return row["n"], row["x"], row["m"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = both.groupBy("src").agg(F.min("dst").alias("_m")).select("src", F.least("src", "_m").alias("_low"))
    return (
        both.join(low, "src")
        .filter(F.col("dst") > F.col("src"))
        .select(F.col("dst").alias("src"), F.col("_low").alias("dst"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    low = down.groupBy("src").agg(F.min("dst").alias("_low"))
    moved = down.join(low, "src").filter(F.col("dst") != F.col("_low")).select(F.col("dst").alias("src"), F.col("_low").alias("dst"))
    return moved.unionByName(low.select("src", F.col("_low").alias("dst"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node with an edge; the component is its smallest node.

    ``edges`` has ``src`` and ``dst`` of one orderable type. Only minima are grouped, never neighbour
    lists, and each round is written out, so neither a hub nor the number of rounds piles up state.
    """
    current = materialize(edges.filter(F.col("src") != F.col("dst")).select("src", "dst").distinct())
    mark = _fingerprint(current)
    while mark[0]:
        following = materialize(_small_star(_large_star(current)))
        seen = _fingerprint(following)
        current = following
        if seen == mark:
            break
        mark = seen
    members = current.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    roots = current.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return members.unionByName(roots)


# Edges of one group that a single task may hold.
GROUP_EDGES = 500_000
# Edges per bucket of small groups.
BUCKET_EDGES = 200_000


def _labels(src: np.ndarray, dst: np.ndarray, size: int) -> np.ndarray:
    """Smallest node of each component, by repeated minima and pointer jumps."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[src], label[dst])
        following = label.copy()
        np.minimum.at(following, src, low)
        np.minimum.at(following, dst, low)
        following = following[following]
        if np.array_equal(following, label):
            return label
        label = following


def grouped_components(edges: DataFrame, group: Sequence[str], max_edges: int = GROUP_EDGES) -> DataFrame:
    """``group.., node, component`` for edges ``group.., src, dst`` (strings) that stay inside a group.

    Groups up to ``max_edges`` are labelled whole in one task, many groups per task; larger ones go
    through the contraction, so no group is too large.
    """
    keys = list(group)
    table = materialize(edges.select(*keys, "src", "dst"))
    sizes = materialize(table.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    summary = sizes.agg(F.sum("_n").alias("n"), F.max("_n").alias("top")).first()
    if summary["n"] is None:
        return table.select(*keys, F.col("src").alias("node"), F.col("dst").alias("component"))
    buckets = -(-summary["n"] // BUCKET_EDGES)
    small = table
    if summary["top"] > max_edges:
        small = table.join(sizes.filter(F.col("_n") <= max_edges).drop("_n"), keys, "left_semi")
    schema = small.select(*keys, F.col("src").alias("node"), F.col("dst").alias("component")).schema

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        owner = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        ends = pd.DataFrame({"g": np.tile(owner, 2), "name": pd.concat([pdf["src"], pdf["dst"]], ignore_index=True)})
        nodes = ends.drop_duplicates().sort_values(["g", "name"], ignore_index=True)
        code = pd.MultiIndex.from_frame(nodes)
        at = code.get_indexer(pd.MultiIndex.from_frame(ends))
        label = _labels(at[: len(pdf)], at[len(pdf) :], len(nodes))
        first = pdf[keys].iloc[np.unique(owner, return_index=True)[1]].reset_index(drop=True)
        out = first.iloc[nodes["g"].to_numpy()].reset_index(drop=True)
        return out.assign(node=nodes["name"], component=nodes["name"].to_numpy()[label])

    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_b")
    found = small.groupBy(bucket).applyInPandas(local, schema)
    if summary["top"] <= max_edges:
        return found
    large = table.join(sizes.filter(F.col("_n") > max_edges).drop("_n"), keys, "left_semi")
    ends = [F.struct(*keys, F.col(e).alias("name")).alias(e) for e in ("src", "dst")]
    contracted = connected_components(large.select(*ends))
    names = [F.col(f"node.{k}").alias(k) for k in keys]
    return found.unionByName(contracted.select(*names, F.col("node.name").alias("node"), F.col("component.name").alias("component")))
