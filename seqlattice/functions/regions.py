"""Column functions over genomic positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqlattice.schemas import Region


def contains(chrom: str, position: str, region: Region) -> Column:
    """Closed-interval containment on the region's contig."""
    return (F.col(chrom) == region.chrom) & F.col(position).between(region.start, region.end)


def on_contigs(chrom1: str, chrom2: str, a: Region, b: Region) -> Column:
    """The two ends lie on exactly the contigs of the two regions, in either order."""
    wanted = sorted({a.chrom, b.chrom})
    ends = F.array_sort(F.array_distinct(F.array(F.col(chrom1), F.col(chrom2))))
    return ends == F.array(*[F.lit(c) for c in wanted])


def aligned_blocks(position: Column | str, cigar: Column | str) -> Column:
    """Closed reference intervals covered by an alignment, split where the CIGAR skips (N).

    Deletions stay inside a block; insertions and clips use no reference bases.
    """
    cigar = F.col(cigar) if isinstance(cigar, str) else cigar
    position = F.col(position) if isinstance(position, str) else position
    spans = F.split(cigar, "N")
    used = F.transform(
        F.transform(spans, lambda s: F.regexp_replace(s, r"[0-9]+$", "")),
        lambda s: F.aggregate(
            F.regexp_extract_all(s, F.lit(r"([0-9]+)[MDX=]"), F.lit(1)),
            F.lit(0).cast("bigint"),
            lambda acc, x: acc + x.cast("bigint"),
        ),
    )
    skipped = F.regexp_extract_all(cigar, F.lit(r"([0-9]+)N"), F.lit(1))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    indexed = F.transform(used, lambda size, i: F.struct(size.alias("size"), i.alias("i")))
    folded = F.aggregate(
        indexed,
        F.struct(position.cast("bigint").alias("at"), empty.alias("blocks")),
        lambda acc, x: F.struct(
            (acc["at"] + x["size"] + F.coalesce(F.get(skipped, x["i"]).cast("bigint"), F.lit(0).cast("bigint"))).alias("at"),
            F.when(
                x["size"] > 0,
                F.concat(
                    acc["blocks"],
                    F.array(F.struct(acc["at"].alias("start"), (acc["at"] + x["size"] - 1).alias("end"))),
                ),
            )
            .otherwise(acc["blocks"])
            .alias("blocks"),
        ),
    )
    return folded["blocks"]
