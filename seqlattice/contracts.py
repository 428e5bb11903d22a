"""Data contracts.

``expect`` and its kin are jobs of their own that stop at the first few offending rows and raise with them. ``watch``, ``stored`` and
``saved`` count the offending rows while another job runs that reads or writes the data anyway. The functions that end in
``_rule`` or give a Column say what a valid row is; sources, sinks and queries share them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from seqlattice.session import materialize


COUNT_MESSAGE = "Not a whole number of zero or more"


class ContractError(ValueError):
    """A table broke a contract."""


def require_columns(df: DataFrame, exact: Sequence[str] | None = None, subset: Iterable[str] = ()) -> DataFrame:
    """Check the header before any job starts."""
    if exact is not None and list(df.columns) != list(exact):
        raise ContractError(f"Header must be exactly {list(exact)}; found {df.columns}")
    missing = [name for name in subset if name not in df.columns]
    if missing:
        raise ContractError(f"Missing columns: {missing}")
    return df


def expect(df: DataFrame, valid: Column, message: str, sample: int = 5) -> DataFrame:
    """Raise unless ``valid`` is true (not false, not null) on every row."""
    bad = df.filter(~F.coalesce(valid, F.lit(False))).limit(sample).collect()
    if bad:
        raise ContractError(f"{message}: {[row.asDict() for row in bad]}")
    return df


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``contract, violations``: how many rows are not true under each check, all in one aggregate."""
    counted = df.agg(*[F.count_if(~F.coalesce(valid, F.lit(False))).alias(name) for name, valid in checks.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("contract"), F.col(f"`{n}`").alias("violations")) for n in checks])
    return counted.select(F.explode(pairs).alias("v")).select("v.*")


class Watch:
    """Row contracts counted by the job that computes the watched table; ``verify`` waits for that job and raises.

    A task that runs twice may be counted twice, so a number of offending rows is a bound; none stays none.
    """

    def __init__(self, seen: Observation, checks: Sequence[str], least: str | None):
        self.seen, self.checks, self.least = seen, list(checks), least

    def violations(self) -> dict[str, int]:
        found = self.seen.get
        return {name: int(found[f"bad{k}"] or 0) for k, name in enumerate(self.checks)}

    def verify(self) -> None:
        found = self.seen.get
        if self.least is not None and not found["rows"]:
            raise ContractError(self.least)
        for k, name in enumerate(self.checks):
            if found[f"bad{k}"]:
                raise ContractError(f"{name} ({found[f'bad{k}']} rows): {found[f'one{k}']}")


def watch(df: DataFrame, checks: dict[str, Column], least: str | None = None) -> tuple[DataFrame, Watch]:
    """``df`` as it is, and a ``Watch`` over its rows: each check must be true on every row, and with ``least``, its message, there must be rows.

    The first job on the table that comes back does the counting. Of each check the smallest offending row is kept as an example.
    """
    seen = Observation()
    metrics = [F.count(F.lit(1)).alias("rows")]
    for k, valid in enumerate(checks.values()):
        bad = ~F.coalesce(valid, F.lit(False))
        metrics += [F.count_if(bad).alias(f"bad{k}"), F.min(F.when(bad, F.to_json(F.struct("*")))).alias(f"one{k}")]
    return df.observe(seen, *metrics), Watch(seen, list(checks), least)


def stored(df: DataFrame, checks: dict[str, Column], least: str | None = None) -> DataFrame:
    """``df`` written once and read back, with all its row contracts checked by the job that writes it."""
    watched, seen = watch(df, checks, least)
    out = materialize(watched)
    seen.verify()
    return out


def saved(df: DataFrame, checks: dict[str, Column], write: Callable[[DataFrame], None], least: str | None = None) -> None:
    """``write`` the table and raise afterwards if a row broke a contract; no job but that of ``write`` runs."""
    watched, seen = watch(df, checks, least)
    write(watched)
    seen.verify()


def filled(column: str, trim: bool = True) -> Column:
    """Neither null nor empty, nor blank with ``trim``."""
    return F.coalesce(F.trim(column) if trim else F.col(column), F.lit("")) != ""


def id_rule(column: Column | str, pattern: str) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.coalesce(value.rlike(pattern), F.lit(False))


def de_rule(gene_id: str = "gene_id", gene_name: str = "gene_name", effect: str = "logFC", p: str = "PValue", fdr: str = "FDR") -> Column:
    """Names are there, the effect is finite, and both probabilities lie between 0 and 1."""
    finite = ~F.isnan(effect) & (F.abs(F.col(effect)) < float("inf"))
    return filled(gene_id, trim=False) & filled(gene_name, trim=False) & finite & F.col(p).between(0, 1) & F.col(fdr).between(0, 1)


def read_rule(seq: str = "seq", qual: str = "qual", length: int = 1) -> Column:
    """Bases and qualities are there, as many of one as of the other, and at least ``length``."""
    both = (F.col(seq) != "*") & (F.col(qual) != "*")
    return both & (F.length(seq) == F.length(qual)) & (F.length(seq) >= length)


def lines_rule(lines: str = "lines") -> Column:
    """Lines of a FASTQ file come in fours."""
    return F.col(lines) % 4 == 0


def nonpositive_totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose values do not sum to more than zero, with their ``total``."""
    return df.groupBy(key).agg(F.sum(value).alias("total")).filter(~F.coalesce(F.col("total") > 0, F.lit(False)))


def label_counts(df: DataFrame, column: str, labels: Sequence[str]) -> DataFrame:
    """``label, n`` for each of ``labels``, those without rows too; other labels and nulls are one row with a null label, if there are any."""
    wanted = df.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    counted = df.groupBy(F.when(F.col(column).isin(*labels), F.col(column)).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    known = wanted.join(counted, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))
    return known.unionByName(counted.filter("label IS NULL"))


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their ``count``."""
    return df.groupBy(*keys).count().filter("count > 1")


def missing_keys(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``df`` that ``other`` lacks; a null is a key like any other."""
    return df.select(*keys).distinct().exceptAll(other.select(*keys).distinct())


def expect_all(df: DataFrame, checks: dict[str, Column], sample: int = 5) -> DataFrame:
    """Several checks in one pass; only if one fails are offending rows looked up."""
    broken = {r["contract"]: r["violations"] for r in violations(df, checks).filter("violations > 0").collect()}
    for name in broken:
        expect(df, checks[name], f"{name} ({broken[name]} rows)", sample)
    return df


def expect_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ContractError(message)
    return df


def expect_unique(df: DataFrame, keys: Sequence[str], message: str, sample: int = 5) -> DataFrame:
    repeated = repeated_keys(df, keys).limit(sample).collect()
    if repeated:
        raise ContractError(f"{message}: {[row.asDict() for row in repeated]}")
    return df


def expect_references(df: DataFrame, other: DataFrame, keys: Sequence[str], message: str, sample: int = 5) -> DataFrame:
    """Every key of ``df`` must exist in ``other``; repeated keys meet once."""
    missing = df.select(*keys).distinct().join(other.select(*keys).distinct(), list(keys), "left_anti").limit(sample).collect()
    if missing:
        raise ContractError(f"{message}: {[tuple(row) for row in missing]}")
    return df


def expect_ids(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return expect(df, id_rule(column, pattern), f"Unsafe value in {column}")


def whole_count(column: Column | str, tolerance: float = 0.0) -> Column:
    """True where the text or number is a finite, non-negative whole number."""
    value = F.expr(f"try_cast({column} AS DOUBLE)") if isinstance(column, str) else column.cast("double")
    gap = F.abs(value - F.round(value))
    return (
        value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < F.lit(float("inf"))) & (gap <= F.lit(tolerance))
    )


def expect_counts(df: DataFrame, column: str = "count", tolerance: float = 0.0) -> DataFrame:
    return expect(df, whole_count(column, tolerance), COUNT_MESSAGE)


def expect_positive_totals(df: DataFrame, key: str, value: str, message: str) -> DataFrame:
    found = nonpositive_totals(df, key, value).limit(5).collect()
    if found:
        raise ContractError(f"{message}: {[row.asDict() for row in found]}")
    return df


def expect_conditions(samples: DataFrame, labels: Sequence[str], minimum: int = 1) -> DataFrame:
    """Only the given labels occur, and each has at least ``minimum`` rows."""
    counted = {row["label"]: row["n"] for row in label_counts(samples, "condition", labels).collect()}
    if None in counted:
        raise ContractError(f"Unknown condition ({counted[None]} rows)")
    short = {label: n for label, n in counted.items() if n < minimum}
    if short:
        raise ContractError(f"Each condition needs at least {minimum} replicates; found {short}")
    return samples


def require(condition: bool, message: str) -> None:
    """A check on driver-side parameters."""
    if not condition:
        raise ContractError(message)
