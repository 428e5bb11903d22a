"""URL rules by a sorted sweep over reversed-host keys; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlattice.session import materialize

DEFAULT_VERDICT = "allow"
# Copies of each rule, over which the urls of one host are dealt.
SALTS = 64


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://`` or for a null."""
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def reversed_host(host: Column) -> Column:
    """Labels from the last to the first, so that a domain is a prefix of its subdomains."""
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _stacks(rules: DataFrame) -> DataFrame:
    """Each distinct rule with the stack that a sweep holds at its start: the rules of its host whose path it begins with.

    A rule's enclosing rules are found by its own prefixes, so the work is the length of the paths.
    """
    known = rules.select(reversed_host(F.col("host")).alias("key"), "host", "path", "verdict").filter(
        F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull()
    )
    # Of equal rules that disagree, block stays.
    known = known.groupBy("key", "host", "path").agg(F.max("verdict").alias("verdict"))
    inner = known.select("key", F.col("path").alias("at"), F.explode(F.expr("sequence(0, length(path))")).alias("size"))
    inner = inner.select("key", "at", F.expr("substring(at, 1, size)").alias("path"))
    held = inner.join(known, ["key", "path"]).groupBy("key", "at").agg(
        F.sort_array(F.collect_list(F.struct(F.length("path").alias("size"), "path", "host", "verdict"))).alias("stack")
    )
    return held.select("key", F.col("at").alias("path"), "stack")


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = DEFAULT_VERDICT, salts: int = SALTS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` per row of ``pages``.

    ``rules`` has ``host, path, verdict`` (allow or block). A rule fits its host and all subdomains
    where the url's path starts with the rule's. The longest rule (host and path together, then host)
    wins; a page that no rule fits gets ``default`` and a null rule.

    A url has one key for each domain above it, ``reversed domain, path``; among the keys of one domain a
    rule is the interval of all paths that begin with its own, and intervals nest. Sorted together, the
    last rule start before a url holds the stack of rules open there, and the deepest of them that the path
    begins with is the answer. Rules are copied ``salts`` times, so a domain with a third of all urls is
    swept by as many tasks.

    A null or empty url, or one without ``://``, has empty host and path. Repeated rows are judged each;
    a null id is kept. Rules with a null in any column are left out. Other columns are not read.
    """
    host, path = url_parts(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    # Written once, so that both uses below see the same row numbers.
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    stacks = _stacks(rules.select("host", "path", "verdict"))
    # No rule lies deeper than this, so deeper domains of a url need no key.
    deepest = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    labels = F.reverse(F.split("host", r"\."))
    depths = F.sequence(F.lit(1), F.least(F.lit(deepest), F.size(labels)))
    probes = rows.select("row", "path", labels.alias("labels"), F.explode(depths).alias("depth"))
    probes = probes.select("row", "path", F.array_join(F.slice("labels", F.lit(1), F.col("depth")), ".").alias("key"))
    # Spark broadcasts these few keys only if they are under its own size limit, and shuffles otherwise.
    probes = probes.join(stacks.select("key").distinct(), "key", "left_semi")
    salted = probes.select("key", F.pmod(F.xxhash64("row"), F.lit(salts)).alias("salt"), "path", F.lit(1).alias("kind"), "row", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"))
    starts = stacks.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), "path", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("row"), "stack")
    sweep = Window.partitionBy("key", "salt").orderBy("path", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = starts.unionByName(salted).withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 1 AND open IS NOT NULL")
    fits = F.filter("open", lambda r: F.startswith(F.col("path"), r["path"]))
    found = swept.select("row", F.try_element_at(fits, F.lit(-1)).alias("r")).filter("r IS NOT NULL")
    ranked = found.select(
        "row",
        F.struct((F.length("r.host") + F.length("r.path")).alias("size"), F.length("r.host").alias("wide"), F.concat("r.host", "r.path").alias("rule"), F.col("r.verdict").alias("verdict")).alias("best"),
    )
    blank = rows.select("row", "page_id", "host", "path", F.lit(None).cast(ranked.schema["best"].dataType).alias("best"))
    both = blank.unionByName(ranked, allowMissingColumns=True)
    # One group per row: itself and the best rule of each domain above it.
    joined = both.groupBy("row").agg(
        F.max("page_id").alias("page_id"), F.max("host").alias("host"), F.max("path").alias("path"), F.max("best").alias("best")
    )
    return joined.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
