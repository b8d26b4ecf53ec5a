"""Operator 4: host reputation by empirical Bayes.

A url's rule, where one fits, decides; the outcomes of the pages so decided (allowed or
blocked) are the labels. For all others a host's share of allowed pages is estimated by
beta-binomial shrinkage in three steps: the suffix towards all pages, the registered
domain towards its suffix, the host towards its domain. How strongly a level shrinks is
fitted from how far its shares scatter (method of moments). A host is blocked when even
the upper bound of its posterior share stays under one half.

Urls that are null or have no ``://`` have an empty host and path; the empty host is a host
like any other. Repeated rows count each for itself. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: (verdict, host, beginning of the path)
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
Z = 1.645
LIMIT = 0.5
#: Bounds of the fitted correlation within a level; the strength of the prior is 1/r - 1.
LEAST_R, MOST_R = 0.001, 0.9


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. Among rules of one
    length the first in the list wins."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    out = None
    for verdict, h, p in ordered:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        what = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, what) if out is None else out.when(fits, what)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def domain_of(host: Column) -> Column:
    """The last two labels."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def strength(children: DataFrame, mean: str) -> DataFrame:
    """One row: the prior's strength for children (n, good) around their parents' mean."""
    m = F.col(mean)
    noise = m * (1 - m)
    r = (F.sum((F.col("good") - F.col("n") * m) ** 2 / F.col("n")) - F.sum(noise)) / F.sum((F.col("n") - 1) * noise)
    r = F.when(F.sum((F.col("n") - 1) * noise) > 0, r).otherwise(F.lit(MOST_R))
    r = F.least(F.greatest(r, F.lit(LEAST_R)), F.lit(MOST_R))
    return children.where("n > 0").agg(F.coalesce(1 / r - 1, F.lit(1 / MOST_R - 1)).alias("s"))


def reputations(judged: DataFrame) -> DataFrame:
    """judged: host, verdict of its rule or null. One row per host: n, good, share, upper."""
    spark = judged.sparkSession
    counts = stored(
        spark,
        judged.groupBy("host").agg(F.count("verdict").alias("n"), F.coalesce(F.sum((F.col("verdict") == "allow").cast("long")), F.lit(0)).alias("good"))
        .withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}),
        "hosts",
    )
    totals = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    # an even coin's worth of doubt at the top, so that no labels at all mean one half
    top = counts.agg(((F.coalesce(F.sum("good"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("parent"))

    def level(children: DataFrame, name: str) -> DataFrame:
        s = strength(children, "parent").scalar()
        return stored(spark, children.withColumns({"s": s}).withColumn(name, (F.col("good") + F.col("s") * F.col("parent")) / (F.col("n") + F.col("s"))), name)

    suffixes = level(counts.groupBy("suffix").agg(*totals).withColumn("parent", top.scalar()), "of_suffix")
    domains = counts.groupBy("domain", "suffix").agg(*totals).join(suffixes.select("suffix", F.col("of_suffix").alias("parent")), "suffix")
    domains = level(domains, "of_domain")
    hosts = counts.join(domains.select("domain", F.col("of_domain").alias("parent")), "domain")
    hosts = level(hosts, "share")
    a, b = F.col("good") + F.col("s") * F.col("parent"), F.col("n") - F.col("good") + F.col("s") * (1 - F.col("parent"))
    spread = F.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
    return hosts.select("host", "n", "good", "share", (F.col("share") + Z * spread).alias("upper"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, url: str = "url", key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict, and the host's posterior share and its upper bound."""
    spark = pages.sparkSession
    parsed = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    parsed = parsed.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    known = stored(spark, reputations(parsed.select("host", F.col("r.verdict").alias("verdict"))), "reputations")
    # a plain join on a stored table: adaptive execution broadcasts it if small and splits a hot host if not
    out = parsed.join(known.select("host", "share", "upper"), "host")
    return out.select(
        key, "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce(F.col("r.verdict"), F.when(F.round("upper", 9) < LIMIT, "block").otherwise("allow")).alias("verdict"),
        F.round("share", 6).alias("share"), F.round("upper", 6).alias("upper"),
    )
