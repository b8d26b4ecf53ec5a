"""Operator 12: mixing sources to target weights, by Efraimidis and Spirakis sampling (2006).

Sources in the order of their code points, null last, weigh 1, 2, 3 and so on in turn, and
share as many words as all documents hold. A target stops at MOST times its source's words,
and what it can't take goes to the others by their weights: targets are min(MOST * words,
level * weight) for the one level at which they add up to all words. The level is the
largest of (words left) / (weight left) over the sources sorted by MOST * words / weight.

A source's documents are taken whole as often as its target holds all of them (complete
epochs); the rest of the target is a weighted sample without replacement. Every document
draws -ln(u) / quality with u from a hash of its id, its size and a seed; the documents with the
smallest draws go in, in their order, until prefix sums of their words reach the rest. Of
the document at which they reach it only the words up to there are taken, so a source's
taken words are its target, rounded down.

The quality weight of a document is the share of plain words (letters, with one mark at the end
at most) among its words, at least LEAST_QUALITY; any other positive column may be given.

Null and empty texts have size 0 and are taken with 0 words. Rows with equal doc_id, null
included, are taken each for itself (equal rows draw alike and stand side by side). Extra
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .groups import running_sums, with_totals

WEIGHTS = (1, 2, 3)
MOST = 3
LEAST_QUALITY = 0.05
SEED = 20
BLANKS = r"\x20\x09-\x0D"
WORD = rf"[^{BLANKS}]+"
PLAIN_WORD = rf"(?<![^{BLANKS}])\p{{L}}+[.,;:!?]?(?![^{BLANKS}])"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def plain_share(text: Column, words: Column) -> Column:
    """Quality of a text: the share of plain words, at least LEAST_QUALITY."""
    share = F.regexp_count(text, F.lit(PLAIN_WORD)) / F.when(words > 0, words)
    return F.greatest(F.lit(LEAST_QUALITY), F.coalesce(share, F.lit(0.0)))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size, ...; one row each) with ``target``."""
    one = sources.withColumn("one", F.lit(1).cast("bigint"))
    ranked = running_sums(one, [F.asc_nulls_last("source")], ["one"])
    turn = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("before_one") % len(weights) + 1).cast("int"))
    weighed = ranked.select(*sources.columns, turn.cast("bigint").alias("weight"), (F.col("source_size") * most).alias("cap"))
    filled = running_sums(weighed, [F.col("cap") / F.col("weight"), F.asc_nulls_last("source")], ["cap", "weight"])
    total = filled.agg(F.struct(F.sum("source_size").alias("words"), F.sum("weight").alias("weight"))).scalar()
    level = filled.agg(F.max((total["words"] - F.col("before_cap")) / (total["weight"] - F.col("before_weight")))).scalar()
    target = F.least(F.col("cap").cast("double"), level * F.col("weight"))
    return filled.select(*sources.columns, target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, quality: str | None = None, seed: int = SEED,
        text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per document: key, size, quality, source, source_size, target, draw, taken."""
    spark = docs.sparkSession
    words = docs.select(
        F.col(key).alias("k"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("t"), n_words(F.col(text).cast("string")).alias("size"),
        *([F.col(quality).cast("double").alias("quality")] if quality else []))
    if not quality:
        words = words.withColumn("quality", plain_share(F.col("t"), F.col("size")))
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("k"), F.col("size")), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    drawn = words.select("k", "source", "size", "quality", (-F.log(u) / F.col("quality")).alias("draw"))
    drawn = stored(spark, drawn, "draws")

    sources = drawn.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    goals = targets(stored(spark, sources, "sources"), weights, most)
    ordered = running_sums(drawn, [F.asc_nulls_last("source"), F.col("draw"), F.col("k"), F.col("size")], ["size"])
    starts = ordered.groupBy("source").agg(F.min("before_size").alias("start"))
    goals = goals.join(starts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")

    out = with_totals(ordered, stored(spark, goals, "targets"), "source", "rows")
    budget = F.floor("target")
    all_words = F.when(F.col("source_size") > 0, F.col("source_size"))
    epochs = F.coalesce(F.expr("cast(floor(target) as bigint) div nullif(source_size, 0)"), F.lit(0))
    rest = F.coalesce(budget % all_words, F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("before_size") - F.col("start"))))
    return out.select(
        F.col("k").alias(key), "size", "quality", F.col("source").alias(source), "source_size", "target", "draw",
        (epochs * F.col("size") + part).cast("bigint").alias("taken"))
