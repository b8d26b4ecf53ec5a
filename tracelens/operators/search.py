"""Inverted text index, BM25 ranking and snippets.

The index is a plain table ``(term, uuid, tf, first_pos, doc_len)`` built by one
``posexplode`` and one group-by; stored partitioned/bucketed by term, a lookup for a
few terms prunes to a few files. Global statistics (corpus size, mean length, term
document frequencies) are aggregates; the per-query term table has at most as many
rows as the query has terms, so broadcasting it is bounded by construction.

Ranking is BM25 (Robertson & Zaragoza, 2009) with k1 = 1.2, b = 0.75:
  idf(t) = ln(1 + (N - n_t + 0.5) / (n_t + 0.5))
  score  = sum_t idf(t) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import simple_terms, simple_tokens

K1 = 1.2
B = 0.75


def build_index(docs: DataFrame, key: str = "uuid", text: str = "text_content", analyzer: str = "simple",
                terms: list[str] | None = None, ranged: bool = False) -> DataFrame:
    """(term, key, tf, first_pos, doc_len) for every term of every document.

    ``analyzer='english'`` drops stop words and indexes Porter stems. The stemmer runs
    once per distinct word (the vocabulary), and the word -> stem map is joined back to
    the postings; ``first_pos`` stays a position in the original token list, so snippets
    line up with the text.

    ``terms``: the postings of these index terms only. Other words are dropped before
    anything but the distinct words is shuffled.

    ``ranged``: words are dealt by ranges of (term, key) and grouped where they are, so an
    index that is stored in this order is shuffled once."""
    if analyzer not in ("simple", "english"):
        raise ValueError(f"unknown analyzer {analyzer!r}")
    t = docs.select(key, simple_terms(F.col(text)).alias("terms"))
    # outer: of a plain posexplode the optimizer makes a condition on the array, which splits the text twice
    t = t.select(key, F.size("terms").alias("doc_len"), F.posexplode_outer("terms").alias("pos", "term")).where("pos is not null")
    if terms is not None and analyzer == "simple":
        t = t.filter(F.col("term").isin(terms))
    elif terms is not None:
        # as many words as share a stem with the query's, whatever the size of the corpus
        words = _stems(t).filter(F.col("stem").isin(terms))
        t = t.join(F.broadcast(words), "term").select(key, "doc_len", "pos", F.col("stem").alias("term"))
        analyzer = "simple"
    if ranged:
        t = t.repartitionByRange("term", key)
    postings = t.groupBy("term", key).agg(
        F.count(F.lit(1)).alias("tf"), F.min("pos").alias("first_pos"), F.max("doc_len").alias("doc_len")
    )
    return postings if analyzer == "simple" else stem_postings(postings, key, ranged)


def _stems(words: DataFrame) -> DataFrame:
    """(term, stem) of the distinct words but stop words. The rows leave through a generator:
    conditions on stems stay above it, so the stemmer sees distinct words only."""
    from ..functions.text import ENGLISH_STOP_WORDS, porter_stem_udf
    from ..session import ship_package

    ship_package(words.sparkSession)
    vocab = words.select("term").filter(~F.col("term").isin(ENGLISH_STOP_WORDS)).distinct()
    return vocab.select(F.inline(F.array(F.struct("term", porter_stem_udf("term").alias("stem")))))


def stem_postings(postings: DataFrame, key: str = "uuid", ranged: bool = False) -> DataFrame:
    """The english form of simple postings: stop words dropped, words of one stem merged.
    Positions were counted already, so the vocabulary meets one row per (term, document).
    ``ranged``: as in ``build_index``."""
    stems = postings.join(_stems(postings), "term").select(F.col("stem").alias("term"), key, "tf", "first_pos", "doc_len")
    if ranged:
        stems = stems.repartitionByRange("term", key)
    return stems.groupBy("term", key).agg(
        F.sum("tf").alias("tf"), F.min("first_pos").alias("first_pos"), F.max("doc_len").alias("doc_len"))


def term_counts(postings: DataFrame, analyzer: str) -> DataFrame:
    """Document frequencies of a batch: (analyzer, term, n_t). A uuid is in one batch only, so
    the counts of batches add up."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).select(F.lit(analyzer).alias("analyzer"), "term", "n_t")


def text_totals(docs: DataFrame, text: str = "text_content") -> DataFrame:
    """Number of texts and their total length in tokens: one row that adds up over batches."""
    return docs.select(F.size(simple_terms(F.col(text))).cast("long").alias("dl")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_len"))


def stats_from_totals(totals: DataFrame) -> DataFrame:
    """``corpus_stats`` from the batches' totals."""
    n, length = F.coalesce(F.sum("n_docs"), F.lit(0)), F.sum("total_len")
    return totals.agg(n.alias("n_docs"), (length / F.when(n > 0, n)).alias("avgdl"))


def corpus_stats(docs: DataFrame, text: str = "text_content") -> DataFrame:
    d = docs.select(F.size(simple_terms(F.col(text))).alias("dl"))
    return d.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def match_and_rank(index: DataFrame, stats: DataFrame, terms: list[str], key: str = "uuid", counts: DataFrame | None = None) -> DataFrame:
    """Documents holding *all* terms, with BM25 score and first hit position. With stored
    document frequencies (``counts``: term, n_t, to be added up) the index is read once."""
    if not terms:
        return index.limit(0).select(key, F.lit(0.0).alias("rank"), F.lit(0).alias("first_hit"))
    hits = index.filter(F.col("term").isin(terms))
    one = stats.select(F.struct("n_docs", "avgdl").alias("s")).scalar()  # one subquery
    n_docs, avgdl = one["n_docs"], one["avgdl"]
    if counts is None:
        dfreq = hits.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    else:
        dfreq = counts.filter(F.col("term").isin(terms)).groupBy("term").agg(F.sum("n_t").alias("n_t"))
    idf = F.log(F.lit(1.0) + (n_docs - F.col("n_t") + 0.5) / (F.col("n_t") + 0.5))
    tf = F.col("tf").cast("double")
    part = idf * tf * (K1 + 1) / (tf + K1 * (F.lit(1 - B) + B * F.col("doc_len") / avgdl))
    scored = hits.join(F.broadcast(dfreq), "term").select(key, "term", part.alias("s"), "first_pos")
    g = scored.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum("s").alias("score"), F.min("first_pos").alias("first_hit")
    )
    return g.filter(F.col("n_terms") == len(terms)).select(key, F.round("score", 6).alias("rank"), "first_hit")


def snippet(text: str, first_hit: str, terms: list[str], before: int = 5, width: int = 20,
            stemmed: bool = False) -> F.Column:
    """ts_headline-like fragment: ``width`` tokens from ``before`` tokens ahead of the
    first hit, matches wrapped in <b>...</b> (``stemmed``: tokens match by their Porter
    stem; a page's few tokens are stemmed for it)."""
    toks = simple_tokens(F.col(text))
    start = F.greatest(F.lit(1), F.col(first_hit) + 1 - before)
    window = F.slice(toks, start, F.lit(width))
    tset = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    forms = F.transform(window, F.lower)
    if stemmed:
        from ..functions.text import porter_stems_udf

        forms = porter_stems_udf(forms)
    pairs = F.arrays_zip(window.alias("token"), forms.alias("form"))
    marked = F.transform(pairs, lambda p: F.when(F.array_contains(tset, p["form"]), F.concat(F.lit("<b>"), p["token"], F.lit("</b>"))).otherwise(p["token"]))
    return F.array_join(marked, " ")
