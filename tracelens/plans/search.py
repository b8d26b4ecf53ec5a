"""Full-text search queries (Q25-Q27)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import TimeWindow
from ..functions.text import query_terms
from ..operators.search import match_and_rank, snippet
from .catalog import Catalog
from .common import in_list, in_window, ntz, where


def _matches(cat: Catalog, q: str, role=None, project=None, window: TimeWindow | None = None,
             models=None, hosts=None, keep_orphans: bool = False, analyzer: str = "simple") -> tuple[DataFrame, list[str]]:
    msgs = cat.messages
    if analyzer == "english":
        from ..functions.text import english_query_terms

        terms = english_query_terms(q)
    else:
        terms = query_terms(q)
    index = cat.postings(terms, analyzer)
    counts = cat.term_counts
    if counts is not None:
        counts = counts.filter(F.col("analyzer") == analyzer)
    ranked = match_and_rank(index, cat.corpus_stats, terms, counts=counts)
    m = where(
        msgs.select("uuid", "session_id", "timestamp", "role", "model", "text_content"),
        (F.col("role") == role) if role else None,
        in_window("timestamp", window) if window else None,
        in_list("model", models),
    )
    j = ranked.join(m, "uuid")
    s = cat.sessions.select("session_id", "project_path", F.col("host").alias("s_host"), "cost_e4")
    # J4 (web) is an inner join; J5 (CLI) keeps messages without a session
    j = j.join(s, "session_id", "left" if keep_orphans else "inner")
    j = where(
        j,
        F.col("project_path").ilike(f"%{project}%") if project else None,
        in_list("s_host", hosts),
    )
    return j, terms


def search(cat: Catalog, q: str, role=None, project=None, window=None, models=None, hosts=None,
           limit: int = 50, offset: int = 0, keep_orphans: bool = False, analyzer: str = "simple") -> DataFrame:
    """Q25: messages matching all terms, ranked (BM25, then newest), with snippet."""
    j, terms = _matches(cat, q, role, project, window, models, hosts, keep_orphans, analyzer)
    page = j.orderBy(F.desc("rank"), F.desc("timestamp"), F.asc("uuid")).offset(offset).limit(limit)
    return page.select(
        "uuid", "session_id", ntz("timestamp").alias("timestamp"), "role", "project_path",
        F.col("s_host").alias("host"),
        snippet("text_content", "first_hit", terms, stemmed=analyzer == "english").alias("snippet"),
        (F.col("cost_e4") / F.lit(10000.0)).alias("cost"), "rank",
    )


def count_results(cat: Catalog, q: str, role=None, project=None, window=None, models=None, hosts=None,
                  keep_orphans: bool = False, analyzer: str = "simple") -> DataFrame:
    """Q27: number of matches under the same filters."""
    j, _ = _matches(cat, q, role, project, window, models, hosts, keep_orphans, analyzer)
    return j.agg(F.count(F.lit(1)).alias("n"))


def text_index(cat: Catalog) -> DataFrame:
    """The inverted index over all message texts."""
    return cat.text_index
