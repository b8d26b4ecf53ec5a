"""The canonical table bundle a query plan reads.

``Catalog.from_driver(spark, sf_dir)`` binds the driver tables; ``Catalog.from_tables``
takes already materialised canonical tables (the production path: the ingest job
writes them, queries read them). Derived tables are built lazily and memoised per
catalog object, so a plan that needs sessions twice references one sub-plan.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

from ..operators import derive
from ..session import use_utc
from ..operators.liveness import apply_liveness, session_liveness
from ..sources.driver import bind, hook_events, pull_outcomes
from ..sources.pricing import model_pricing


class Catalog:
    def __init__(self, spark: SparkSession, *, events=None, messages=None, tool_uses=None,
                 tool_results=None, tool_calls=None, sessions=None, usage_daily=None,
                 pricing=None, host_sync_state=None, hooks=None, text_index=None, corpus_stats=None,
                 text_index_english=None, term_counts=None, bound=None):
        use_utc(spark)
        self.spark = spark
        self._bound = bound
        self._given = dict(events=events, messages=messages, tool_uses=tool_uses,
                           tool_results=tool_results, tool_calls=tool_calls, sessions=sessions,
                           usage_daily=usage_daily, pricing=pricing,
                           host_sync_state=host_sync_state, hooks=hooks, text_index=text_index,
                           corpus_stats=corpus_stats, text_index_english=text_index_english, term_counts=term_counts)

    sf_dir: str | None = None

    @classmethod
    def from_driver(cls, spark: SparkSession, sf_dir: str) -> "Catalog":
        c = cls(spark, bound=bind(spark, sf_dir))
        c.sf_dir = sf_dir
        return c

    @classmethod
    def from_tables(cls, spark: SparkSession, **tables: DataFrame) -> "Catalog":
        return cls(spark, **tables)

    def _get(self, name, build):
        v = self._given.get(name)
        if v is None:
            loader = getattr(self, "_loaders", {}).get(name)
            v = loader() if loader is not None else build()
            self._given[name] = v
        return v

    @classmethod
    def from_loaders(cls, spark: SparkSession, **loaders) -> "Catalog":
        """Tables opened on first use (a query touching one table lists only its files)."""
        c = cls(spark)
        c._loaders = loaders
        return c

    @property
    def pricing(self) -> DataFrame:
        return self._get("pricing", lambda: model_pricing(self.spark))

    @property
    def events(self) -> DataFrame:
        return self._get("events", lambda: self._bound.events)

    @property
    def messages(self) -> DataFrame:
        return self._get("messages", lambda: self._bound.messages)

    @property
    def tool_uses(self) -> DataFrame:
        return self._get("tool_uses", lambda: self._bound.tool_uses)

    @property
    def tool_results(self) -> DataFrame:
        return self._get("tool_results", lambda: self._bound.tool_results)

    @property
    def tool_calls(self) -> DataFrame:
        return self._get("tool_calls", lambda: derive.pair_tool_calls(self.tool_uses, self.tool_results))

    @property
    def hooks(self) -> DataFrame | None:
        sf = getattr(self, "sf_dir", None)
        return self._get("hooks", lambda: hook_events(self.spark, sf) if sf else None)

    @property
    def sessions(self) -> DataFrame:
        def build():
            if self._bound is not None and all(self._given.get(k) is None for k in ("events", "messages", "tool_uses")):
                # bound data: events and messages are the same lines (see rollup_sessions_lines)
                # the rollup sorts a task's lines, so its tasks are of a bounded size, however few the files' parts are
                bound = self._bound if self.sf_dir is None else bind(self.spark, self.sf_dir, spread=True)
                s = derive.rollup_sessions_lines(bound.lines, self.pricing)
            else:
                s = derive.rollup_sessions(self.events, self.messages, self.tool_calls, self.pricing)
            if self.hooks is not None:
                s = apply_liveness(s, session_liveness(self.hooks))
            return s

        return self._get("sessions", build)

    @property
    def usage_daily(self) -> DataFrame:
        return self._get("usage_daily", lambda: derive.usage_daily(self.messages, self.sessions))

    @property
    def text_index(self) -> DataFrame:
        from ..operators.search import build_index

        return self._get("text_index", lambda: build_index(self.messages))

    @property
    def text_index_english(self) -> DataFrame:
        from ..operators.search import build_index

        return self._get("text_index_english", lambda: build_index(self.messages, analyzer="english"))

    def postings(self, terms: list[str], analyzer: str) -> DataFrame:
        """The index to look a query's terms up in. An english index that isn't stored is built
        for these terms only (a filter on stems would not get below the stemmer)."""
        from ..operators.search import build_index

        if analyzer == "simple":
            return self.text_index
        if self._given.get("text_index_english") is None and "text_index_english" not in getattr(self, "_loaders", {}):
            return build_index(self.messages, analyzer=analyzer, terms=terms)
        return self.text_index_english

    @property
    def term_counts(self) -> DataFrame | None:
        """Stored document frequencies (analyzer, term, n_t), where the index has such."""
        return self._given.get("term_counts")

    @property
    def corpus_stats(self) -> DataFrame:
        from ..operators.search import corpus_stats

        return self._get("corpus_stats", lambda: corpus_stats(self.messages))

    @property
    def host_sync_state(self) -> DataFrame:
        from ..operators.hosts import host_sync_health

        return self._get(
            "host_sync_state",
            lambda: host_sync_health(pull_outcomes(self.spark, self.sf_dir)),
        )
