"""Command line: ``python -m tracelens <command> ...`` over a table store.

  backfill  --home DIR --root STORE [--host NAME] [--buckets N]   ingest transcripts + side files
  stats     --root STORE --since 30d                   Q32-Q34 top models/projects/tools
  status    --root STORE                               Q35 store status, Q36 hosts
  sessions  --root STORE [--project P] [--model M]... [--since S] [--sort recent|cost] [--limit N]
  search    --root STORE QUERY [--role user|assistant] [--project P] [--since S] [--limit N] [--simple]
  replay    --root STORE SESSION_PREFIX [--raw]        Q20 (prefix resolved as P8)

Every row of a result is printed; only ``--limit`` shortens a page.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys

SYNC_STATE = "host string, last_pulled_at timestamp, current_interval_hours int, consecutive_errors int"


def _catalog(spark, root, window=None):
    from .operators.sinks import read_or_none
    from .plans.catalog import Catalog
    from .streaming.ingest import open_store

    sync = read_or_none(spark, f"{root.rstrip('/')}/host_sync_state")
    if sync is None:  # hosts that were never pulled
        sync = spark.createDataFrame([], SYNC_STATE)
    store = open_store(spark, root, window)
    names = ["events", "messages", "tool_calls", "sessions", "usage_daily", "text_index", "text_index_english", "corpus_stats", "term_counts"]
    return Catalog.from_tables(spark, **{n: store[n] for n in names}, host_sync_state=sync)


def _print(df, widths: int | None = None) -> None:
    """All rows, one by one as they come."""
    print(" | ".join(df.columns))
    for row in df.toLocalIterator():
        cells = ("" if v is None else str(v) for v in row)
        print(" | ".join(c if widths is None or len(c) <= widths else c[: widths - 3] + "..." for c in cells))


def _since(expr, now):
    from .functions.dates import TimeWindow, parse_since_strict

    return TimeWindow(parse_since_strict(expr, now), now) if expr else None


def main(argv=None, spark=None) -> int:
    p = argparse.ArgumentParser(prog="tracelens")
    sub = p.add_subparsers(dest="cmd", required=True)

    def command(name, *more):
        c = sub.add_parser(name)
        c.add_argument("--root", required=True)
        for flag, kwargs in more:
            c.add_argument(flag, **kwargs)

    from .streaming.ingest import FIRST_BUCKETS

    text, flag = {}, {"action": "store_true"}
    page = lambda n: ("--limit", {"type": int, "default": n})
    command("backfill", ("--home", {"required": True}), ("--host", {"default": "local"}), ("--buckets", {"type": int, "default": FIRST_BUCKETS}))
    command("stats", ("--since", {"required": True}))
    command("status")
    command("sessions", ("--project", text), ("--model", {"action": "append"}), ("--since", text), ("--sort", {"default": "recent"}), page(25))
    command("search", ("query", text), ("--role", text), ("--project", text), ("--since", text), page(20), ("--simple", flag))
    command("replay", ("session", text), ("--raw", flag))
    a = p.parse_args(argv)

    from .session import build_session

    spark = spark or build_session("tracelens-cli")
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    if a.cmd == "backfill":
        from .streaming.ingest import backfill_home

        print(backfill_home(spark, a.home, a.root, host=a.host, buckets=a.buckets))
        return 0
    cat = _catalog(spark, a.root, _since(getattr(a, "since", None), now))
    from .plans import cli, search, sessions

    if a.cmd == "stats":
        since = _since(a.since, now).start
        for title, df in (("Top models", cli.top_models(cat, since)), ("Top projects", cli.top_projects(cat, since)),
                          ("Top tools", cli.top_tools(cat, since))):
            print(f"\n{title} since {a.since}")
            _print(df)
    elif a.cmd == "status":
        _print(cli.store_status(cat))
        _print(cli.host_schedule(cat, now))
    elif a.cmd == "sessions":
        _print(sessions.list_sessions(cat, project=a.project, models=a.model, window=_since(a.since, now), sort=a.sort, limit=a.limit), 60)
    elif a.cmd == "search":
        _print(search.search(cat, a.query, role=a.role, project=a.project, window=_since(a.since, now), limit=a.limit, keep_orphans=True,
                             analyzer="simple" if a.simple else "english"), 120)
    elif a.cmd == "replay":
        ids = [r.session_id for r in sessions.resolve_session_prefix(cat, a.session).collect()]
        if len(ids) != 1:
            print("no such session" if not ids else f"ambiguous prefix: {', '.join(ids)} ...")
            return 1
        if a.raw:
            _print(sessions.session_payloads(cat, ids[0]).orderBy("timestamp", "uuid"))
        else:
            _print(sessions.session_replay(cat, ids[0]).orderBy("timestamp", "uuid"), 140)
    return 0


if __name__ == "__main__":
    sys.exit(main())
