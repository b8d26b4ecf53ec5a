"""tracelens: session-log analytics expressed as Spark DataFrame plans.

Layers:
  sources/    readers (JSONL transcripts, side files, pricing, driver-table bindings)
  functions/  Column-level helpers (cost, text, paths, time windows, formatting)
  operators/  DataFrame -> DataFrame operators (derivations, skew-safe windows,
              densify, search index, host health, sinks)
  plans/      the query catalogue (cost, behaviour, sessions, search, hosts, CLI)
  streaming/  Structured Streaming ingest (file source + foreachBatch)
"""

__version__ = "0.1.0"
