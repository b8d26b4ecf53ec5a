"""Project path <-> flattened directory name, as Column expressions.

Flattening maps '/' to '-' and '_' to '--'; decoding is lossy for names that held a
'-' (the reference accepts that, the path is for display only).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _swap(s: Column, whole: str, joined: str, part: str, parted: str) -> Column:
    """``whole`` becomes ``joined``; what lies between turns ``part`` into ``parted``."""
    pieces = F.transform(F.split(s, whole), lambda p: F.translate(p, part, parted))
    return F.array_join(pieces, joined)


def flat_to_real_path(flat: Column) -> Column:
    return F.concat(F.lit("/"), _swap(F.regexp_replace(flat, "^-", ""), "--", "_", "-", "/"))


def real_to_flat_path(real: Column) -> Column:
    return F.concat(F.lit("-"), _swap(F.regexp_replace(real, "^/", ""), "_", "--", "/", "-"))


def project_path_from_file(file: Column) -> Column:
    """Decoded project directory of a transcript under ``.claude/projects/<flat>/``; NULL otherwise."""
    flat = F.regexp_extract(file, r"/\.claude/projects/([^/]+)/", 1)
    # as flat_to_real_path: the name has no slash of its own, so two in a row were two dashes
    real = F.replace(F.translate(F.regexp_replace(flat, "^-", ""), "-", "/"), F.lit("//"), F.lit("_"))
    return F.when(flat != "", F.concat(F.lit("/"), real))


def is_sidechain_path(file: Column) -> Column:
    """Sub-agent transcripts live in ``/subagents/agent-<id>.jsonl``."""
    return file.rlike(r"/subagents/agent-[^/]+\.jsonl$")


def agent_id_from_path(file: Column) -> Column:
    a = F.regexp_extract(file, r"/subagents/agent-([^/]+)\.jsonl$", 1)
    return F.when(a != "", a)
