"""Operator 3: concatenate and cut.

Pass one tokenises every document once and writes ids, the partition's number and the
document's start within the partition (a running sum along the task). Pass two adds up
the partition totals: their prefix sums turn each start into a global offset. Windows of
fixed length then cut the stream of ids; a document that meets a window's edge gives one
piece to each side. Only the last sequence can be short, so nothing else is padded.

The tokeniser drops white space and splits at it, so a text is cut at blanks and line
ends, and each distinct word is tokenised once per worker.

Null and empty texts hold only the end id. Documents keep the input's order; equal rows
are packed each for itself. Extra columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep_only, python_tasks, stored

SEQUENCE = 2048
END_ID = 1
TABLE_ENTRIES = 600_000
#: ASCII marks that the tokeniser always parts from the letters before them.
TAIL = ".,;:!?*&%$#|"

_TABLES: dict[str, WordTable] = {}


class WordTable(dict):
    """Word (no blank or line end in it) -> its ids as bytes."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(tokenizer_file)

    def __missing__(self, word: str) -> bytes:
        stem = word.rstrip(TAIL)
        # letters, then marks: two parts for the tokeniser, unless lower-casing makes a mark of a letter
        if len(stem) < len(word) and stem.isalpha() and (stem.isascii() or stem.lower().isalpha()):
            ids = self[stem] + self[word[len(stem) :]]
        elif word.isascii() and word.isalpha() and not word.islower():
            ids = self[word.lower()]
        else:
            found = self.tokenizer.encode_batch_fast([word], add_special_tokens=False)[0].ids
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(word) < 64:
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        out = b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))
        if len(self) > TABLE_ENTRIES:
            self.clear()
            self[""] = b""
        return out


def word_table(tokenizer_file: str) -> WordTable:
    if tokenizer_file not in _TABLES:
        _TABLES[tokenizer_file] = WordTable(tokenizer_file)
    return _TABLES[tokenizer_file]


def tokenised(docs: DataFrame, tokenizer_file: str, text: str = "text", key: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """key, ids (binary, end id last), n, part and the start within the part."""
    python_tasks(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(_TABLES)
        table, part, at = word_table(tokenizer_file), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = [table.ids(t or "") + end for t in batch.column(1).to_pylist()]
            n = np.array([len(b) // 4 for b in ids], "int64")
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(n), pa.array(np.full(len(n), part, "int64")), pa.array(starts)],
                names=["k", "ids", "n", "part", "at"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(
        run, f"k {kind}, ids binary, n long, part long, at long"
    ).withColumnRenamed("k", key)


def pack(docs: DataFrame, tokenizer_file: str, text: str = "text", key: str = "doc_id", length: int = SEQUENCE) -> DataFrame:
    """One row per piece: key, start, length, ids (binary), doc_tokens, sequence_id, offset."""
    tokens = stored(docs.sparkSession, tokenised(docs, tokenizer_file, text, key), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    # one row per task of the pass above, far less than the driver itself keeps of a task
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    placed = tokens.join(F.broadcast(base), "part").withColumn("g", F.col("base") + F.col("at"))
    pieces = F.expr(f"""
        transform(sequence(g div {length}, (g + n - 1) div {length}), w -> named_struct(
            'start', greatest(w * {length}, g) - g,
            'length', least((w + 1) * {length}, g + n) - greatest(w * {length}, g),
            'ids', substring(ids, cast((greatest(w * {length}, g) - g) * 4 + 1 as int),
                             cast((least((w + 1) * {length}, g + n) - greatest(w * {length}, g)) * 4 as int)),
            'doc_tokens', n,
            'sequence_id', w,
            'offset', greatest(w * {length}, g) - w * {length}))""")
    return placed.select(key, F.inline(pieces))
