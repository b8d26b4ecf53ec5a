"""Operator 10: SentencePiece encoding and decoding through a distinct-chunk table.

No piece of the model holds the whitespace marker after another character (checked when
the model is loaded), so no merge can cross from a word into the next marker. A text is
therefore cut before every run of markers, each distinct marked chunk is segmented once
per worker, and the ids are joined back by position.

Null texts count as empty: no ids but begin and end. Ids come as little-endian unsigned
32-bit binary. Extra columns are not read; rows with equal doc_id are kept apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_tasks

MARK = "▁"
#: Entries of a worker's chunk table; a full table is emptied, never trusted beyond that.
TABLE_ENTRIES = 600_000

_RUNS = re.compile(" +[^ ]*")
_TABLES: dict[str, ChunkTable] = {}


class ChunkTable(dict):
    """Chunk -> its ids as bytes. The key omits the first marker of the chunk, which is
    the one that the library itself puts before a text."""

    def __init__(self, model_file: str):
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        for i in range(self.model.get_piece_size()):
            if MARK in self.model.id_to_piece(i).lstrip(MARK):
                raise ValueError(f"piece {i} crosses a whitespace marker: chunks would not be independent")
        self[""] = np.array([self.model.piece_to_id(MARK)], "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.model.encode(chunk), "<u4").tobytes()
        if len(chunk) < 64:  # longer ones hardly come twice
            self[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            chunks = [c[1:] for c in _RUNS.findall(" " + text)]
        else:
            chunks = text.split(" ")
        out = b"".join(map(self.__getitem__, chunks))
        if len(self) > TABLE_ENTRIES:
            mark = self[""]
            self.clear()
            self[""] = mark
        return out


def chunk_table(model_file: str) -> ChunkTable:
    if model_file not in _TABLES:
        _TABLES[model_file] = ChunkTable(model_file)
    return _TABLES[model_file]


def encode_decode(docs: DataFrame, model_file: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, ``ids`` (binary, with begin and end) and ``decoded``."""
    python_tasks(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(model_file)
        first, last = (np.array([i], "<u4").tobytes() for i in (table.model.bos_id(), table.model.eos_id()))
        for batch in batches:
            ids = [first + table.ids(t or "") + last for t in batch.column(1).to_pylist()]
            decoded = [table.model.decode(np.frombuffer(b, "<u4").tolist()) for b in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=["k", "ids", "decoded"]
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(
        run, f"k {kind}, ids binary, decoded string"
    ).withColumnRenamed("k", key)
