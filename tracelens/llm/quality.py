"""Operator 2: quality by nearest-neighbour voting in a latent-semantic space.

Terms are the shapes of words (runs of letters, digits and marks, so ``THE!!`` is ``A!``; a
word of more than PIECE runs has a shape for every PIECE of them), pairs of adjacent shapes, and how far words and lines repeat. A truncated singular value
decomposition of the labelled sample gives the latent space; the sample's vectors
(at most 2 * PER_CLASS rows of RANK numbers) go to every task. Every document's cosines
with all of them are computed exactly, block by block, and the K nearest vote, each with
the power of its cosine; ties with the K-th all vote.

Only labels outside the held-out fold are seen. Null and empty texts have no terms and get
the share of label 1 in the sample; with no labels at all every score is 1 (keep).
Equal texts get equal scores. Extra columns are not read.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import keep_only, python_tasks, labelled_sample

PER_CLASS = 2000
RANK = 48
K = 25
POWER = 8
THRESHOLD = 0.3
TERMS = 1024
PIECE = 6
EXTRA = 6

_RUN = re.compile(r"[^\W\d_]+|\d+|(\W|_)\1*")


class Shapes(dict):
    """Word -> numbers of its shape terms, one for every PIECE runs of the word."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        parts = []
        for m in _RUN.finditer(word):
            s = m.group()
            if s[0].isdigit():
                parts.append("9")
            elif s[0].isalpha():
                parts.append("A" if s.isupper() and len(s) > 1 else "a")
            else:
                parts.append(s[:2])
        out = tuple(xxhash.xxh32_intdigest("".join(parts[i : i + PIECE])) % TERMS for i in range(0, len(parts), PIECE))
        if len(word) <= 64:  # longer ones hardly come again
            if len(self) > 500_000:
                self.clear()
            self[word] = out
        return out


_SHAPES = Shapes()


def terms(text: str) -> np.ndarray:
    """Unit vector of a text's terms; zero for a text without words."""
    out = np.zeros(TERMS + EXTRA)
    words = text.split()
    if not words:
        return out
    shape = np.fromiter(chain.from_iterable(map(_SHAPES.__getitem__, words)), "int64")
    counts = np.bincount(shape, minlength=TERMS).astype("float64")
    if len(shape) > 1:
        counts += np.bincount((shape[:-1] * 31 + shape[1:] * 7 + 13) % TERMS, minlength=TERMS)
    out[:TERMS] = np.sqrt(counts / counts.sum())
    again = sum(map(operator.eq, words, words[1:])) / len(words)
    lines = [x for x in text.split("\n") if x]
    twice = 1 - len(set(lines)) / max(1, len(lines))
    few = 1 - len(set(words)) / len(words)
    out[TERMS:] = np.sqrt([again, 1 - again, twice / 4, (1 - twice) / 4, few / 4, (1 - few) / 4])
    return out / np.linalg.norm(out)


@dataclass
class Model:
    axes: np.ndarray  # TERMS + EXTRA by RANK
    vectors: np.ndarray  # sample by RANK, unit rows
    y: np.ndarray
    prior: float

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not len(self.y):
            return out
        x = np.stack([terms(t) for t in texts]) @ self.axes
        size = np.linalg.norm(x, axis=1)
        has = size > 1e-12
        # rounded, so that ties don't depend on the block a text came in
        cos = np.round(np.clip((x[has] / size[has, None]) @ self.vectors.T, 0, 1), 6)
        k = min(K, len(self.y))
        kth = np.partition(cos, -k, axis=1)[:, -k]
        vote = np.where(cos >= kth[:, None], cos, 0) ** POWER
        total = vote.sum(1)
        out[has] = np.where(total > 0, vote @ self.y / np.where(total > 0, total, 1), self.prior)
        return np.round(np.clip(out, 0, 1), 6)


def fit(sample: DataFrame) -> Model:
    """sample: (k, t, y), bounded; only vectors of fixed length reach the driver."""
    python_tasks(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(_SHAPES)
        for b in batches:
            x = [terms(t).astype("float32").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(x, pa.binary()), b.column(2)], names=["k", "x", "y"])

    rows = sorted(sample.select("k", "t", "y").mapInArrow(run, "k string, x binary, y int").collect())
    y = np.array([r.y for r in rows], "float64")
    if not len(rows):
        return Model(np.zeros((TERMS + EXTRA, 1)), np.zeros((0, 1)), y, 1.0)
    x = np.stack([np.frombuffer(r.x, "float32") for r in rows]).astype("float64")
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, :RANK]
    v = x @ axes
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return Model(axes, np.where(size > 1e-12, v / np.where(size > 1e-12, size, 1), 0), y, round(float(y.mean()), 6))


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1."""
    python_tasks(docs.sparkSession)
    schema = StructType([*docs.schema, StructField(column, DoubleType())])
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(_SHAPES)
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            s = np.concatenate([shared.value.scores(texts[i : i + 512]) for i in range(0, len(texts), 512)]) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, column])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, fold: int = 0, of: int = 5, label: str = "quality", column: str = "score") -> DataFrame:
    """Fit on ``labels`` and score all of ``docs`` (which has doc_id and text)."""
    return score(docs, fit(labelled_sample(docs, labels, label, fold, of, PER_CLASS)), column=column)
