"""Operator 13: product codes of vectors, by k-means with adaptive distance bounds (Drake and
Hamerly, 2012).

A vector is cut into PARTS consecutive parts, each coded by the nearest of ENTRIES entries of
its position's codebook (squared Euclidean distance of integers, ties to the lower index).
Codebooks start from the vectors with the smallest keys; each round assigns all parts and
moves every used entry to the floor of its parts' mean.

Between rounds every part keeps, in a stored table, its ``b`` closest entries in the order of
their distances with a lower bound each, and one outer bound for all other entries. When the
entries have moved, the bounds give way by as much as they moved. The distance to the part's
own entry is computed exactly; a part whose own distance is under all bounds keeps its entry
without looking further. Else the listed entries that the ordered bounds leave open are
compared, and only if the outer bound is reached all entries; these comparisons are made
with integers, so results don't depend on the bounds. Bounds are stored as 16-bit floats
rounded down, which keeps them bounds. ``b`` follows the depth that the last round needed,
between an eighth and a quarter of the entries.

A round is one pass over the stored table, without a shuffle of vectors: tasks write their
rows and the changes of the sums of parts they moved, the driver gets the added sums (as
many numbers as the codebooks have).

Vectors that are null or hold null, NaN or infinite components are left out. Shorter vectors
count as ending in zeros, and lengths are filled up to a multiple of PARTS. Components are
cut off where sums of squares would leave 64 bits (far above 10,000 for parts of
up to a thousand components). Fewer vectors than ENTRIES give smaller codebooks. Rows with
equal keys, null included (last), are coded each for itself. An empty table gives an empty
result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_tasks, stored
from .groups import with_totals

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Parts in a hundred that a list of b entries should be long enough for.
COVERED = 95


@dataclass
class Books:
    """Entries of every position, (parts, entries, width) integers, and how far each may have
    moved since the table's bounds were made."""

    entries: np.ndarray
    moves: np.ndarray | None = None

    def moved(self, entries: np.ndarray) -> Books:
        far = np.sqrt(((entries - self.entries) ** 2).sum(2, dtype="float64")) * (1 + 1e-9)
        return Books(entries, far)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def all_distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (n, parts, entries) of x (n, parts, width)."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * top * top * max(x.shape[2], 1) < 1 << 53:  # every sum is an integer that doubles hold
        xf, cf = x.astype("float64").transpose(1, 0, 2), entries.astype("float64")
        d = (xf * xf).sum(2)[:, :, None] - 2 * (xf @ cf.transpose(0, 2, 1)) + (cf * cf).sum(2)[:, None, :]
        return d.transpose(1, 0, 2).astype("int64")
    out = np.empty((*x.shape[:2], entries.shape[1]), "int64")
    for k in range(entries.shape[1]):
        out[:, :, k] = ((x - entries[None, :, k]) ** 2).sum(2)
    return out


def down(bounds: np.ndarray) -> np.ndarray:
    """16-bit floats that are not above ``bounds``."""
    short = np.minimum(np.maximum(bounds, 0), 65504).astype("float16")
    return np.where(short > bounds, np.nextafter(short, np.float16(0)), short).astype("float16")


def nearest_lists(d: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From distances (m, entries): the b closest entries in order (ties by index), their
    distances, and the bound of all others."""
    order = np.argsort(d, axis=1, kind="stable")
    near = order[:, :b]
    root = np.sqrt(np.take_along_axis(d, order[:, : b + 1], 1).astype("float64")) * (1 - 1e-9)
    outer = root[:, b] if d.shape[1] > b else np.full(len(d), 65504.0)
    return near, root[:, :b], outer


def reassign(x: np.ndarray, part: np.ndarray, near: np.ndarray, lower: np.ndarray, outer: np.ndarray, books: Books, b: int):
    """One round for parts x (m, width) at positions ``part`` with their lists. Returns the
    new lists (closest first, ``b`` long), bounds, outer bounds, own distances and how many
    listed entries each part had to look at (as many as there are entries: all)."""
    m, width = near.shape
    entries, moves = books.entries, books.moves
    rows = np.arange(m)
    own = ((x - entries[part, near[:, 0]]) ** 2).sum(1)
    bound = lower.astype("float64") - moves[part[:, None], near]
    outer = outer.astype("float64") - moves.max(1, initial=0)[part]
    exact = np.sqrt(own.astype("float64"))
    reach = exact * (1 + 1e-9)
    rest = np.minimum.accumulate(bound[:, ::-1], axis=1)[:, ::-1]  # bounds in order: of this entry and all after it
    open_ = (rest <= reach[:, None]) & (np.arange(width) > 0)
    depth = open_.sum(1)
    whole = outer <= reach
    best, best_at, best_id = own.copy(), np.zeros(m, "int64"), near[:, 0].astype("int64")
    bound[:, 0] = exact * (1 - 1e-9)
    for j in range(1, width):
        some = rows[open_[:, j] & ~whole]
        if len(some):
            ids = near[some, j].astype("int64")
            d = ((x[some] - entries[part[some], ids]) ** 2).sum(1)
            bound[some, j] = np.sqrt(d.astype("float64")) * (1 - 1e-9)
            won = (d < best[some]) | ((d == best[some]) & (ids < best_id[some]))
            wins = some[won]
            best[wins], best_at[wins], best_id[wins] = d[won], j, ids[won]
    depth[whole] = entries.shape[1]
    # lists in the order of their new bounds, the own entry first
    place = bound.copy()
    place[rows, best_at] = -np.inf
    order = np.argsort(place, axis=1, kind="stable")
    near, bound = np.take_along_axis(near, order, 1), np.take_along_axis(bound, order, 1)
    if width > b:
        outer = np.minimum(outer, bound[:, b:].min(1))
    out_near = np.repeat(near[:, :1], b, axis=1).astype("int64")
    out_bound = np.full((m, b), 65504.0)
    keep = min(width, b)
    out_near[:, :keep], out_bound[:, :keep] = near[:, :keep], bound[:, :keep]
    if whole.any():
        d = np.empty((int(whole.sum()), entries.shape[1]), "int64")
        for p in np.unique(part[whole]):
            at = part[whole] == p
            d[at] = all_distances(x[whole][at][:, None], entries[p : p + 1])[:, 0]
        out_near[whole], out_bound[whole], outer[whole] = nearest_lists(d, b)
        best[whole] = d.min(1)
    return out_near, out_bound, outer, best, depth


STATE = ["k", "label", "ints", "b", "near", "lower", "outer"]
TOTALS = ["sums", "counts", "depths"]


def _schema(rows: DataFrame) -> str:
    key, label = (rows.schema[c].dataType.simpleString() for c in ("k", "label"))
    return (f"k {key}, label {label}, ints array<long>, b int, near binary, lower binary, outer binary, "
            "sums array<long>, counts array<long>, depths array<long>")


def _state_rows(columns: list[pa.Array], b: int, near: np.ndarray, lower: np.ndarray, outer: np.ndarray) -> pa.RecordBatch:
    n = len(columns[0])
    lists = [_binary(x.reshape(n, -1)) for x in (near.astype("u1"), down(lower), down(outer))]
    empty = [pa.nulls(n, pa.list_(pa.int64()))] * len(TOTALS)
    return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, b, "int32")), *lists, *empty], names=STATE + TOTALS)


def _totals_row(schema: pa.Schema, sums: np.ndarray, counts: np.ndarray, depths: np.ndarray) -> pa.RecordBatch:
    last = [pa.array([x.ravel().tolist()], pa.list_(pa.int64())) for x in (sums, counts, depths)]
    return pa.RecordBatch.from_arrays([pa.nulls(1, t) for t in schema.types[: len(STATE)]] + last, names=schema.names)


def _binary(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def integers(vectors: DataFrame, vector: str, key: str, label: str) -> tuple[DataFrame, int]:
    """(k, label, ints) of the vectors that are kept, and the length of a part."""
    x = F.col(vector).cast("array<double>")
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.where(fine).select(F.col(key).alias("k"), F.col(label).alias("label"), x.alias("x"))
    longest = kept.agg(F.max(F.size("x"))).first()[0] or 0
    width = max(1, -(-longest // PARTS))
    most = math.isqrt((1 << 62) // width) // 2
    fill = F.array_repeat(F.lit(0.0), F.lit(PARTS * width) - F.size("x"))
    # cut off before the cast; floor of a double is exact
    ints = F.transform(F.concat("x", fill), lambda c: F.floor(F.greatest(F.lit(-float(most)), F.least(F.lit(float(most)), c * SCALE))).cast("bigint"))
    return kept.select("k", "label", ints.alias("ints")), width


def first_books(ints: DataFrame, width: int) -> Books:
    rows = ints.select("k", "ints").orderBy(F.asc_nulls_last("k"), "ints").limit(ENTRIES).collect()
    x = np.array([r["ints"] for r in rows], "int64").reshape(len(rows), PARTS, width)
    return Books(x.transpose(1, 0, 2))


def _flat(batch: pa.RecordBatch, column: int, width: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().astype("int64").reshape(-1, PARTS, width)


def first_round(ints: DataFrame, books: Books, width: int, b: int) -> DataFrame:
    """Every part against all entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = books.entries.shape[1]
        sums, counts = np.zeros((PARTS * entries, width), "int64"), np.zeros(PARTS * entries, "int64")
        schema = None
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().astype("int64").reshape(-1, width)
            n = len(batch)
            near, lower, outer = nearest_lists(all_distances(x.reshape(n, PARTS, width), books.entries).reshape(n * PARTS, entries), b)
            at = np.tile(np.arange(PARTS), n) * entries + near[:, 0]
            for j in range(width):
                np.add.at(sums[:, j], at, x[:, j])
            counts += np.bincount(at, minlength=len(counts))
            yield (done := _state_rows(batch.columns, b, near, lower, outer))
            schema = done.schema
        if schema is not None:
            yield _totals_row(schema, sums, counts, np.zeros(entries + 1, "int64"))

    return ints.mapInArrow(run, _schema(ints))


def next_round(state: DataFrame, books: Books, width: int, b: int) -> DataFrame:
    """Every part by its bounds; sums and counts hold the changes only. Lists start ``b`` long;
    a task goes on with the length that its parts needed so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = books.entries.shape[1]
        sums, counts = np.zeros((PARTS * entries, width), "int64"), np.zeros(PARTS * entries, "int64")
        depths, schema, wanted = np.zeros(entries + 1, "int64"), None, b
        for columns, x, part, near, lower, outer in _lists_of(batches, width):
            near2, lower, outer, _, depth = reassign(x, part, near, lower, outer, books, wanted)
            old, new = part * entries + near[:, 0], part * entries + near2[:, 0]
            gone = old != new
            for j in range(width):
                np.add.at(sums[:, j], new[gone], x[gone, j])
                np.subtract.at(sums[:, j], old[gone], x[gone, j])
            counts += np.bincount(new, minlength=len(counts)) - np.bincount(old, minlength=len(counts))
            yield (done := _state_rows(columns[:3], wanted, near2, lower, outer))
            schema = done.schema
            depths += np.bincount(depth, minlength=len(depths))
            wanted = depth_wanted(depths)
        if schema is not None:
            yield _totals_row(schema, sums, counts, depths)

    return state.mapInArrow(run, _schema(state))


def _lists_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """Stored rows, those with lists of one length at a time: columns, parts, positions, lists,
    bounds, outer bounds."""
    for whole in batches:
        lengths = whole.column(3).to_numpy()
        for b in np.unique(lengths):
            batch = whole.filter(pa.array(lengths == b))
            n = len(batch)
            x = batch.column(2).flatten().to_numpy().astype("int64").reshape(n * PARTS, width)
            near, lower, outer = (b"".join(batch.column(c).to_pylist()) for c in (4, 5, 6))
            near = np.frombuffer(near, "u1").reshape(n * PARTS, b).astype("int64")
            lower = np.frombuffer(lower, "float16").reshape(n * PARTS, b)
            yield batch.columns, x, np.tile(np.arange(PARTS), n), near, lower, np.frombuffer(outer, "float16")


def last_round(state: DataFrame, books: Books, width: int) -> DataFrame:
    """(k, label, code, error) with the final entries."""
    key, label = (state.schema[c].dataType.simpleString() for c in ("k", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, x, part, near, lower, outer in _lists_of(batches, width):
            n = len(columns[0])
            near, _, _, best, _ = reassign(x, part, near, lower, outer, books, 1)
            hexes = pa.array([r.tobytes().hex() for r in near[:, 0].astype("u1").reshape(n, PARTS)], pa.string())
            yield pa.RecordBatch.from_arrays([columns[0], columns[1], hexes, pa.array(best.reshape(n, PARTS).sum(1))], names=["k", "label", "code", "error"])

    return state.mapInArrow(run, f"k {key}, label {label}, code string, error long")


def _added(rows: DataFrame, column: str, n: int) -> np.ndarray:
    """Element-wise sum of an array column; as many numbers as the array has."""
    out = np.zeros(n, "int64")
    parts = rows.where(F.col(column).isNotNull()).select(F.posexplode(column).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    for r in parts.collect():
        out[r["at"]] = r["x"]
    return out


def depth_wanted(depths: np.ndarray) -> int:
    """List length that COVERED of a hundred parts needed, between an eighth and a quarter of
    the entries (an eighth where nothing is known yet)."""
    entries, total = len(depths) - 1, int(depths.sum())
    least, most = max(1, entries // 8), max(1, entries // 4)
    return max(least, min(most, int(np.searchsorted(np.cumsum(depths) * 100, COVERED * total)) + 1)) if total else least


def compress(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, Books]:
    """The codes (key, label, code, error) of all vectors that are kept, and the final codebooks."""
    spark = vectors.sparkSession
    python_tasks(spark)
    ints, width = integers(vectors, vector, key, label)
    books = first_books(ints, width)
    entries = books.entries.shape[1]
    depths = np.zeros(entries + 1, "int64")
    state = stored(spark, first_round(ints, books, width, depth_wanted(depths)), "bounds")
    sums, counts = np.zeros(PARTS * entries * width, "int64"), np.zeros(PARTS * entries, "int64")
    books = books.moved(books.entries)
    for done in range(rounds):
        sums += _added(state, "sums", len(sums))
        counts += _added(state, "counts", len(counts))
        used = counts.reshape(PARTS, entries, 1)
        books = books.moved(np.where(used > 0, sums.reshape(PARTS, entries, width) // np.maximum(used, 1), books.entries))
        if done + 1 < rounds:
            b = depth_wanted(_added(state, "depths", len(depths)))
            state = stored(spark, next_round(state.where("sums is null").select(*STATE), books, width, b), "bounds")
    final = last_round(state.where("sums is null").select(*STATE), books, width)
    return stored(spark, final.withColumnsRenamed({"k": key, "label": label}), "codes"), books


def codes(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """One row per vector: key, label, code, error, label_error, codebooks_sha256."""
    coded, books = compress(vectors, vector, key, label, rounds)
    by_label = coded.groupBy(label).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n"))
    out = with_totals(coded, stored(vectors.sparkSession, by_label, "label_errors"), label, "_n")
    return out.drop("_n").withColumn("codebooks_sha256", F.lit(books.digest()))
