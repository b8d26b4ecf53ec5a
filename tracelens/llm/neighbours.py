"""Operator 6: near-duplicate vectors by NN-descent.

Vectors of one label (and length) are compared by cosine in double precision. Equal vectors
are merged first. Neighbour lists of K start from TREES random-projection trees, whose
leaves are compared pair by pair, and are refined by joining neighbours of neighbours:
every vector brings its neighbours, and those it is a neighbour of, together, and pairs
closer than the end of either list enter it. Rounds end when hardly any list changes.

A list whose K entries all reach the threshold is saturated: it says that there are more.
Saturated vectors are compared with all saturated ones of their label, block by block;
blocks give back counts and the links that join components, never all pairs. (A link to a
vector whose list isn't saturated is in that list.) At last unsaturated vectors are audited
against all of their labels, until AUDIT vectors with links are seen or none is left. While
less than TARGET of a vector's links are found on average, more trees and rounds follow;
after ATTEMPTS of them all vectors of the labels that lost links are compared block by
block, and if the other labels still fail the audit, those of all labels.

Null labels, null or zero vectors and null or non-finite components link with nothing. Rows
with equal keys and vectors count once. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import python_tasks, stored
from .components import components

THRESHOLD = 0.98
K = 16
TREES = 4
BITS = 24
LEAF = 192
ROUNDS = 4
BLOCK = 1024
AUDIT = 512
ASKED = 4096
TARGET = 0.999
ATTEMPTS = 3


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that squares can't overflow."""
    x = rows.astype("float64")
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one node at a time, from batches sorted by their first column."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        ids = held.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist()]
        for x, y in zip(edges, edges[1:], strict=False):
            yield held.slice(x, y - x).combine_chunks()
        held = held.slice(edges[-1])
    if held is not None:
        yield held.combine_chunks()


def pairs_schema(u: np.ndarray, v: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u.astype("int64")), pa.array(v.astype("int64")), pa.array(sim.astype("float64"))], names=["u", "v", "sim"])


PAIRS = "u long, v long, sim double"


def col(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name).combine_chunks()
    return c.chunk(0) if isinstance(c, pa.ChunkedArray) else c


class Descent:
    def __init__(self, vectors: DataFrame, threshold: float, label: str, vec: str, key: str):
        self.spark, self.threshold = vectors.sparkSession, threshold
        python_tasks(self.spark)
        good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
        self.rows = vectors.select(
            F.col(key).alias("id"),
            F.when(F.col(label).isNotNull() & F.col(key).isNotNull() & good, F.concat_ws(":", F.col(label).cast("string"), F.size(vec).cast("string"))).alias("g"),
            F.col(vec).alias("x"),
        )
        equal = self.rows.where("g is not null").select("id", "g", "x").distinct().groupBy("g", "x").agg(F.min("id").alias("id"), F.count("*").alias("mult"))
        self.reps = stored(self.spark, equal, "vectors")
        self.size = stored(self.spark, self.reps.groupBy("g").agg(F.count("*").alias("of")), "labels")

    def trees(self, first: int) -> DataFrame:
        """Pairs (u, v, sim): each vector's K nearest in its leaf of each tree."""

        def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [np.asarray(x, "float64") for x in b.column(2).to_pylist()]
                out = np.zeros((len(rows), TREES), "int64")
                for size in {len(r) for r in rows}:
                    at = [i for i, r in enumerate(rows) if len(r) == size]
                    x = unit(np.stack([rows[i] for i in at]))
                    for t in range(TREES):
                        planes = np.random.default_rng((first + t, size)).standard_normal((size, BITS))
                        out[at, t] = (x @ planes > 0) @ (1 << np.arange(BITS)[::-1])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out.tolist(), pa.list_(pa.int64()))], names=["id", "g", "x", "signs"])

        kind = self.reps.schema["x"].dataType.simpleString()
        rows = self.reps.select("id", "g", "x").mapInArrow(signs, f"id long, g string, x {kind}, signs array<long>").join(self.size, "g")
        bits = F.least(F.lit(BITS), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("of") / LEAF))).cast("int"))
        rows = rows.select("id", "g", "x", bits.alias("bits"), F.posexplode("signs").alias("tree", "sign"))
        rows = rows.withColumn("leaf", F.xxhash64("g", "tree", F.expr(f"shiftright(sign, {BITS} - bits)")))
        rows = stored(self.spark, rows.select("leaf", "id", "x"), "leaves")
        large = stored(self.spark, rows.groupBy("leaf").agg(F.count("*").alias("n")), "leaf_sizes")
        # a leaf much larger than planned holds a dense group: its random parts make the first lists
        part = F.pmod(F.xxhash64("id", "leaf"), F.ceil(F.col("n") / (2 * LEAF)))
        rows = rows.join(large, "leaf").select(F.xxhash64("leaf", part).alias("node"), "id", "x")

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in nodes(batches):
                if len(t) > 1:
                    ids, x = col(t, "id").to_numpy(), unit(matrix(col(t, "x")))
                    sim = x @ x.T
                    np.fill_diagonal(sim, -2)
                    k = min(K, len(ids) - 1)
                    best = np.argpartition(sim, -k, axis=1)[:, -k:]
                    yield pairs_schema(np.repeat(ids, k), ids[best].ravel(), np.take_along_axis(sim, best, 1).ravel())

        return rows.repartition("node").sortWithinPartitions("node").mapInArrow(nearest, PAIRS)

    def lists(self, pairs: DataFrame) -> DataFrame:
        """The K nearest of each vector among ``pairs``."""
        best = pairs.groupBy("u", "v").agg(F.max("sim").alias("sim"))
        rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
        return stored(self.spark, best.withColumn("r", rank).where(f"r <= {K}").drop("r"), "lists")

    def round(self, now: DataFrame, number: int) -> DataFrame:
        """Pairs closer than the end of a list, among neighbours of a common vector."""
        into = now.select(F.col("v").alias("center"), F.col("u").alias("id"))
        few = F.row_number().over(Window.partitionBy("center").orderBy(F.xxhash64("id", "center", F.lit(number)), "id"))
        into = into.withColumn("r", few).where(f"r <= {K}").drop("r")
        members = now.select(F.col("u").alias("center"), F.col("v").alias("id")).unionByName(into).distinct()
        last = now.groupBy("u").agg(F.when(F.count("*") >= K, F.min("sim")).otherwise(F.lit(-2.0)).alias("last")).withColumnRenamed("u", "id")
        known = stored(self.spark, self.reps.select("id", "x").join(last, "id"), "ends")
        rows = members.join(known, "id").select("center", "id", "x", "last")

        def closer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in nodes(batches):
                if len(t) > 1:
                    ids, x, last = col(t, "id").to_numpy(), unit(matrix(col(t, "x"))), col(t, "last").to_numpy()
                    sim = x @ x.T
                    np.fill_diagonal(sim, -3)
                    a, b = np.nonzero(sim > last[:, None])
                    if len(a):
                        yield pairs_schema(ids[a], ids[b], sim[a, b])

        return rows.repartition("center").sortWithinPartitions("center").mapInArrow(closer, PAIRS).distinct()

    def descend(self, pairs: DataFrame) -> DataFrame:
        now = self.lists(pairs)
        for number in range(ROUNDS):
            new = self.lists(now.unionByName(self.round(now, number)))
            changed = new.join(now.select("u", "v"), ["u", "v"], "left_anti").count()
            now = new
            if changed < 0.002 * max(1, now.count()):
                break
        return now

    def dense(self, full: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Saturated vectors (id) -> (id, n): linked saturated vectors, copies counted; and
        (u, v) links that join their components."""
        threshold = self.threshold
        rows = full.join(self.reps, "id").select("g", "id", "x", "mult")
        rows = stored(self.spark, rows, "saturated")
        count = stored(self.spark, rows.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "saturated_labels")
        rows = rows.join(count, "g")
        asked = rows.select("g", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("asks"), "id", "x", "mult")
        held = rows.select("g", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), F.lit(0).alias("asks"), "id", "x", "mult")
        rows = held.unionByName(asked).select(F.xxhash64("g", "block").alias("node"), "asks", "id", "x", "mult")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A block's members come first; then questions stream by, batch after batch."""
            node, members, of, ids, root = None, [], np.zeros((0, 1)), np.zeros(0), []

            def find(i: int) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for b in batches:
                t = pa.Table.from_batches([b])
                keys = t.column("node").to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
                for lo, hi in zip(edges, edges[1:], strict=False):
                    if hi == lo:
                        continue
                    part = t.slice(lo, hi - lo).combine_chunks()
                    if keys[lo] != node:
                        node, members, ids = keys[lo], [], np.zeros(0, "int64")
                    asks = col(part, "asks").to_numpy()
                    split = int(np.searchsorted(asks, 1))
                    if split:
                        members.append((col(part, "id").to_numpy()[:split], unit(matrix(col(part, "x")))[:split], col(part, "mult").to_numpy()[:split]))
                        ids, of = np.concatenate([m[0] for m in members]), np.concatenate([m[1] for m in members])
                        mult, root = np.concatenate([m[2] for m in members]), [*range(len(ids))]
                    if split == hi - lo or not len(ids):
                        continue
                    who, x = col(part, "id").to_numpy()[split:], unit(matrix(col(part, "x")))[split:]
                    near = (x @ of.T >= threshold) & (who[:, None] != ids[None, :])
                    n, u, v = near @ mult, [], []
                    for i in np.flatnonzero(near.any(1)):
                        classes = {find(j): j for j in np.flatnonzero(near[i]).tolist()}
                        first = min(classes)
                        for r, j in classes.items():
                            root[r] = first
                            u.append(who[i])
                            v.append(ids[j])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([who, np.array(u, "int64")])), pa.array([None] * len(who) + [int(j) for j in v], pa.int64()),
                         pa.array(np.concatenate([n, np.zeros(len(u))]).astype("int64"))], names=["id", "v", "n"])

        told = rows.repartition("node").sortWithinPartitions("node", "asks").mapInArrow(compare, "id long, v long, n long")
        told = stored(self.spark, told, "dense_links")
        return (told.where("v is null").groupBy("id").agg(F.sum("n").alias("n")), told.where("v is not null").select(F.col("id").alias("u"), "v"))

    def found(self, now: DataFrame, exact: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(id, n): linked vectors, copies counted; links (a, b) that span the components; and
        (id) of the vectors that were compared in blocks: saturated ones, and all of the labels
        for which ``exact`` holds."""
        links = now.where(F.col("sim") >= self.threshold)
        full = links.groupBy("u").agg(F.count("*").alias("k")).where(f"k >= {K}").select(F.col("u").alias("id"))
        if exact is not None:
            full = full.unionByName(self.reps.where(exact).select("id")).distinct()
        full = stored(self.spark, full, "full")
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        both = both.join(full.select(F.col("id").alias("u"), F.lit(True).alias("fu")), "u", "left").join(full.select(F.col("id").alias("v"), F.lit(True).alias("fv")), "v", "left")
        sparse = both.where("fu is null or fv is null").join(self.reps.select(F.col("id").alias("v"), "mult"), "v").groupBy("u").agg(F.sum("mult").alias("n"))
        counts, spanning = sparse.select(F.col("u").alias("id"), "n"), links.select(F.col("u").alias("a"), F.col("v").alias("b"))
        if not full.isEmpty():
            n, more = self.dense(full)
            counts, spanning = counts.unionByName(n), spanning.unionByName(more.select(F.col("u").alias("a"), F.col("v").alias("b")))
        return stored(self.spark, counts.groupBy("id").agg(F.sum("n").alias("n")), "counts"), spanning, full

    def recall(self, counts: DataFrame, full: DataFrame) -> tuple[float, list[str]]:
        """Mean share of their links that AUDIT vectors found, and the labels under TARGET. Asked
        are vectors outside ``full`` that have links: more and more are compared with all of
        their label, until AUDIT such vectors are seen or none is left."""
        risk = self.reps.join(full, "id", "left_anti").select("id", "g", "x", F.xxhash64("id").alias("h"))
        risk = stored(self.spark, risk, "at_risk")
        shares: dict[str, list[float]] = {}
        size, seen, last = AUDIT, 0, None
        while seen < AUDIT:
            rest = risk if last is None else risk.where((F.col("h") > last.h) | (F.col("h") == last.h) & (F.col("id") > last.id))
            sample = rest.orderBy("h", "id").limit(size).collect()  # bounded
            if not sample:
                break
            label = {r.id: r.g for r in sample}
            for r in self.true_links(sample).join(counts, "id", "left").select("id", "links", F.coalesce("n", F.lit(0)).alias("n")).where("links > 0").collect():
                shares.setdefault(label[r.id], []).append(min(r.n, r.links) / r.links)
                seen += 1
            last, size = sample[-1], min(4 * size, ASKED)
        every = [x for own in shares.values() for x in own]
        return (sum(every) / len(every) if every else 1.0), sorted(g for g, own in shares.items() if sum(own) < TARGET * len(own))

    def true_links(self, sample: list) -> DataFrame:
        """(id, links): links of the sample's vectors among all of their label, copies counted."""
        by: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for g in {r.g for r in sample}:
            own = [r for r in sample if r.g == g]
            by[g] = np.array([r.id for r in own]), unit(np.array([r.x for r in own]))
        threshold = self.threshold

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, int] = {}
            for b in batches:
                g, ids, mult = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy(), b.column(3).to_numpy()
                for name in {*g} & by.keys():
                    at = np.flatnonzero(g == name)
                    who, x = by[name]
                    near = (x @ unit(matrix(b.column(2).take(pa.array(at)))).T >= threshold) & (who[:, None] != ids[at][None, :])
                    for i, n in zip(who.tolist(), (near @ mult[at]).tolist(), strict=True):
                        total[i] = total.get(i, 0) + int(n)
            yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int64()), pa.array([*total.values()], pa.int64())], names=["id", "n"])

        return self.reps.select("g", "id", "x", "mult").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("links"))

    def run(self) -> DataFrame:
        now = self.descend(self.trees(0))
        for attempt in range(1, ATTEMPTS + 1):
            counts, spanning, full = self.found(now)
            recall, failing = self.recall(counts, full)
            if recall >= TARGET:
                break
            if attempt < ATTEMPTS:
                now = self.descend(now.unionByName(self.trees(attempt * TREES)))
        else:
            # the labels that lost links in the audit; where others do so, too, all labels
            counts, spanning, full = self.found(now, F.col("g").isin(failing))
            if self.recall(counts, full)[0] < TARGET:
                counts, spanning, full = self.found(now, F.lit(True))
        joined = components(spanning)
        known = self.reps.join(counts, "id", "left").join(joined, "id", "left").select(
            "g", "x", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n"), F.coalesce("component", "id").alias("c"))
        known = stored(self.spark, known, "known")
        some = self.rows.where("g is not null").join(known, ["g", "x"]).select("id", "n", "c")
        return some.unionByName(self.rows.where("g is null").select("id", F.lit(0).cast("bigint").alias("n"), F.col("id").alias("c")))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, label: str = "label", vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row per vector: key, n_links, component_id (least key) and kept."""
    out = Descent(vectors, threshold, label, vec, key).run()
    return out.select(F.col("id").alias(key), F.col("n").alias("n_links"), F.col("c").alias("component_id"), F.coalesce(F.col("id") == F.col("c"), F.lit(True)).alias("kept"))
