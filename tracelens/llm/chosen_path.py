"""Operator 7: near-duplicates by chosen-path set similarity join.

A document's set holds the hashes of its 5-word shingles. Equal sets are merged first.
In each of several independent trees a set follows paths: at every node one or two positions
of its minhash signature are chosen (1 / threshold on average, the same for all sets at the
node), and the set goes on to the child named by its value there. Nodes of one set are
dropped, nodes of up to LEAF sets are compared pair by pair on their signatures, and the
others branch again: a pair below the threshold shares less than one child on average, so
deeper nodes part it, and what stays together are copies.

Below the first level several levels are made in one step: a path depends on its own set
only, and large nodes on the way are skipped, as their children cover them.

Groups of copies are joined before that. A few trees (GATHER) cut the large nodes of their
second level into blocks that share two pivots, and the links found make components. The
other trees carry a set's component: a node of one component is dropped, one with up to LEAF sets outside its
main component is compared outsiders against all, in blocks, and no pair inside a component
is looked at again. So a group of n copies costs about n pairs, and a group of n documents
that are alike below the threshold (one template) costs about n too. What is still large
after DEPTH levels is compared whole, as pairs of blocks, each once.

The number of trees follows from the threshold and TARGET: the chance that a pair at the
threshold loses its common path within SHALLOW levels, where ordinary documents end. Nodes
still large there go on as RESTARTS independent subtrees. Each run is audited: AUDIT sets are
compared with all others, and more trees follow while links between different components
are missing in more than 1 - TARGET of the sets that have links.

A node with many alike pairs gives back a spanning forest of them, the most alike first.
Once these are confirmed, nodes that still hold several components are compared on full
sets in place, so that the pairs of a template, alike but not alike enough, never leave
their node.

Pairs that the signatures don't rule out are confirmed on full sets: first a few candidates
of each set (the most alike, the least, and two by hash), then, without the pairs whose
ends are joined by then, all others, so that a group of n copies costs about n
confirmations.
Signatures only rule out a pair more than four deviations below the threshold.

Words are runs of bytes other than white space, A-Z lower-cased. Fewer than five words make
one shingle; no words or null text make the empty set, linked with nothing. Rows with a
null key are linked with nothing; rows with equal keys share their fate. Extra columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_only, python_tasks, stored
from .components import joined_components

WORDS = 5
SIGNATURE = 128
#: Sets of a node that are compared pair by pair, and of a block of a larger node.
LEAF = 32
BLOCK = 128
HELD = 256
GATHER = 3
#: Levels that are made at once below the first SHALLOW ones.
STEP = 4
SHALLOW, DEPTH, RESTARTS = 4, 20, 3
#: Recall of a pair at the threshold, sets in the audit, and batches of trees at most.
TARGET = 0.999
AUDIT = 64
BATCHES = 3
ROUNDS = 1
#: Ids of sets to confirm are broadcast up to this many (16 MB), and joined beyond.
BROADCAST_IDS = 1_000_000

_ODD = (np.random.default_rng(7).integers(0, 1 << 62, SIGNATURE, dtype="uint64") << np.uint64(1)) | np.uint64(1)
_MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], "uint64")


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 600_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_WORDS = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    words = (text or "").encode().lower().split()  # bytes: ASCII case and ASCII white space only
    if not words:
        return np.zeros(0, "uint64")
    h = np.fromiter(map(_WORDS.__getitem__, words), "uint64", len(words))
    if len(h) < WORDS:
        return mixed((h * _MULTIPLY[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    n = len(h) - WORDS + 1
    return np.unique(mixed(reduce(np.add, (h[i : i + n] * _MULTIPLY[i] for i in range(WORDS)))))


def signature(s: np.ndarray) -> np.ndarray:
    least = np.full(SIGNATURE, np.iinfo("uint64").max, "uint64")
    for i in range(0, len(s), 2048):
        np.minimum(least, (s[i : i + 2048, None] * _ODD).min(0), out=least)
    return (mixed(least) >> np.uint64(48)).astype("uint16").view("int16")


def sketches(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(id, n, k1, k2, sig): size, 128-bit digest and signature of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(_WORDS)
        for b in batches:
            sets = [shingles(t) for t in b.column(1).to_pylist()]
            digest = np.frombuffer(b"".join(xxhash.xxh128_digest(s.tobytes()) for s in sets), "int64").reshape(-1, 2)
            sig = np.stack([signature(s) for s in sets]) if sets else np.zeros((0, SIGNATURE), "int16")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]),
                 pa.ListArray.from_arrays(np.arange(0, sig.size + 1, SIGNATURE, dtype="int32"), sig.ravel())],
                names=["id", "n", "k1", "k2", "sig"],
            )

    return docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(
        run, "id long, n long, k1 long, k2 long, sig array<short>")


def second(percent: int) -> int:
    """How often (in percent) a node chooses a second position."""
    return (10_000 - 100 * percent) // percent


def trees(percent: int, depth: int, target: float) -> int:
    """Trees that find a pair at the threshold with the target chance, ``depth`` levels down:
    the pair's common paths are a branching process."""
    p, two, lost = percent / 100, second(percent) / 100, 0.0
    for _ in range(depth):
        child = 1 - p + p * lost  # a chosen position differs, or its subtree loses the pair
        lost = (1 - two) * child + two * child**2
    return math.ceil(math.log(1 - target) / math.log(lost)) if 0 < lost < 1 else 1


def children(path: Column, percent: int) -> Column:
    """The node's children for a set: the chosen positions with the set's values there."""
    one = F.pmod(F.xxhash64(path, F.lit(1)), F.lit(SIGNATURE)).cast("int")
    two = F.pmod(F.xxhash64(path, F.lit(2)), F.lit(SIGNATURE)).cast("int")
    at = F.when(F.pmod(F.xxhash64(path, F.lit(3)), F.lit(100)) < second(percent), F.array_distinct(F.array(one, two))).otherwise(F.array(one))
    return F.transform(at, lambda c: F.xxhash64(path, c, F.get("sig", c)))


def descent(percent: int, levels: int) -> Column:
    """A set's nodes (path, last) below ``path`` on each of the next levels; a path depends
    on the set's signature only, so several levels take one step."""
    paths, out = F.array("path"), []
    for left in reversed(range(levels)):
        paths = F.flatten(F.transform(paths, lambda p: children(p, percent)))
        last = F.lit(left == 0).alias("last")
        out.append(F.transform(paths, lambda p: F.struct(p.alias("path"), last)))
    return F.concat(*out)


PAIRS = "a long, b long, alike int"
RANGE = 1 << 15
#: Sides of a node's rows: HOLD rows are only compared with others, ASK rows with HOLD and
#: ASK rows, CROSS rows with HOLD rows.
HOLD, ASK, CROSS = 0, 1, 2


def overlaps(sets: list[np.ndarray], asks: np.ndarray) -> np.ndarray:
    """Intersection sizes of the asking sets with all sets (sorted hashes), by ranges of
    hashes: a range's 0/1 matrix has about RANGE columns at most."""
    both = np.zeros((len(asks), len(sets)), "int64")
    ranges = 1 + sum(map(len, sets)) // RANGE
    bounds = np.array([(i << 64) // ranges for i in range(1, ranges)], "uint64")
    cuts = [np.concatenate([[0], np.searchsorted(s, bounds), [len(s)]]) for s in sets]
    for r in range(ranges):
        parts = [s[c[r] : c[r + 1]] for s, c in zip(sets, cuts, strict=True)]
        names, at = np.unique(np.concatenate(parts), return_inverse=True)
        held = np.zeros((len(sets), len(names)), "float32")
        held[np.repeat(np.arange(len(sets)), [len(x) for x in parts]), at] = 1
        both += (held[asks] @ held.T).astype("int64")
    return both


def compare_nodes(rows: DataFrame, percent: int, least: int) -> DataFrame:
    """rows (node, id, c, side, n, sig[, s]) -> pairs (a, b, alike) of different components,
    node by node. Without full sets ``s``, candidates: of nodes with more than four pairs a
    row only a spanning forest over the components, and a row (node, null, null) that says
    so. With them, a spanning forest of the links."""
    columns = ["node", "id", "c", "side", "n", "sig", *(["s"] if "s" in rows.columns else [])]
    rows = rows.select(*columns)

    def pairs(at: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, c, side, sig, found = at["n"], at["c"], at["side"], at["sig"], []
        hold, later = side == HOLD, side == ASK
        for i in np.flatnonzero(~hold):
            later[i] = False  # asking rows before it were compared with it
            fits = (hold | later) if side[i] == ASK else hold
            j = np.flatnonzero(fits & (c != c[i]) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * percent))
            alike = (sig[j] == sig[i]).sum(1)
            j, alike = j[alike >= least], alike[alike >= least]
            found.append((np.full(len(j), i), j, alike))
        return tuple(np.concatenate(x).astype("int64") for x in zip(*found, strict=True)) if found else (np.zeros(0, "int64"),) * 3

    def spanning(c: np.ndarray, p: np.ndarray, q: np.ndarray, alike: np.ndarray) -> np.ndarray:
        """Of the pairs, those of a spanning forest over components, the most alike first."""
        names, of = np.unique(c, return_inverse=True)
        root, out = [*range(len(names))], []

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for k in np.argsort(-alike, kind="stable").tolist():
            x, y = find(of[p[k]]), find(of[q[k]])
            if x != y:
                root[x] = y
                out.append(k)
        return np.array(out, "int64")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for b in with_end(batches):
            if b is not None and b.num_rows:
                now = {x: b.column(i).to_numpy(zero_copy_only=False) for i, x in enumerate(columns) if x != "sig"}
                now["sig"] = b.column(columns.index("sig")).flatten().to_numpy(zero_copy_only=False).reshape(-1, SIGNATURE)
                held = now if held is None else {x: np.concatenate([held[x], now[x]]) for x in now}
            if held is None or (b is not None and not b.num_rows):
                continue
            size = len(held["node"])
            edges = (np.flatnonzero(np.diff(held["node"])) + 1).tolist()
            last = size if b is None else (edges[-1] if edges else 0)  # the last node may go on
            bounds = [0, *(e for e in edges if e < last), last]
            out: list[tuple] = []
            for x, y in zip(bounds, bounds[1:], strict=False):
                if y - x < 2:
                    continue
                at = {k: v[x:y] for k, v in held.items()}
                p, q, alike = pairs(at)
                if "s" in at and len(p):
                    asks, at_ask = np.unique(p, return_inverse=True)
                    both = overlaps([np.frombuffer(z, "uint64") for z in at["s"]], asks)[at_ask, q]
                    linked = 100 * both >= percent * (at["n"][p] + at["n"][q] - both)
                    p, q, alike = p[linked], q[linked], alike[linked]
                    keep = spanning(at["c"], p, q, alike)
                    p, q, alike = p[keep], q[keep], alike[keep]
                elif len(p) > 4 * (y - x):
                    keep = spanning(at["c"], p, q, alike)
                    p, q, alike = p[keep], q[keep], alike[keep]
                    out.append(([at["node"][0]], [None], [None]))
                u, v = at["id"][p], at["id"][q]
                out.append((np.minimum(u, v).tolist(), np.maximum(u, v).tolist(), alike.tolist()))
            held = None if b is None else {k: v[last:] for k, v in held.items()}
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([z for o in out for z in o[i]], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32()))], names=["a", "b", "alike"])

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(run, PAIRS).where("b is null or a != b").distinct()


def with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id"))


class Join:
    """The state of one similarity join, as stored tables."""

    def __init__(self, docs: DataFrame, percent: int, text: str, key: str):
        self.spark, self.docs, self.percent, self.text, self.key = docs.sparkSession, docs, percent, text, key
        p = percent / 100
        self.least = int(SIGNATURE * p - 4 * (SIGNATURE * p * (1 - p)) ** 0.5)
        python_tasks(self.spark)
        self.sketches = stored(self.spark, sketches(docs, text, key), "sketches")
        sets = self.sketches.where("n > 0 and id is not null").groupBy("k1", "k2")
        sets = sets.agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"))  # equal sets: equal n and sig
        sets = stored(self.spark, sets, "distinct_sets")
        self.firsts = sets.select("k1", "k2", F.col("id").alias("first"))
        self.sets = stored(self.spark, sets.select("id", "n", "sig").dropDuplicates(["id"]), "sets")  # a repeated key may have several

    def start(self, roots: list[int], joined: DataFrame | None) -> DataFrame:
        """All sets at the roots of the trees, with their component so far."""
        sets = self.sets.select("id", "sig")
        sets = sets.withColumn("c", F.col("id")) if joined is None else sets.join(joined, "id", "left").withColumn("c", F.coalesce("c", "id"))
        return sets.select("id", "c", "sig", F.explode(F.array(*(F.xxhash64(F.lit(t)) for t in roots))).alias("path"))

    def step(self, now: DataFrame, levels: int, small: bool = True) -> DataFrame:
        """(path, last, id, c, size): the nodes of the next levels that hold more than one
        component and are of use: large ones of the last level, whose children cover those on
        the way, and small ones (if ``small``) of all."""
        now = now.select("id", "c", F.inline(descent(self.percent, levels))).where("true" if small else "last")
        size = now.groupBy("path").agg(F.count("*").alias("size"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("last").alias("deep"))
        of_use = size.where("lo != hi").where(f"size <= {LEAF} or deep" if small else f"size > {LEAF}")
        return stored(self.spark, now.join(of_use.select("path", "size"), "path"), "nodes")

    def deeper(self, large: DataFrame) -> DataFrame:
        return large.select("path", "id", "c").join(self.sets.select("id", "sig"), "id")

    def candidates(self, rows: DataFrame) -> DataFrame:
        """Candidate pairs of rows (node, id, c, side)."""
        return compare_nodes(rows.join(self.sets, "id"), self.percent, self.least)

    def gathered(self) -> DataFrame | None:
        """Links that join groups of copies: of large nodes two levels down, blocks of the
        members and two pivots of the node."""
        large = self.step(self.start([-1 - t for t in range(GATHER)], None), 2, small=False)
        blocks, draw = F.ceil(F.col("size") / BLOCK), F.struct(F.xxhash64("path", "id").alias("h"), "id", "c")
        members = large.select(F.xxhash64("path", F.pmod(F.xxhash64("path", "id"), blocks)).alias("node"), "id", "c")
        pivots = large.groupBy("path").agg(F.first("size").alias("size"), F.array(F.min(draw), F.max(draw)).alias("p")).where(f"size > {BLOCK}")
        pivots = pivots.select("path", "p", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("block"))
        pivots = pivots.select(F.xxhash64("path", "block").alias("node"), F.explode("p").alias("p")).select("node", "p.id", "p.c")
        rows = members.unionByName(pivots).withColumn("side", F.lit(ASK))
        pairs = stored(self.spark, self.candidates(rows).where("b is not null"), "gathered")
        if pairs.isEmpty():
            return None
        told = self.confirmed(pairs, self.full_sets(ends_of(pairs)))  # forests: about a pair a set
        return stored(self.spark, told.where("linked").select("a", "b"), "confirmed")

    def nodes(self, roots: list[int], joined: DataFrame | None) -> DataFrame:
        """(node, id, c, side): what the trees compare."""
        node, parts = F.xxhash64("path").alias("node"), []
        now, depth = self.start(roots, joined), 0
        while depth < DEPTH:
            levels = 1 if not depth else SHALLOW - 1 if depth == 1 else min(STEP, DEPTH - depth)
            now, depth = self.step(now, levels), depth + levels
            parts.append(now.where(f"size <= {LEAF}").select(node, "id", "c", F.lit(ASK).alias("side")))
            large = now.where(f"last and size > {LEAF}")
            if large.isEmpty():
                break
            main = large.groupBy("path", "c").agg(F.count("*").alias("n")).groupBy("path").agg(F.max(F.struct("n", "c")).alias("main"))
            large = stored(self.spark, large.join(main, "path"), "large_nodes")
            few = F.col("size") - F.col("main.n") <= LEAF
            blocks, here = F.ceil(F.col("size") / HELD), F.xxhash64("path", "block").alias("node")
            asks = large.where(few & (F.col("c") != F.col("main.c"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
            holds = large.where(few & (F.col("c") == F.col("main.c"))).withColumn("block", F.pmod(F.xxhash64("path", "id"), blocks))
            parts += [asks.select(here, "id", "c", F.lit(ASK).alias("side")), holds.select(here, "id", "c", F.lit(HOLD).alias("side"))]
            large = large.where(~few)
            if large.isEmpty():
                break
            if depth == DEPTH:
                parts.append(self.block_pairs(large))
            elif depth == SHALLOW:
                large = large.withColumn("path", F.explode(F.array(*(F.xxhash64("path", F.lit(r)) for r in range(RESTARTS)))))
            now = self.deeper(large)
        return stored(self.spark, reduce(DataFrame.unionByName, parts), "rows")

    def block_pairs(self, large: DataFrame) -> DataFrame:
        """Nodes that compare each pair of blocks of a large node once."""
        blocks = F.ceil(F.col("size") / BLOCK)
        rows = large.withColumn("block", F.pmod(F.xxhash64("path", "id"), blocks))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
        side = F.when(F.col("block") == F.col("other"), ASK).when(F.col("block") < F.col("other"), CROSS).otherwise(HOLD)
        return rows.select(F.xxhash64("path", F.least("block", "other"), F.greatest("block", "other")).alias("node"), "id", "c", side.alias("side"))

    def audited(self, batch: int, joined: DataFrame) -> DataFrame | None:
        """Links that AUDIT sets (by hash) have and the trees missed, or None where no more
        than 1 - TARGET of those with links miss any."""
        sets = self.sets.join(joined.withColumnRenamed("component", "c"), "id", "left").withColumn("c", F.coalesce("c", "id"))
        some = sets.orderBy(F.xxhash64("id", F.lit(batch)), "id").limit(AUDIT).select("id", "c", "n", "sig").collect()  # AUDIT rows
        if not some:
            return None
        ids, c, n = (np.array([r[k] for r in some], "int64") for k in ("id", "c", "n"))
        sig, percent, least = np.array([r["sig"] for r in some], "int16"), self.percent, self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                i, d, m = (b.column(k).to_numpy() for k in range(3))
                s = b.column(3).flatten().to_numpy().reshape(-1, SIGNATURE)
                out = []
                for k in range(len(ids)):
                    j = np.flatnonzero((i != ids[k]) & (np.minimum(m, n[k]) * 100 >= np.maximum(m, n[k]) * percent))
                    alike = (s[j] == sig[k]).sum(1)
                    j, alike = j[alike >= least], alike[alike >= least]
                    same = d[j] == c[k]
                    told = ~same | (np.arange(len(j)) == (same.argmax() if same.any() else -1))  # one of the same component will do
                    out += zip([ids[k]] * int(told.sum()), i[j[told]], alike[told], same[told], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[x] for o in out], kind) for x, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.bool_()))], names=["a", "b", "alike", "same"])

        pairs = stored(self.spark, sets.select("id", "c", "n", "sig").mapInArrow(run, PAIRS + ", same boolean"), "audit")
        asked = stored(self.spark, pairs.where("not same").drop("same"), "audit_pairs")
        if asked.isEmpty():
            return None
        missed = stored(self.spark, self.confirmed(asked, self.full_sets(ends_of(asked))).where("linked").select("a", "b"), "missed")
        lost = missed.select("a").distinct().count()
        linked = pairs.where("same").select("a").unionByName(missed.select("a")).distinct().count()
        return missed if lost > (1 - TARGET) * linked else None

    def full_sets(self, ids: DataFrame) -> DataFrame:
        """(id, s) of the sets named in ``ids``, made from the texts again."""
        ids = stored(self.spark, ids.distinct(), "ids")
        if ids.count() <= BROADCAST_IDS:
            ids = F.broadcast(ids)
        text, key = self.text, self.key

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keep_only(_WORDS)
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["id", "s"])

        docs = self.docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("t")).join(ids, "id", "left_semi")
        return stored(self.spark, docs.mapInArrow(run, "id long, s binary").dropDuplicates(["id"]), "full_sets")

    def confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """pairs (a, b) with ``linked``: whether their full sets are alike enough."""
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                linked = []
                for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    x, y = np.frombuffer(x, "uint64"), np.frombuffer(y, "uint64")
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

        rows = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a")
        rows = rows.join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b").select("a", "b", "x", "y")
        return rows.mapInArrow(run, "a long, b long, linked boolean")

    def links(self, pairs: DataFrame, before: DataFrame | None = None) -> DataFrame:
        """Links enough to join every component of ``pairs`` (and of the links ``before``,
        whose components the pairs do not lie in)."""
        sets = self.full_sets(ends_of(pairs))
        found = before
        for r in range(ROUNDS + 1):
            if r:
                pairs = self.between(pairs, joined_components(found))
            if pairs.isEmpty():
                break
            asked = pairs
            if r < ROUNDS:
                ends = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "alike").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "alike"))
                chance = F.xxhash64("id", "other")
                some = [F.max(F.struct("alike", "other"))["other"], F.min("other"), F.max_by("other", chance), F.min_by("other", chance)]
                picks = ends.groupBy("id").agg(F.array(*some).alias("p"))
                picks = picks.select("id", F.explode("p").alias("other"))
                asked = picks.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
            told = stored(self.spark, self.confirmed(asked, sets), "confirmed")
            linked = told.where("linked").select("a", "b")
            found = linked if found is None else found.unionByName(linked)
            if r == ROUNDS:
                break
            pairs = stored(self.spark, pairs.join(told.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        return found if found is not None else pairs.select("a", "b")

    def between(self, pairs: DataFrame, joined: DataFrame) -> DataFrame:
        """Pairs whose ends are not in one component yet."""
        out = pairs.join(joined.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left")
        out = out.join(joined.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
        return stored(self.spark, out.where("coalesce(ca, a) != coalesce(cb, b)").select("a", "b", "alike"), "pairs")

    def searched(self, roots: list[int], found: DataFrame | None) -> DataFrame:
        """``found`` and the links that these trees add between components."""
        joined = None if found is None else joined_components(found).withColumnRenamed("component", "c")
        rows = self.nodes(roots, joined)
        pairs = stored(self.spark, self.candidates(rows), "candidates")
        dense = stored(self.spark, pairs.where("b is null").select(F.col("a").alias("node")), "dense")
        pairs = pairs.where("b is not null")
        found = self.links(pairs, found)
        if not dense.isEmpty():
            joined = joined_components(found).withColumnRenamed("component", "c")
            again = rows.drop("c").join(dense, "node").join(joined, "id", "left").withColumn("c", F.coalesce("c", "id"))
            several = again.groupBy("node").agg((F.min("c") != F.max("c")).alias("several")).where("several").select("node")
            again = stored(self.spark, again.join(several, "node"), "again")
            again = again.join(self.sets, "id").join(self.full_sets(again.select("id")), "id")
            more = compare_nodes(again, self.percent, self.least).select("a", "b")
            found = found.unionByName(stored(self.spark, more, "more_links"))
        return found

    def run(self) -> DataFrame:
        found, n = self.gathered(), trees(self.percent, SHALLOW, TARGET)
        for batch in range(BATCHES):
            found = self.searched([*range(batch * n, batch * n + n)], found)
            joined = joined_components(found)
            missed = self.audited(batch, joined)
            if missed is None:
                break
            found = found.unionByName(missed)
            joined = joined_components(found)
        joined = joined.select(F.col("id").alias("first"), "component")
        by_set = stored(self.spark, self.firsts.join(joined, "first", "left").select("k1", "k2", F.coalesce("component", "first").alias("c")), "by_set")
        some = self.sketches.where("n > 0 and id is not null").select("id", "n", "k1", "k2").join(by_set, ["k1", "k2"]).select("id", "n", "c")
        none = self.sketches.where("n = 0 or id is null").select("id", "n", F.col("id").alias("c"))
        return some.unionByName(none)


def near_duplicates(docs: DataFrame, percent: int = 85, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, n_shingles, component_id and kept (the component's least key)."""
    out = Join(docs, percent, text, key).run()
    return out.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), F.coalesce(F.col("id") == F.col("c"), F.lit(True)).alias("kept"))
