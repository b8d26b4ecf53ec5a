"""Operator 11: two tokenisers' tokens of the same texts, aligned by interval coalescing.

Every token covers a range of the bytes of blank + text. The tokens of both tokenisers are
sorted together by start (lexsort); where a start reaches the running maximum of the ends
before it (``maximum.accumulate``) a new group begins, so groups are the finest pieces in
which tokens of the two don't overlap across an edge. Within a group every A token is
linked with every B token.

Both tokenisers part a text before a single blank that a visible character follows, so
distinct chunks between such blanks are tokenised apart, lines of them at once, and kept in
a worker's table while they come again; the coalescing runs over the tokens of whole batches
of texts.

``align`` writes one row per document (ids, group sizes, distinct linked pairs with their
numbers of links); ``pair_counts`` counts the documents that hold a pair; ``link_scores``
holds every document's links against these counts. The head of the pair counts, at most
HEAD pairs by a threshold on the count, is sent to all tasks; the links of all other pairs
are joined by shuffle, so nothing depends on how many pairs the corpus has.

Null and empty texts, and texts whose bytes one of the tokenisers doesn't give back, have
no tokens: empty lists, zeros. Rows with equal doc_id, null included, are kept apart by a row
number. Extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import python_tasks, stored

MARK = "▁"
#: Bytes that a worker's chunk table may take; a full table keeps the chunks that came again, half of them at most.
TABLE_BYTES = 48 << 20
#: Chunks that are encoded as one text; one whose bytes aren't given back is encoded chunk by chunk.
JOINED = 128
#: Bytes of texts that are aligned at once (a longer text by itself).
SLICE_BYTES = 1 << 18
#: Pairs whose counts every task holds (16 bytes each).
HEAD = 1 << 18
#: Links that are expanded at once.
LINKS = 1 << 18
#: From this many links on, a group's equal ids are merged before they are linked.
LARGE_GROUP = 256

_CUT = re.compile(r"(?<! ) (?=\S)")
_TABLES: dict[tuple[str, str], ChunkTable] = {}


def byte_level_bytes() -> dict[str, int]:
    """Printable stand-in of every byte in byte-level vocabularies: visible Latin-1
    characters stand for themselves, the other bytes for 256 and up in their order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ChunkTable(dict):
    """Chunk without its leading blank -> its number. The ids of both sides of all chunks lie
    in two arrays, chunk i from ``at[i]`` to ``at[i + 1]``; ``fine[i]`` tells whether the bytes of
    both sides' tokens are those of the chunk."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        from tokenizers import Tokenizer

        super().__init__()
        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        stand_in = byte_level_bytes()
        self.bytes = [self._a_token(i, stand_in) for i in range(self.a.get_vocab_size())], [self._b_piece(i) for i in range(self.b.get_piece_size())]
        if any(MARK in self.b.id_to_piece(i).lstrip(MARK) for i in range(len(self.bytes[1]))):
            raise ValueError("a piece of the model crosses a whitespace marker: chunks would not be independent")
        self.len = tuple(np.array([len(b) for b in side], "int64") for side in self.bytes)
        self.sizes = len(self.bytes[0]), len(self.bytes[1])
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.ids = [np.zeros(0, "int32")] * 2
        self.at = [np.zeros(1, "int64")] * 2
        self.fine = np.zeros(0, bool)
        self.hits = np.zeros(0, "int64")
        self.used = 0

    def shrink(self) -> None:
        """Keep the chunks that came more than once, the half that came most often at most."""
        again = np.flatnonzero(self.hits > 1)
        kept = np.sort(again[np.argsort(-self.hits[again], kind="stable")[: len(self) // 2]])
        names = list(self)  # in the order of their numbers
        names = [names[i] for i in kept.tolist()]
        gathered = [self.gather(side, kept) for side in (0, 1)]
        fine, hits = self.fine[kept], self.hits[kept] // 2
        self.empty()
        self.ids = [ids.astype("int32") for ids, _ in gathered]
        self.at = [np.concatenate([[0], np.cumsum(n)]) for _, n in gathered]
        self.fine, self.hits = fine, hits
        self.update(zip(names, range(len(names)), strict=True))
        self.used = sum(200 + 8 * (1 + len(c.encode())) for c in names)

    def _a_token(self, i: int, stand_in: dict[str, int]) -> bytes:
        token = self.a.id_to_token(i) or ""
        return bytes(stand_in[c] for c in token) if all(c in stand_in for c in token) else token.encode()

    def _b_piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode()

    def learn(self, chunks: list[str]) -> None:
        """Make sure that all of these chunks are in the table."""
        if self.used > TABLE_BYTES:
            self.shrink()
            if self.used > TABLE_BYTES // 4 * 3:
                self.empty()  # a few long chunks fill it
        new = list(set(chunks).difference(self))
        if not new:
            return
        # chunks that stand between blanks as they do in texts are encoded as lines of JOINED ones
        inner = [c for c in new if c and not c[0].isspace() and not c[-1].isspace()]
        if len(inner) < len(new):
            known = set(inner)
            self._add([c for c in new if c not in known])
        lines = [inner[i : i + JOINED] for i in range(0, len(inner), JOINED)]
        texts = [" ".join(line) for line in lines]
        sides = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], self.b.encode(texts, num_threads=1)
        done, apart = [], []
        for line, text, *ids in zip(lines, texts, *sides, strict=True):
            lengths = np.fromiter((1 + len(c.encode()) for c in line), "int64", len(line))
            ends, whole, at, row = np.cumsum(lengths), (" " + text).encode(), [], [np.array(x, "int32") for x in ids]
            for side, (found, piece) in enumerate(zip(ids, self.bytes, strict=True)):
                covered = np.cumsum(self.len[side][row[side]])
                k = np.minimum(np.searchsorted(covered, ends), len(covered) - 1)
                if not len(covered) or (covered[k] != ends).any() or b"".join(map(piece.__getitem__, found)) != whole:
                    break  # one of its chunks isn't given back
                at.append(k + 1)
            if len(at) < 2:
                apart += line
            else:
                done.append((line, row, at, int(lengths.sum())))
        if done:
            names = [c for line, *_ in done for c in line]
            for side in (0, 1):
                n = np.concatenate([np.diff(at[side], prepend=0) for _, _, at, _ in done])
                self.at[side] = np.concatenate([self.at[side], np.cumsum(n) + len(self.ids[side])])
                self.ids[side] = np.concatenate([self.ids[side], *(row[side] for _, row, _, _ in done)])
            self._named(names, np.ones(len(names), bool), sum(size for *_, size in done))
        self._add(apart)

    def _add(self, new: list[str]) -> None:
        """Chunks that are encoded one by one."""
        if not new:
            return
        whole = [(" " + c).encode() for c in new]
        lengths = np.array([len(w) for w in whole])
        fine = np.ones(len(new), bool)
        sides = [e.ids for e in self.a.encode_batch_fast([" " + c for c in new], add_special_tokens=False)], self.b.encode(new, num_threads=1)
        for side, lists in enumerate(sides):
            n = np.fromiter(map(len, lists), "int64", len(lists))
            ids = np.fromiter(chain.from_iterable(lists), "int32", int(n.sum()))
            at = np.cumsum(n)
            covered = np.concatenate([[0], np.cumsum(self.len[side][ids])])[at]
            piece = self.bytes[side]
            if (covered != np.cumsum(lengths)).any() or b"".join(map(piece.__getitem__, ids.tolist())) != b"".join(whole):
                fine &= np.array([b"".join(map(piece.__getitem__, x)) == w for x, w in zip(lists, whole, strict=True)])
            self.at[side] = np.concatenate([self.at[side], at + len(self.ids[side])])
            self.ids[side] = np.concatenate([self.ids[side], ids])
        self._named(new, fine, int(lengths.sum()))

    def _named(self, new: list[str], fine: np.ndarray, size: int) -> None:
        self.fine = np.concatenate([self.fine, fine])
        self.hits = np.concatenate([self.hits, np.zeros(len(new), "int64")])
        self.update(zip(new, range(len(self), len(self) + len(new)), strict=True))
        self.used += 200 * len(new) + 8 * size

    def gather(self, side: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a row of chunks, and how many each has."""
        first = self.at[side][numbers]
        n = self.at[side][numbers + 1] - first
        done = np.cumsum(n)
        return self.ids[side][np.repeat(first - done + n, n) + np.arange(done[-1] if len(done) else 0)].astype("int64"), n


def chunk_table(a_file: str, b_file: str) -> ChunkTable:
    if (a_file, b_file) not in _TABLES:
        _TABLES[a_file, b_file] = ChunkTable(a_file, b_file)
    return _TABLES[a_file, b_file]


def chunks_of(text: str) -> list[str]:
    """The text's chunks, each without the blank before it (the first one's is put there)."""
    words, edges = text.split(), text.count(" ") + text.count("\n")
    if len(words) == 1 + edges and sum(map(len, words)) == len(text) - edges:
        return text.split(" ")  # white space is single blanks and line ends between visible characters
    first, *others = _CUT.split(" " + text)
    return others if not first else [first[1:], *others]


def tokens(texts: list[str | None], table: ChunkTable) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids of A, ids of B over all texts, and each text's number of both."""
    parts = [chunks_of(t) if t else [] for t in texts]
    flat = list(chain.from_iterable(parts))
    table.learn(flat)
    numbers = np.fromiter(map(table.__getitem__, flat), "int64", len(flat))
    table.hits += np.bincount(numbers, minlength=len(table))
    doc = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    bad = np.zeros(len(texts), bool)
    bad[doc[~table.fine[numbers]]] = True
    kept = ~bad[doc]
    out, counts = [], []
    for side in (0, 1):
        ids, n = table.gather(side, numbers[kept])
        out.append(ids)
        counts.append(np.bincount(doc[kept], weights=n, minlength=len(texts)).astype("int64"))
    return out[0], out[1], counts[0], counts[1]


def coalesce(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of every A token and of every B token. Both cover the same bytes, from 0 on."""
    a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
    start = np.concatenate([a_end - a_len, b_end - b_len])
    end = np.concatenate([a_end, b_end])
    order = np.argsort(start, kind="stable")  # two sorted runs, A's tokens first
    reach = np.maximum.accumulate(end[order])
    opens = np.ones(len(start), bool)
    opens[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(start), "int64")
    group[order] = np.cumsum(opens) - 1
    return group[: len(a_end)], group[len(a_end) :]


def _merged(group: np.ndarray, ids: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, times = np.unique(group * vocabulary + ids, return_counts=True)
    return keys // vocabulary, keys % vocabulary, times


def _products(ga, a, wa, gb, b, wb, groups: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(group, a, b, times) of all pairs within groups, at most about LINKS at once. Tokens
    come sorted by group."""
    in_b = np.bincount(gb, minlength=groups)
    first_b = np.cumsum(in_b) - in_b
    each = in_b[ga]
    done = np.cumsum(each)
    edges = np.searchsorted(done, np.arange(LINKS, done[-1] + LINKS, LINKS), side="left") + 1 if len(done) else []
    lo = 0
    for hi in np.unique(np.minimum(edges, len(done))):
        some = np.arange(lo, hi)
        left = np.repeat(some, each[some])
        right = first_b[ga[left]] + np.arange(len(left)) - np.repeat(np.cumsum(each[some]) - each[some], each[some])
        yield ga[left], a[left], b[right], wa[left] * wb[right]
        lo = hi


def _added(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sum of each one's times."""
    names, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(names), "int64")
    np.add.at(total, at, times)
    return names, total


def linked_pairs(ga, a, gb, b, doc_of_group, sizes: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, a * sizes[1] + b, number of links), sorted, over all documents."""
    groups = len(doc_of_group)
    links = np.bincount(ga, minlength=groups) * np.bincount(gb, minlength=groups)
    ones = lambda x: np.ones(len(x), "int64")
    big_a, big_b = links[ga] > LARGE_GROUP, links[gb] > LARGE_GROUP
    sides = [
        (ga[~big_a], a[~big_a], ones(a[~big_a]), gb[~big_b], b[~big_b], ones(b[~big_b])),
        (*_merged(ga[big_a], a[big_a], sizes[0]), *_merged(gb[big_b], b[big_b], sizes[1])),
    ]
    keys, times = [], []
    for merged, side in enumerate(sides):
        for group, x, y, n in _products(*side, groups):
            key = (doc_of_group[group] * sizes[0] + x) * sizes[1] + y
            # tokens that were not merged make one link each: sorted keys tell the numbers
            key, total = _added(key, n) if merged else np.unique(key, return_counts=True)
            keys.append(key)
            times.append(total)
    if not keys:
        return (np.zeros(0, "int64"),) * 3
    key, total = (keys[0], times[0]) if len(keys) == 1 else _added(np.concatenate(keys), np.concatenate(times))
    return key // (sizes[0] * sizes[1]), key % (sizes[0] * sizes[1]), total


def _lists(values: np.ndarray, n: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype("int32")), pa.array(values))


def _cut(values: np.ndarray, n: np.ndarray) -> pa.Array:
    data, at = values.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(n)]) * 4
    return pa.array([data[i:j] for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts or binaries take about SLICE_BYTES."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(batch)]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def align(docs: DataFrame, a_file: str, b_file: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One stored row per document: ``row`` (its number), ``k`` (its key), ``a`` and ``b`` (ids),
    ``a_sizes`` and ``b_sizes`` (tokens of each group), all little-endian unsigned 32-bit
    binary, ``pairs`` (distinct linked pairs, a * pieces of B + b) and ``times`` (their links)."""
    python_tasks(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(a_file, b_file)
        row = TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in slices(whole, 1):
                n = len(batch)
                a, b, n_a, n_b = tokens(batch.column(1).to_pylist(), table)
                ga, gb = coalesce(table.len[0][a], table.len[1][b])
                groups = int(ga[-1]) + 1 if len(ga) else 0
                doc_of_group = np.zeros(groups, "int64")
                doc_of_group[ga] = np.repeat(np.arange(n), n_a)
                per_doc = np.bincount(doc_of_group, minlength=n)
                doc, pair, times = linked_pairs(ga, a, gb, b, doc_of_group, table.sizes)
                held = np.bincount(doc, minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), batch.column(0), _cut(a, n_a), _cut(b, n_b),
                     _cut(np.bincount(ga, minlength=groups), per_doc), _cut(np.bincount(gb, minlength=groups), per_doc),
                     _lists(pair, held), _lists(times, held)],
                    names=["row", "k", "a", "b", "a_sizes", "b_sizes", "pairs", "times"],
                )
                row += n

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(
        run, f"row long, k {kind}, a binary, b binary, a_sizes binary, b_sizes binary, pairs array<long>, times array<long>")
    return stored(docs.sparkSession, rows, "alignments")


def group_texts(alignments: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """``row``, ``k``, numbers of tokens, groups and links, and ``groups``: A ids, a bar, B ids
    of each group, groups parted by semicolons."""
    python_tasks(alignments.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(a_file, b_file)
        n_a, n_b = table.sizes
        # every id with what may follow it: inside a side, after the A side, after the group
        words = np.array([f"{i}{end}" for end in (",", "|", ";") for i in range(max(n_a, n_b))], object)
        width = max(n_a, n_b)
        for batch in (b for whole in batches for b in slices(whole, 0)):
            out = []
            for a, b, a_sizes, b_sizes in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                a, b, a_sizes, b_sizes = (np.frombuffer(x, "<u4").astype("int64") for x in (a, b, a_sizes, b_sizes))
                a, b = a.copy(), b.copy()
                place_a = np.arange(len(a)) + np.repeat(np.cumsum(b_sizes) - b_sizes, a_sizes)
                place_b = np.arange(len(b)) + np.repeat(np.cumsum(a_sizes), b_sizes)
                if len(a):
                    a[np.cumsum(a_sizes) - 1] += width
                    b[np.cumsum(b_sizes) - 1] += 2 * width
                line = np.empty(len(a) + len(b), "int64")
                line[place_a], line[place_b] = a, b
                out.append("".join(words[line].tolist())[:-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[4:], pa.array(out, pa.string())], names=[*batch.schema.names[4:], "groups"])

    rows = alignments.select(
        "a", "b", "a_sizes", "b_sizes", "row", "k",
        *(F.expr(f"cast(octet_length({c}) div 4 as bigint)").alias(n) for c, n in (("a", "n_a"), ("b", "n_b"), ("a_sizes", "n_groups"))),
        F.expr("aggregate(times, 0L, (x, y) -> x + y)").alias("n_links"))
    kind = alignments.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, k {kind}, n_a long, n_b long, n_groups long, n_links long, groups string")


def pair_counts(alignments: DataFrame, pieces_b: int) -> DataFrame:
    """``pair``, ``n`` (documents that hold it linked), ``best`` (whether no pair of its A id
    stands in more). Pairs are counted map-side first; the table of highest counts has at most
    one row per entry of A's vocabulary, which is why it may be broadcast."""
    n = alignments.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    n = stored(alignments.sparkSession, n.withColumn("a", F.expr(f"pair div {pieces_b}")), "pair_counts")
    most = n.groupBy("a").agg(F.max("n").alias("most"))
    return n.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def head(counts: DataFrame, most: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """The counts from a threshold on, the lowest one that at most ``most`` pairs reach, and
    all other counts. The threshold comes from a histogram of at most 64 * 8 steps."""
    step = F.floor(F.log2("n") * 8).cast("int")
    steps = sorted((r["s"], r["c"]) for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("c")).collect())
    total, least = 0, 1 << 30
    for s, c in reversed(steps):
        total += c
        if total > most:
            break
        least = s
    return counts.where(step >= least), counts.where(step < least)


def link_scores(alignments: DataFrame, pieces_b: int, most: int = HEAD) -> DataFrame:
    """``row``, ``n_best`` (links whose pair is a best one of its A id) and ``count_sum`` (the
    pairs' counts, added over all links), for every row of ``alignments``."""
    spark = alignments.sparkSession
    counts = stored(spark, pair_counts(alignments, pieces_b), "pair_ranks")
    front, rest = head(counts, most)
    known = front.toArrow()  # HEAD rows at most
    pair = known["pair"].to_numpy()
    order = np.argsort(pair)
    shared = spark.sparkContext.broadcast((pair[order], known["n"].to_numpy()[order], known["best"].to_numpy()[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            rows = len(batch)
            held, times = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            sizes = batch.column(1).value_lengths().to_numpy()
            doc = np.repeat(np.arange(rows), sizes)
            at = np.minimum(np.searchsorted(pair, held), max(len(pair) - 1, 0))
            hit = pair[at] == held if len(pair) else np.zeros(len(held), bool)
            sums = np.zeros((2, rows), "int64")
            np.add.at(sums[0], doc[hit], times[hit] * best[at[hit]])
            np.add.at(sums[1], doc[hit], times[hit] * n[at[hit]])
            left = np.bincount(doc[~hit], minlength=rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sums[0]), pa.array(sums[1]), _lists(held[~hit], left), _lists(times[~hit], left)],
                names=["row", "n_best", "count_sum", "pairs", "times"],
            )

    near = stored(spark, alignments.select("row", "pairs", "times").mapInArrow(
        run, "row long, n_best long, count_sum long, pairs array<long>, times array<long>"), "link_scores")
    far = near.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnsRenamed({"pairs": "pair"})
    far = far.join(rest, "pair").select("row", F.expr("if(best, times, 0L)").alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    both = near.select("row", "n_best", "count_sum").unionByName(far)
    return both.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def compare(docs: DataFrame, a_file: str, b_file: str, text: str = "text", key: str = "doc_id",
            shown: Callable[[Column], Column] = lambda groups: groups) -> DataFrame:
    """One row per document: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.
    ``shown`` is applied to the groups before rows are joined (a digest moves less)."""
    import sentencepiece

    pieces_b = sentencepiece.SentencePieceProcessor(model_file=b_file).get_piece_size()
    rows = align(docs, a_file, b_file, text, key)
    texts = group_texts(rows, a_file, b_file).withColumn("groups", shown(F.col("groups")))
    out = texts.join(link_scores(rows, pieces_b), "row").drop("row")
    return out.select(F.col("k").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
