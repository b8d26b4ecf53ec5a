"""Operator 9: passages that an earlier document holds, by merging Burrows-Wheeler transforms.

Every byte covered by a LENGTH-byte string that also starts in a document with a smaller key
is removed; strings are judged on the input, and never cross documents.

1. Texts are written as compressed blocks of whole documents.
2. Of every LENGTH-byte window the GRAM-gram with the least hash is its anchor. Equal windows
   have equal anchors, so only anchors seen in two documents can matter. Blocks send their
   distinct anchors to buckets, and buckets tell each block which of them are repeated.
3. Around each repeated anchor lies the context of all windows that can have it. Blocks send
   their distinct contexts, with the least key that holds each, to the anchors' buckets.
4. A bucket takes each sender's contexts as a shard. The shards' Burrows-Wheeler transforms
   are merged as by Holt and McMillan (2014): the vector that says which shard each row comes
   from is refined by one stable counting sort of the merged transform's characters for each
   step to the left, and common prefix lengths follow from those of the step before. No
   suffix is compared with another. Rows between common prefixes shorter than LENGTH form
   the intervals of equal windows; the least key of each interval goes back to the blocks.
   A bucket of more than BUCKET_CONTEXTS contexts is dealt out by whole windows instead.
5. Blocks cut what an earlier document holds.

Everything that moves is packed by block and bucket; a passage that a third of all rows hold
is one context for each block. Blocks and buckets both grow with the corpus, their pairs with its
square, so what is done for a pair is no more than to pack and unpack its bytes; all else is done
for a whole block or bucket at once. Null texts count as empty. Rows with equal keys are one
document (they don't remove each other), a null key comes before all others. Extra columns
are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_tasks, stored, stored_by

LENGTH = 50
GRAM = 20
#: GRAM-gram starts in a window, and bytes of a context: as far as windows with its anchor go.
STARTS = LENGTH - GRAM + 1
LEFT = LENGTH - GRAM
CONTEXT = LEFT + LENGTH
#: Stands for what lies outside the document; no byte of UTF-8.
OUTSIDE = 255
BLOCK_BYTES = 2 << 20
BUCKET_ANCHORS = 250_000
#: Buckets with more contexts hold an anchor that stands in very many places.
BUCKET_CONTEXTS = 300_000
LEAST_BUCKET_BITS = 6
SHARDS = 16
FIRST_KEY = -(1 << 63)
TOLD = "block long, uses binary, told binary"


def blocks(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(block, n, ids, sizes, z, rest): whole documents in key order, their texts compressed;
    ``rest`` holds the other columns' rows, in the same order, as an Arrow stream."""
    names = docs.columns
    at_text, at_key = names.index(text), names.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0

        def block(rows: list[tuple[int, bytes, pa.RecordBatch, int]]) -> pa.RecordBatch:
            nonlocal number
            rows.sort(key=lambda r: r[0])
            raw = b"".join(r[1] for r in rows)
            sources = {id(r[2]): r[2] for r in rows}
            first = dict(zip(sources, np.cumsum([0, *(x.num_rows for x in sources.values())]).tolist(), strict=False))
            rest = pa.Table.from_batches([*sources.values()]).take(pa.array([first[id(r[2])] + r[3] for r in rows]))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.schema) as stream:
                stream.write_table(rest.combine_chunks())
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | number], pa.int64()), pa.array([len(raw)], pa.int64()),
                 pa.array([np.array([r[0] for r in rows], "int64").tobytes()], pa.binary()),
                 pa.array([np.array([len(r[1]) for r in rows], "int64").tobytes()], pa.binary()),
                 pa.array([zstandard.compress(raw, 3)], pa.binary()), pa.array([zstandard.compress(sink.getvalue(), 3)], pa.binary())],
                names=["block", "n", "ids", "sizes", "z", "rest"],
            )

        rows, size = [], 0
        for b in batches:
            rest = pa.RecordBatch.from_arrays(b.columns[:at_text] + b.columns[at_text + 1 :], names=names[:at_text] + names[at_text + 1 :])
            for j, (i, t) in enumerate(zip(b.column(at_key).to_pylist(), b.column(at_text).to_pylist(), strict=True)):
                raw = (t or "").encode()
                if rows and size + len(raw) > BLOCK_BYTES:
                    yield block(rows)
                    rows, size = [], 0
                rows.append((FIRST_KEY if i is None else i, raw, rest, j))
                size += len(raw)
        if rows:
            yield block(rows)

    return docs.mapInArrow(run, "block long, n long, ids binary, sizes binary, z binary, rest binary")


class Block:
    """An unpacked block: bytes, and for each document its key, start and end."""

    def __init__(self, z: bytes, ids: bytes, sizes: bytes):
        self.data = np.frombuffer(zstandard.decompress(z), "uint8")
        self.ids, size = np.frombuffer(ids, "int64"), np.frombuffer(sizes, "int64")
        self.ends = np.cumsum(size)
        self.starts = self.ends - size

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, 64-bit hashes and document numbers of all anchors."""
        data, out = self.data, []
        left = np.repeat(self.ends, self.ends - self.starts)
        left -= np.arange(len(data))  # bytes to the end of the document
        step = 1 << 19
        for at in range(0, len(data), step):  # the windows that hold a position lie up to LENGTH around it
            lo, hi = max(0, at - STARTS + 1), min(len(data), at + step + LENGTH)
            here, h = selected(data[lo:hi], left[lo:hi])
            here = here + lo
            inside = (here >= at) & (here < at + step)
            out.append((here[inside], h[inside]))
        pos = np.concatenate([p for p, _ in out]) if out else np.zeros(0, "int64")
        h = np.concatenate([x for _, x in out]) if out else np.zeros(0, "uint64")
        return pos, h, np.searchsorted(self.ends, pos, side="right")


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on, by doubling."""
    base = 0x9E3779B97F4A7C15
    power = lambda n: np.uint64(pow(base, n, 1 << 64))
    width, h, sums = 1, data.astype("uint64") + np.uint64(1), {}
    sums[1] = h
    while width * 2 <= GRAM:
        h = h[:-width] * power(width) + h[width:]
        width *= 2
        sums[width] = h
    while width < GRAM:
        more = max(w for w in sums if w + width <= GRAM)
        tail = sums[more][width:]
        h = h[: len(tail)] * power(more) + tail
        width += more
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) | np.uint64(1)


def slide(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` over x[i : i + width], for each i."""
    size, y = 1, x
    while size * 2 <= width:
        y = best(y[:-size], y[size:])
        size *= 2
    return best(y[: len(x) - width + 1], y[width - size : len(x) - size + 1]) if size < width else y


def selected(data: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that are least in a window; all of them in ties."""
    if len(data) < LENGTH:
        return np.zeros(0, "int64"), np.zeros(0, "uint64")
    h = gram_hashes(data)
    least = slide(h, STARTS, np.minimum)
    least[left[: len(least)] < LENGTH] = 0  # not a window of one document
    edge = np.zeros(STARTS - 1, "uint64")
    most = slide(np.concatenate([edge, least, edge]), STARTS, np.maximum)
    here = np.flatnonzero(most[: len(h)] == h)
    return here, h[here]


def code(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each anchor, and 31 more bits of its hash; mixed again, as least hashes begin
    with zeros and would crowd the first buckets."""
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - bits)).astype("int64"), (h >> np.uint64(64 - bits - 31)).astype("uint32") & np.uint32(0x7FFFFFFF)


@functools.cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """One of each for a process; to make them takes longer than a small piece does."""
    return zstandard.ZstdCompressor(3), zstandard.ZstdDecompressor()


def packed(x: np.ndarray) -> bytes:
    """Differences of neighbours, compressed."""
    return packed_pieces(x, [0, len(x)])[0]


def packed_pieces(x: np.ndarray, edges: list[int]) -> list[bytes]:
    """``packed`` of each x[edges[i] : edges[i + 1]]; the edges go from 0 to the end of ``x``."""
    x = x.astype("int64")
    d = np.diff(x, prepend=np.int64(0))
    first = np.array([a for a, b in zip(edges, edges[1:], strict=False) if a < b], "int64")
    d[first] = x[first]
    raw, pack = d.tobytes(), _zstd()[0].compress
    return [pack(raw[8 * a : 8 * b]) for a, b in zip(edges, edges[1:], strict=False)]


def unpacked(z: bytes) -> np.ndarray:
    return unpacked_pieces([z])[0]


def unpacked_pieces(pieces: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """What was packed, one piece after another, and the pieces' sizes."""
    unpack = _zstd()[1].decompress
    raw = [unpack(z) for z in pieces]
    size = np.array([len(r) // 8 for r in raw], "int64")
    x = np.cumsum(np.frombuffer(b"".join(raw), "int64"))
    begin = np.cumsum(size) - size
    return x - np.repeat(np.append(np.int64(0), x)[begin], size), size


def halves(x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first halves of the pieces, one after another, and the second ones."""
    left = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size) < np.repeat(size // 2, size)
    return x[left], x[~left]


def in_turn(x: np.ndarray, y: np.ndarray, edges: list[int]) -> tuple[np.ndarray, list[int]]:
    """x[a:b] and y[a:b] for each two edges, and the edges of these pairs: what ``halves`` takes
    apart again."""
    n = np.diff(edges)
    at = np.arange(len(x)) + np.repeat(np.asarray(edges[:-1], "int64"), n)
    out = np.empty(2 * len(x), "int64")
    out[at], out[at + np.repeat(n, n)] = x, y
    return out, [2 * e for e in edges]


def split(buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal buckets."""
    edges = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield int(buckets[a]), slice(a, b)


def send_anchors(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, sizes, z in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                block = Block(z, ids, sizes)
                _, h, doc = block.anchors()
                bucket, rest = code(h, bits)
                full = bucket.astype("uint64") << np.uint64(31) | rest
                order = np.lexsort((block.ids[doc], full))
                full, key = full[order], block.ids[doc][order]
                first = np.flatnonzero(np.diff(full, prepend=full[:1] ^ np.uint64(1))) if len(full) else np.zeros(0, "int64")
                last = np.append(first[1:], len(full)) - 1 if len(first) else first
                twice = key[first] != key[last]
                out = (full[first] & np.uint64(0x7FFFFFFF)).astype("uint32") << np.uint32(1) | twice.astype("uint32")
                rows = [(b, out[s].tobytes()) for b, s in split((full[first] >> np.uint64(31)).astype("int64"))]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b for b, _ in rows], pa.int64()), pa.array([number] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())],
                        names=["bucket", "block", "anchors"],
                    )

    return run


def repeated(rows: pd.DataFrame) -> pd.DataFrame:
    """A bucket's anchors -> for each block those that two documents hold."""
    sent = np.frombuffer(b"".join(rows["anchors"]), "uint32")
    merged = np.sort(sent)
    bare = merged >> np.uint32(1)
    again = np.flatnonzero(bare[1:] == bare[:-1])
    good = np.unique(np.concatenate([bare[again], bare[(merged & np.uint32(1)) == 1]]))
    if not len(good):
        return pd.DataFrame({"bucket": rows["bucket"][:0], "block": rows["block"][:0], "hits": []})
    sent = sent >> np.uint32(1)
    hit = good[np.minimum(np.searchsorted(good, sent), len(good) - 1)] == sent
    raw = sent[hit].tobytes()
    ends = (np.append(0, np.cumsum(hit))[np.cumsum([len(x) // 4 for x in rows["anchors"]])] * 4).tolist()
    hits = [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    out = pd.DataFrame({"bucket": rows["bucket"].to_numpy(), "block": rows["block"].to_numpy(), "hits": hits})
    return out[[len(x) > 0 for x in hits]]


def send_contexts(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, sizes, z, hits in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                block = Block(z, ids, sizes)
                told = np.array([x["bucket"] for x in hits], "uint64") << np.uint64(31)
                good = np.frombuffer(b"".join(x["hits"] for x in hits), "uint32") | np.repeat(told, [len(x["hits"]) // 4 for x in hits])
                good = np.sort(good)
                pos, h, doc = block.anchors()
                bucket, rest = code(h, bits)
                full = bucket.astype("uint64") << np.uint64(31) | rest
                keep = good[np.minimum(np.searchsorted(good, full), len(good) - 1)] == full
                pos, doc, bucket = pos[keep], doc[keep], bucket[keep]
                if not len(pos):
                    continue
                rows, index, which = np.unique(contexts(block, pos, doc), return_index=True, return_inverse=True)
                of = bucket[index]
                order = np.lexsort((index, of))  # a bucket's contexts in the order of their first use
                rank = np.empty(len(order), "int64")
                rank[order] = np.arange(len(order))
                rows, least, which = rows[order], block.ids[doc[index]][order], rank[which]
                of = of[order]
                first = np.flatnonzero(np.diff(of, prepend=of[0] - 1))
                edges = [*first.tolist(), len(of)]
                raw, pack = rows.tobytes(), _zstd()[0].compress
                packs = [pack(raw[CONTEXT * a : CONTEXT * b]) for a, b in zip(edges, edges[1:], strict=False)]
                by = np.argsort(bucket, kind="stable")  # a context and its places have one bucket
                n = np.bincount(np.searchsorted(first, which[by], side="right") - 1, minlength=len(first))
                uses = packed_pieces(*in_turn(pos[by], which[by] - np.repeat(first, n), [0, *np.cumsum(n).tolist()]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(of[first]), pa.array(np.full(len(first), number, "int64")), pa.array(packs, pa.binary()), pa.array(packed_pieces(least, edges), pa.binary()),
                     pa.array(uses, pa.binary()), pa.array(np.diff(edges))],
                    names=["bucket", "block", "contexts", "least", "uses", "n"],
                )

    return run


def contexts(block: Block, pos: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The bytes around each anchor as one value; documents are in key order, so the first
    occurrence of a context has its least key."""
    around = np.concatenate([np.full(LEFT, OUTSIDE, "uint8"), block.data, np.full(LENGTH, OUTSIDE, "uint8")])
    rows = np.lib.stride_tricks.sliding_window_view(around, CONTEXT)[pos].copy()
    before, after = pos - block.starts[doc], block.ends[doc] - pos
    place = np.arange(CONTEXT)
    for side in (np.flatnonzero(before < LEFT), np.flatnonzero(after < LENGTH)):
        part = rows[side]
        part[(place < LEFT - before[side, None]) | (place >= LEFT + after[side, None])] = OUTSIDE
        rows[side] = part
    return rows.view(np.dtype((np.void, CONTEXT))).ravel()


class Minima:
    """Least values of ranges, from tables of runs of 1, 2, 4, ..."""

    def __init__(self, x: np.ndarray):
        tables, size = [x], 1
        while size * 2 <= len(x):
            last = tables[-1]
            new = last.copy()
            np.minimum(last[:-size], last[size:], out=new[:-size])
            tables.append(new)
            size *= 2
        self.tables = np.stack(tables)

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least of x[a + 1 .. b]."""
        level = np.frexp((b - a).astype("float64"))[1] - 1  # floor of the binary logarithm
        return np.minimum(self.tables[level, a + 1], self.tables[level, b + 1 - (1 << level)])


def merge(shards: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """shards: contexts (rows by CONTEXT bytes); keys: the least key that holds each row,
    shards one after another -> per row a bit mask of the window starts at which a row with
    a smaller key has the same window."""
    n = len(keys)
    base = np.cumsum([0, *(len(s) for s in shards[:-1])])
    first = np.concatenate([(s[:, :LEFT] == OUTSIDE).sum(1) for s in shards])
    last = STARTS - 1 - np.concatenate([(s[:, LEFT:] == OUTSIDE).sum(1) for s in shards])
    orders = [np.arange(len(s)) for s in shards]  # each shard's suffix order so far
    source = np.repeat(np.arange(len(shards), dtype="uint8"), [len(s) for s in shards])  # of each merged row
    common = np.zeros(n, "uint8")  # bytes in common with the row before
    mask = np.zeros(n, "uint32")
    for at in range(CONTEXT - 1, -1, -1):
        # the characters to the left of each shard's suffixes: its transform at this step
        transform = [s[o, at] for s, o in zip(shards, orders, strict=True)]
        orders = [o[np.argsort(t, kind="stable")] for o, t in zip(orders, transform, strict=True)]
        # refine the interleave: deal the transforms out by source, sort stably by character
        place = np.argsort(source, kind="stable")
        merged = np.empty(n, "uint8")
        merged[place] = np.concatenate(transform)
        turn = np.argsort(merged, kind="stable")
        source, merged = source[turn], merged[turn]
        same = np.flatnonzero(merged[1:] == merged[:-1])
        before, common = common, np.zeros(n, "uint8")
        if len(same):
            common[same + 1] = Minima(before).between(turn[same], turn[same + 1]) + np.uint8(1)
        if at < STARTS:
            row = np.empty(n, "int64")
            row[np.argsort(source, kind="stable")] = np.concatenate([o + b for o, b in zip(orders, base, strict=True)])
            earlier = least_of_runs(keys[row], common < LENGTH) < keys[row]
            found = row[earlier]
            found = found[(first[found] <= at) & (at <= last[found])]
            mask[found] |= np.uint32(1 << at)
    return mask


def least_of_runs(keys: np.ndarray, begins: np.ndarray) -> np.ndarray:
    begins = begins.copy()
    begins[0] = True
    at = np.flatnonzero(begins)
    return np.repeat(np.minimum.reduceat(keys, at), np.diff(np.append(at, len(keys))))


def merge_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """A bucket's contexts from all blocks -> what each block has to know of its contexts."""
    rows = rows.sort_values("block")
    unpack = _zstd()[1].decompress
    x = np.frombuffer(b"".join(unpack(z) for z in rows["contexts"]), np.dtype((np.void, CONTEXT)))
    keys, sizes = unpacked_pieces(rows["least"])
    # a context that several blocks sent is one row, with the least key, of its first sender
    x, first, which = np.unique(x, return_index=True, return_inverse=True)
    whole = np.full(len(x), np.iinfo("int64").max)
    np.minimum.at(whole, which, keys)
    shard = np.repeat(np.arange(len(sizes)), sizes)[first] % SHARDS
    order = np.argsort(shard, kind="stable")
    ends = np.cumsum(np.bincount(shard, minlength=SHARDS))[:-1]
    x = x[order].view("uint8").reshape(-1, CONTEXT)
    mask = np.empty(len(x), "uint32")
    mask[order] = merge([s for s in np.split(x, ends) if len(s)], whole[order])
    told = packed_pieces(*in_turn(whole[which], mask[which], [0, *np.cumsum(sizes).tolist()]))
    return pd.DataFrame({"block": rows["block"].to_numpy(), "uses": rows["uses"].to_numpy(), "told": told})


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the contexts, with its start there and the context's key."""
    for batch in batches:
        for bucket, block, z, least in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            x = np.frombuffer(zstandard.decompress(z), "uint8").reshape(-1, CONTEXT)
            first, last = (x[:, :LEFT] == OUTSIDE).sum(1), STARTS - 1 - (x[:, LEFT:] == OUTSIDE).sum(1)
            keys = unpacked(least)
            for at in range(STARTS):
                c = np.flatnonzero((first <= at) & (at <= last))
                offsets = np.arange(0, LENGTH * (len(c) + 1), LENGTH, dtype="int32")
                w = pa.Array.from_buffers(pa.binary(), len(c), [None, pa.py_buffer(offsets), pa.py_buffer(x[c, at : at + LENGTH].tobytes())])
                same = [pa.array(np.full(len(c), v, t)) for v, t in ((bucket, "int64"), (block, "int64"), (at, "int32"))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(c), pa.array(keys[c]), w], names=["bucket", "block", "at", "c", "least", "w"])


def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for least, n, seen in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
            mask = np.zeros(n, "int64")
            for x in seen or ():
                mask[x["c"]] = x["m"]
            out.append(packed(np.concatenate([unpacked(least), mask])))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], names=["block", "uses", "told"])


def match_windows(found: DataFrame) -> DataFrame:
    """What ``merge_bucket`` tells, for buckets with more contexts than a task should hold: a
    group is one window, and a block's least key of a context stands for that of all."""
    every = found.select("bucket", "block", "contexts", "least").mapInArrow(windows, "bucket long, block long, at int, c long, least long, w binary")
    shared = every.groupBy("at", "w").agg(F.min("least").alias("a"), F.max("least").alias("b")).where("a < b").select("at", "w", "a")
    seen = every.join(shared, ["at", "w"]).where("a < least").groupBy("bucket", "block", "c").agg(F.expr("bit_or(shiftleft(1L, at))").alias("m"))
    seen = seen.groupBy("bucket", "block").agg(F.collect_list(F.struct("c", "m")).alias("seen"))  # as many as a block's own contexts
    rows = found.join(seen, ["bucket", "block"], "left").select("block", "uses", "least", "n", "seen")
    return rows.mapInArrow(masks, TOLD)


def removed(block: Block, told: list) -> np.ndarray:
    """Which bytes of a block go."""
    if not told:
        return np.zeros(len(block.data), "bool")
    pos, which = halves(*(uses := unpacked_pieces(t["uses"] for t in told)))
    whole, mask = halves(*(of := unpacked_pieces(t["told"] for t in told)))
    which = which + np.repeat((np.cumsum(of[1]) - of[1]) // 2, uses[1] // 2)
    whole, mask = whole[which], mask[which].astype("uint32")
    doc = np.searchsorted(block.ends, pos, side="right")
    later = block.ids[doc] > whole  # an earlier document holds all of this context
    a = np.maximum(pos - LEFT, block.starts[doc])[later]
    b = np.minimum(pos + LENGTH, block.ends[doc])[later]
    fits = b - a >= LENGTH
    change = np.zeros(len(block.data) + 1, "int32")
    np.add.at(change, a[fits], 1)
    np.add.at(change, b[fits], -1)
    some = ~later & (mask > 0)
    pos, mask = pos[some], mask[some]
    for at in range(STARTS):
        start = pos[(mask >> np.uint32(at)) & np.uint32(1) == 1] - LEFT + at  # a place has one anchor, so none comes twice
        change[start] += 1
        change[start + LENGTH] -= 1
    return np.cumsum(change[:-1]) > 0


def kept_bytes(block: Block, told: list) -> Iterator[tuple[bytes, int, int, list[dict]]]:
    """For each document of a block: bytes that stay, all bytes, removed bytes, removed spans."""
    gone = removed(block, told)
    for a, b in zip(block.starts, block.ends, strict=True):
        g = gone[a:b]
        edges = np.flatnonzero(np.diff(g.astype("int8"), prepend=0, append=0))
        yield block.data[a:b][~g].tobytes(), int(b - a), int(g.sum()), [{"start": int(x), "end": int(y)} for x, y in edges.reshape(-1, 2)]


def told_blocks(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(ids, sizes, z, rest, told): every block with what is to know of its contexts."""
    spark = docs.sparkSession
    python_tasks(spark)
    table = stored_by(spark, blocks(docs, text, key), "blocks", "block")
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # two in STARTS + 1 positions are anchors
    bits = max(LEAST_BUCKET_BITS, math.ceil(math.log2(max(1, total * 2 / (STARTS + 1) / BUCKET_ANCHORS))))
    anchors = table.select("block", "ids", "sizes", "z").mapInArrow(send_anchors(bits), "bucket long, block long, anchors binary")
    hits = anchors.groupBy("bucket").applyInPandas(repeated, "bucket long, block long, hits binary")
    hits = hits.groupBy("block").agg(F.collect_list(F.struct("bucket", "hits")).alias("hits"))  # as many as a block's own anchors
    found = table.join(hits, "block").select("block", "ids", "sizes", "z", "hits")
    found = found.mapInArrow(send_contexts(bits), "bucket long, block long, contexts binary, least binary, uses binary, n long")
    found = stored(spark, found, "contexts")
    hot = found.groupBy("bucket").agg(F.sum("n").alias("of")).where(F.col("of") > BUCKET_CONTEXTS).select("bucket")
    hot = stored(spark, hot, "hot_buckets")
    told = found.join(hot, "bucket", "left_anti").groupBy("bucket").applyInPandas(merge_bucket, TOLD)
    if not hot.isEmpty():
        told = told.unionByName(match_windows(found.join(hot, "bucket", "left_semi")))
    told = told.groupBy("block").agg(F.collect_list(F.struct("uses", "told")).alias("told"))
    return table.join(told, "block", "left").select("ids", "sizes", "z", "rest", "told")


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, kept (the bytes that stay), n_bytes, n_removed, spans."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, z, told in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                block = Block(z, ids, sizes)
                out = [*kept_bytes(block, told)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.ids), pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64()),
                     pa.array([r[3] for r in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    names=["k", "kept", "n_bytes", "n_removed", "spans"],
                )

    docs = docs.select(F.col(key).cast("bigint").alias(key), F.col(text).cast("string").alias(text))
    schema = "k long, kept binary, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>"
    out = told_blocks(docs, text, key).mapInArrow(cut, schema)
    return out.withColumn("k", F.expr(f"nullif(k, cast('{FIRST_KEY}' as bigint))")).withColumnRenamed("k", key)


def cut_texts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with the bytes that stay as texts. A character of which a cut leaves a part
    goes; null texts become empty."""
    at = docs.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, z, rest, told in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                texts = pa.array([r[0].decode("utf-8", "ignore") for r in kept_bytes(Block(z, ids, sizes), told)], pa.string())
                with pa.ipc.open_stream(zstandard.decompress(rest)) as stream:
                    yield from stream.read_all().add_column(at, text, texts).combine_chunks().to_batches()

    return told_blocks(docs, text, key).mapInArrow(cut, docs.schema)
