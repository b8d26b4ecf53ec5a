"""A streaming source that tails growing line-delimited files.

``spark.readStream.format("jsonl_tail").option("path", folder)`` gives the lines of every
``*.jsonl`` below a folder as they are completed: (value, source_file, offset), ``offset``
being the byte where the line starts. The stream's offsets are a byte per file, kept in
the query's checkpoint, so a restart goes on where the last committed batch ended; nothing
else has to be remembered.

A file is read up to its last line end. What follows it waits, unless it is a whole JSON
object already (no whole object is the front of a longer one), so a last line without
line end is not held back for ever. A file that got shorter was written anew and is read from
its start; a file that is gone drops out. Events that are read twice are left out by their uuid
(K1). Ranges of more than PIECE bytes are read by several tasks, each the lines that start in
its piece.

Paths are opened through pyarrow's file systems (local, HDFS, S3, GCS by their URI).
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a file that one task reads.
PIECE = 64 << 20
#: Bytes looked at in one go when the last line end is searched.
BLOCK = 1 << 16


@dataclass
class Piece(InputPartition):
    path: str
    low: int  # the range of the file that the batch covers
    high: int
    start: int  # lines that start from here
    stop: int  # and before here


def _open(fs, path: str) -> io.BufferedReader:
    return io.BufferedReader(fs.open_input_file(path), BLOCK)


def complete_until(f, size: int) -> int:
    """Byte after the last complete line of the first ``size`` bytes."""
    at, tail = size, b""
    while at > 0:
        low = max(0, at - BLOCK)
        f.seek(low)
        tail = f.read(at - low) + tail
        cut = tail.rfind(b"\n")
        if cut >= 0:
            return size if _whole(tail[cut + 1 :]) else low + cut + 1
        at = low
    return size if _whole(tail) else 0


def _whole(rest: bytes) -> bool:
    try:
        return isinstance(json.loads(rest), dict)
    except ValueError:
        return False


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, suffix: str, piece: int):
        self.path, self.suffix, self.piece = path, suffix, piece
        self.seen: dict[str, tuple[int, int]] = {}  # size and end of a file when it was last looked at

    def _fs(self):
        from pyarrow import fs

        if "://" in self.path:
            system, root = fs.FileSystem.from_uri(self.path)
            return system, root, self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        return fs.LocalFileSystem(), self.path, "file://"

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, root, _ = self._fs()
        out = {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.type != fs.FileType.File or not info.path.endswith(self.suffix):
                continue
            size, end = self.seen.get(info.path, (-1, 0))
            if size != info.size:
                with _open(system, info.path) as f:
                    size, end = info.size, complete_until(f, info.size)
                self.seen[info.path] = size, end
            if end:
                out[info.path] = end
        return out

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for path, high in sorted(end.items()):
            low = start.get(path, 0)
            low = low if low <= high else 0  # shorter than it was: written anew
            out += [Piece(path, low, high, at, min(at + self.piece, high)) for at in range(low, high, self.piece)]
        return out

    def read(self, partition: Piece) -> Iterator[tuple]:
        system, _, scheme = self._fs()
        name = scheme + quote(partition.path) if scheme == "file://" else scheme + partition.path
        with _open(system, partition.path) as f:
            at = partition.start
            if at > partition.low:  # the line under way belongs to the piece before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            else:
                f.seek(at)
            while at < partition.stop:
                line = f.readline(partition.high - at)
                if not line:
                    break
                yield line.rstrip(b"\r\n").decode("utf-8", "replace"), name, at
                at += len(line)


class JsonlTail(DataSource):
    """Options: ``path``; ``suffix`` (.jsonl); ``pieceBytes``."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return "value string, source_file string, offset long"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], self.options.get("suffix", ".jsonl"), int(self.options.get("pieceBytes", PIECE)))


def tail_lines(spark, folder: str, **options):
    """The stream of completed lines below ``folder``."""
    from ..session import ship_package

    ship_package(spark)
    spark.dataSource.register(JsonlTail)
    return spark.readStream.format("jsonl_tail").options(path=folder, **options).load()
