"""The tailing source."""

import io
import json
import os
import tempfile

from test_ingest import event

from tracelens.sources import tail
from tracelens.streaming import ingest


def read_all(reader, start=None):
    end = reader.latestOffset()
    return [row for p in reader.partitions(start or {}, end) for row in reader.read(p)], end


def write(path, data, mode="ab"):
    with open(path, mode) as f:
        f.write(data)


def test_lines_up_to_the_last_line_end():
    root = tempfile.mkdtemp(prefix="tl tail-")
    path = os.path.join(root, "a.jsonl")
    write(path, b'{"a":1}\n\xc3\xa4\r\n\n{"half')
    write(os.path.join(root, "other.txt"), b"no\n")
    reader = tail.TailReader(root, ".jsonl", tail.PIECE)
    rows, end = read_all(reader)
    assert [(v, at) for v, _, at in rows] == [('{"a":1}', 0), ("ä", 8), ("", 12)] and end == {path: 13}
    assert rows[0][1] == "file://" + path.replace(" ", "%20")
    assert read_all(reader, end)[0] == []
    write(path, b'":2}\n')
    rows, end = read_all(reader, end)
    assert [(v, at) for v, _, at in rows] == [('{"half":2}', 13)]
    write(path, b'{"b":3}')  # a whole object without a line end
    rows, later = read_all(tail.TailReader(root, ".jsonl", tail.PIECE), end)
    assert [v for v, _, _ in rows] == ['{"b":3}']
    write(path, b"\n")
    assert [v for v, _, _ in read_all(reader, later)[0]] == [""]
    write(path, b'{"new":1}\n', "wb")  # shorter than before: read from the start
    assert [v for v, _, _ in read_all(reader, later)[0]] == ['{"new":1}']
    os.remove(path)
    assert reader.latestOffset() == {} and tail.TailReader(root + "/none", ".jsonl", 9).latestOffset() == {}


def test_pieces_give_every_line_once():
    root = tempfile.mkdtemp(prefix="tl-tail-")
    lines = ["x" * (i * 7 % 23) for i in range(200)]
    write(os.path.join(root, "a.jsonl"), "\n".join([*lines, ""]).encode())
    for piece in (1, 5, 16, 100, 10_000):
        rows, _ = read_all(tail.TailReader(root, ".jsonl", piece))
        assert [v for v, _, _ in rows] == lines and sorted({at for _, _, at in rows}) == [at for _, _, at in rows]


def test_last_line_end_is_found_across_blocks(monkeypatch):
    monkeypatch.setattr(tail, "BLOCK", 8)
    for data, want in ((b"", 0), (b"abc", 0), (b"abc\n", 4), (b"ab\n" + b"c" * 50, 3), (b"c" * 50 + b"\n", 51), (b"a\n" + b'{"k":"' + b"v" * 40 + b'"}', 50)):
        assert tail.complete_until(io.BytesIO(data), len(data)) == want


def test_a_growing_transcript_is_ingested_once(spark):
    land, root, ck = (tempfile.mkdtemp(prefix=f"tl-{n}-") for n in ("land", "store", "ck"))
    path = os.path.join(land, "projects", "-home-dev-app")
    os.makedirs(path)
    path = os.path.join(path, "s1.jsonl")
    rows = [event(u, "s1", i + 1, kind="assistant" if i % 2 else "user") for i, u in enumerate("abc")]
    late = json.dumps({"uuid": "r", "sessionId": "s1", "type": "user", "timestamp": "2026-04-20T10:30:00Z", "cwd": "/home/dev/app",
                       "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "done"}]}})
    use = json.dumps({"uuid": "t", "sessionId": "s1", "type": "assistant", "timestamp": "2026-04-20T10:20:00Z", "cwd": "/home/dev/app",
                      "message": {"role": "assistant", "model": "claude-sonnet-4-5", "content": [{"type": "tool_use", "id": "t1", "name": "Read", "input": {}}]}})

    def catch_up():
        ingest.start_live_ingest(spark, land, root, ck, host="local", trigger={"availableNow": True}).awaitTermination(300)
        s = ingest.open_store(spark, root)
        return sorted(r.uuid for r in s["events"].collect()), [tuple(r) for r in s["sessions"].select("message_count", "tool_call_count").collect()], s

    write(path, (rows[0] + "\n" + rows[1][:40]).encode())  # half a line
    assert catch_up()[:2] == (["a"], [(1, 0)])
    write(path, (rows[1][40:] + "\n" + use + "\n").encode())  # its rest
    assert catch_up()[:2] == (["a", "b", "t"], [(3, 1)])
    write(path, (late + "\n" + rows[2]).encode())  # no line end, yet a whole object
    uuids, sessions, store = catch_up()
    assert (uuids, sessions) == (["a", "b", "c", "r", "t"], [(5, 1)])
    assert [(r.result, r.duration_ms) for r in store["tool_calls"].collect()] == [("done", 600_000)]  # paired across batches
    # the same files by a backfill: one name for a file, nothing new
    assert ingest.backfill(spark, land, root) == 0
