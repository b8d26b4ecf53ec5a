"""Segments, steps, key buckets and the maintained text index of a table store."""

import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from test_ingest import event, lines, tables

from tracelens.functions.dates import TimeWindow
from tracelens.operators import keys, search, sinks
from tracelens.streaming import ingest, store


def on_day(uuid, session, day, text):
    return json.dumps({"uuid": uuid, "sessionId": session, "type": "user", "timestamp": f"2026-04-{day:02d}T10:00:00Z", "cwd": "/home/dev/app",
                       "message": {"role": "user", "content": text}})


def batches():
    """Four batches over sessions, days and common words; some uuids come again."""
    out = []
    for b in range(4):
        rows = [on_day(f"e{b}-{i}", f"s{i % 5}", 1 + (b * 3 + i) % 9, f"outputs of step {i} running für {b}") for i in range(12)]
        out.append(rows + [on_day(f"e{b - 1}-3", "s9", 20, "again")] * (b > 0))
    return out


def rows_of(df):
    return sorted(map(repr, map(tuple, df.select(*sorted(df.columns)).collect())))


@pytest.fixture(scope="module")
def grown(spark):
    """A store of four batches with tiny buckets and eager merging, what its steps read, and the
    store of one batch with the same events."""
    patch = pytest.MonkeyPatch()
    patch.setattr(keys, "BUCKET_KEYS", 5)
    patch.setattr(store, "FAN", 3)
    read, seen = store.Snapshot.read, []

    def spy(self, table, schema, parts=None, only=None):
        seen.append((table, only is not None, self.folders(table, parts, only)))
        return read(self, table, schema, parts, only)

    root, whole = tempfile.mkdtemp(prefix="tl-grown-"), tempfile.mkdtemp(prefix="tl-whole-")
    reads, counts, snapshots = [], [], []
    for rows in batches():
        patch.setattr(store.Snapshot, "read", spy)
        seen.clear()
        counts.append(ingest.ingest_lines(spark, lines(spark, rows), root, buckets=2))
        reads.append(list(seen))
        patch.setattr(store.Snapshot, "read", read)
        snapshots.append(store.snapshot(spark, root))
    patch.undo()
    one = [r for rows in batches() for r in rows[:12]]
    ingest.ingest_lines(spark, lines(spark, one), whole)
    return root, whole, reads, counts, snapshots


def test_batches_and_one_shot_give_the_same_tables(spark, grown):
    root, whole, _, counts, _ = grown
    assert counts == [12] * 4
    assert tables(spark, root) == tables(spark, whole)
    a, b = ingest.open_store(spark, root), ingest.open_store(spark, whole)
    for t in ("text_index", "text_index_english", "corpus_stats"):
        assert rows_of(a[t]) == rows_of(b[t]), t
    total = lambda df: rows_of(df.groupBy("analyzer", "term").sum("n_t"))
    assert total(a["term_counts"]) == total(b["term_counts"])
    # the maintained index is the one built over all messages
    assert rows_of(a["text_index"]) == rows_of(search.build_index(a["messages"]))
    assert rows_of(a["text_index_english"]) == rows_of(search.build_index(a["messages"], analyzer="english"))


def test_a_step_reads_no_stored_events(grown):
    _, _, reads, _, _ = grown
    for seen in reads:
        stored = {table for table, own, folders in seen if not own and folders}
        assert stored <= {"event_keys", "key_blooms"}


def test_keys_grow_bucket_by_bucket(spark, grown):
    root, _, _, _, snapshots = grown
    number = [keys.count_of(s.keys["first"], s.keys["level"], s.keys["split"]) for s in snapshots]
    assert number[0] < number[-1] and number[-1] >= 8 and snapshots[-1].keys["n"] == 48
    now, schemas = snapshots[-1], ingest.table_schemas(spark)
    for table in ("event_keys", "key_blooms"):
        assert all(s.parts for s in now.segments[table])
    held = now.read("event_keys", schemas["event_keys"])
    again = keys.with_key_columns(held.select("uuid"), "uuid", now.keys["first"], now.keys["level"], now.keys["split"])
    assert rows_of(held) == rows_of(again.select(*held.columns)) and held.select("uuid").distinct().count() == held.count() == 48


def test_split_leaves_other_buckets_alone(spark, monkeypatch):
    monkeypatch.setattr(keys, "BUCKET_KEYS", 20)
    root = tempfile.mkdtemp(prefix="tl-split-")
    ingest.ingest_lines(spark, lines(spark, [event(f"u{i}", "s", i % 60) for i in range(30)]), root, buckets=2)
    before = store.snapshot(spark, root)
    ingest.ingest_lines(spark, lines(spark, [event(f"v{i}", "s", i % 60) for i in range(15)]), root)
    now = store.snapshot(spark, root)
    assert (now.keys["first"], now.keys["level"], now.keys["split"], now.keys["n"]) == (2, 0, 1, 45)
    first = before.segments["event_keys"][0]
    assert first.parts == ("0", "1") and [s.parts for s in now.segments["event_keys"] if s.name == first.name] == [("1",)]
    assert ingest.ingest_lines(spark, lines(spark, [event(f"u{i}", "t", i % 60) for i in range(30)]), root) == 0


def test_filter_spares_the_key_buckets_of_new_uuids(spark, monkeypatch):
    held = keys.with_key_columns(spark.range(5000).selectExpr("concat('k', id) as uuid"), "uuid", 4, 0, 2)
    filters = keys.blooms(held)
    assert keys.maybe_known(held, filters).count() == 5000
    new = keys.with_key_columns(spark.range(5000).selectExpr("concat('n', id) as uuid"), "uuid", 4, 0, 2)
    assert keys.maybe_known(new, filters).count() < 100
    monkeypatch.setattr(keys, "BLOCKS", 1250)  # as full as a bucket gets: 16 bits a key
    full = keys.with_key_columns(held.select("uuid"), "uuid", 1, 0, 0)
    new = keys.with_key_columns(new.select("uuid"), "uuid", 1, 0, 0)
    assert keys.maybe_known(full, keys.blooms(full)).count() == 5000
    assert keys.maybe_known(new, keys.blooms(full)).count() < 150


def test_linear_hashing_moves_keys_of_the_split_bucket_only(spark):
    uuids = spark.range(2000).selectExpr("md5(string(id)) as uuid")
    state, was = (2, 0, 0), None
    for _ in range(9):
        got = {r.uuid: r.key_bucket for r in keys.with_key_columns(uuids, "uuid", *state).collect()}
        assert set(got.values()) == set(range(keys.count_of(*state)))
        if was is not None:
            moved = {u for u in got if got[u] != was[u]}
            assert {was[u] for u in moved} == {split} and {got[u] for u in moved} == {keys.count_of(*state) - 1}
        was, split = got, state[2]
        first, level, at = state[0], state[1], state[2] + 1
        state = (first, level + 1, 0) if at == first << level else (first, level, at)


def test_merging_bounds_the_segments(spark, grown):
    root, _, _, _, snapshots = grown
    for table in ("events", "session_parts", "text_postings", "text_totals"):
        assert len(snapshots[-1].segments[table]) <= 2 and max(s.level for s in snapshots[-1].segments[table]) == 1
    orphans = store.vacuum(spark, root, keep=1)
    assert orphans > 0 and store.vacuum(spark, root, keep=1) == 0
    assert ingest.open_store(spark, root)["events"].count() == 48


def test_a_window_opens_its_days_only(spark, grown):
    root = grown[0]
    window = TimeWindow(dt.datetime(2026, 4, 3), dt.datetime(2026, 4, 5, 23))
    some, all_ = ingest.open_store(spark, root, window), ingest.open_store(spark, root)
    for t in ("events", "messages"):
        days = {f.split("day=")[1].split("/")[0] for f in some[t].inputFiles()}
        assert days == {"2026-04-03", "2026-04-04", "2026-04-05"}
        assert len(some[t].inputFiles()) < len(all_[t].inputFiles())
        inside = "timestamp >= '2026-04-03' and timestamp <= '2026-04-05 23:00:00'"
        assert sorted(r.uuid for r in some[t].where(inside).collect()) == sorted(r.uuid for r in all_[t].where(inside).collect())


def test_readers_see_whole_steps(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="tl-snap-")
    ingest.ingest_lines(spark, lines(spark, [event("a", "s1", 1), event("b", "s2", 2)]), root)
    old = tables(spark, root)
    append, between = sinks.append, []

    def watched(df, path, partition_by=None):
        between.append(store.snapshot(spark, root).step)
        append(df, path, partition_by)
        s = store.snapshot(spark, root)
        between.append(s.step)
        if path.split("/")[-2] in ("events", "session_parts", "term_counts"):
            got = ingest.open_snapshot(s)
            between.append((got["events"].count(), got["sessions"].count(), got["corpus_stats"].first().n_docs))

    monkeypatch.setattr(sinks, "append", watched)
    ingest.ingest_lines(spark, lines(spark, [event("c", "s1", 3), event("d", "s3", 4, kind="assistant")]), root)
    monkeypatch.setattr(sinks, "append", append)
    assert set(between) == {1, (2, 2, 2)}
    assert len(tables(spark, root)["events"]) == 4 and store.snapshot(spark, root).step == 2
    earlier = ingest.open_snapshot(store.snapshot(spark, root, step=1))
    assert sorted(map(repr, map(tuple, earlier["sessions"].select("session_id", "message_count").collect()))) == ["('s1', 1)", "('s2', 1)"]
    assert len(old["events"]) == 2
    # a second writer of the same step is turned away
    stale = store.Step(store.snapshot(spark, root, step=1))
    with pytest.raises(RuntimeError, match="another writer"):
        stale.commit()


def test_search_reads_the_stored_index(spark, grown, capsys):
    from tracelens.__main__ import _catalog
    from tracelens.plans.search import count_results, search as find

    cat = _catalog(spark, grown[0])
    plain = type(cat).from_tables(spark, messages=cat.messages, sessions=cat.sessions)  # index built for the query
    for q, analyzer in (("running step", "simple"), ("FÜR outputs", "simple"), ("output runs", "english")):
        assert rows_of(find(cat, q, analyzer=analyzer)) == rows_of(find(plain, q, analyzer=analyzer))
        assert count_results(cat, q, analyzer=analyzer).first().n > 0
    assert "text_postings" in find(cat, "running step")._jdf.queryExecution().executedPlan().toString() or any(
        "text_postings" in f for f in cat.text_index.inputFiles())
    assert os.path.isdir(f"{grown[0]}/text_postings")


def test_english_postings_of_a_query_leave_other_words_alone(spark):
    texts = ["outputs of steps", "an output, the errors", "erroring output output", "nothing here", None]
    docs = spark.createDataFrame([(f"u{i}", t) for i, t in enumerate(texts)], "uuid string, text_content string")
    terms = ["output", "error"]
    some = search.build_index(docs, analyzer="english", terms=terms)
    assert rows_of(some) == rows_of(search.build_index(docs, analyzer="english").filter(F.col("term").isin(terms)))
    assert rows_of(search.build_index(docs, terms=["output"])) == rows_of(search.build_index(docs).filter("term = 'output'"))
    # the stemmer runs once, over distinct words, and what is shuffled by document is the query's
    plan = search.match_and_rank(some, search.corpus_stats(docs), terms)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # the postings and their document frequencies
    filtered = search.build_index(docs, analyzer="english").filter(F.col("term").isin(terms))
    assert filtered._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1  # not the postings as well


def test_a_store_keeps_the_tables_it_is_asked_for(spark):
    rows = [on_day(f"k{i}", f"s{i % 3}", 1 + i % 4, f"outputs of step {i}") for i in range(9)]
    root, whole = tempfile.mkdtemp(prefix="tl-some-"), tempfile.mkdtemp(prefix="tl-all-")
    for batch in (rows[:6], rows[3:], rows[:6]):
        ingest.ingest_lines(spark, lines(spark, batch), root, tables=["text_postings", "session_parts"])
        ingest.ingest_lines(spark, lines(spark, batch), whole)
    some, all_ = ingest.open_store(spark, root), ingest.open_store(spark, whole)
    assert {"events", "messages", "sessions", "text_index"} <= set(some)
    assert not {"changes", "usage_daily", "term_counts", "corpus_stats", "text_index_english"} & set(some)
    for t in ("messages", "sessions", "text_index"):
        assert rows_of(some[t]) == rows_of(all_[t]), t
    with pytest.raises(ValueError, match="doesn't keep"):  # its earlier events would be missing
        ingest.ingest_lines(spark, lines(spark, rows), root, tables=["changes"])
    with pytest.raises(ValueError, match="unknown"):
        ingest.ingest_lines(spark, lines(spark, rows), tempfile.mkdtemp(), tables=["nothing"])


def test_a_replay_writes_no_events_and_a_batch_its_rows_once(spark, monkeypatch):
    root, wrote, write = tempfile.mkdtemp(prefix="tl-replay-"), [], store.Step.write

    def spy(self, table, df, level=0):
        wrote.append((table, df._jdf.queryExecution().executedPlan().toString()))
        return write(self, table, df, level)

    monkeypatch.setattr(store.Step, "write", spy)
    rows = [event(f"r{i}", "s", i % 60) for i in range(20)]
    assert ingest.ingest_lines(spark, lines(spark, rows), root) == 20
    plans = dict(wrote)
    # parsed rows are not sorted or moved to find what is new; a frequent word's postings go to several ranges
    assert "Exchange" not in plans[ingest.BATCH] and "Sort" not in plans[ingest.BATCH]
    assert plans["events"].count("Exchange") == 1 and "Exchange" not in plans["messages"] + plans["tool_uses"] + plans["changes"]
    assert "uuid" in plans["text_postings"].split("rangepartitioning(")[1].split(")")[0]
    wrote.clear()
    assert ingest.ingest_lines(spark, lines(spark, rows), root) == 0
    assert [t for t, _ in wrote] == [ingest.BATCH] and not os.listdir(f"{root}/{ingest.BATCH}")


def test_a_batch_splits_its_key_buckets_at_once(spark, monkeypatch):
    monkeypatch.setattr(keys, "BUCKET_KEYS", 4)
    root, added, add = tempfile.mkdtemp(prefix="tl-rounds-"), [], store.Step.add
    ingest.ingest_lines(spark, lines(spark, [event(f"a{i}", "s", i) for i in range(8)]), root, buckets=1)
    assert store.snapshot(spark, root).keys["first"] == 2  # as many as the first batch fills
    monkeypatch.setattr(store.Step, "add", lambda self, table, df: added.append(table) or add(self, table, df))
    ingest.ingest_lines(spark, lines(spark, [event(f"b{i}", "s", i) for i in range(24)]), root)
    now = store.snapshot(spark, root)
    assert (now.keys["level"], now.keys["split"], now.keys["n"]) == (2, 0, 32) and added == ["event_keys", "key_blooms"] * 2
    held = now.read("event_keys", ingest.table_schemas(spark)["event_keys"])
    again = keys.with_key_columns(held.select("uuid"), "uuid", 2, 2, 0)
    assert rows_of(held) == rows_of(again.select(*held.columns)) and held.count() == 32
    assert ingest.ingest_lines(spark, lines(spark, [event(f"b{i}", "s", i) for i in range(24)]), root) == 0


def test_payloads_are_written_as_they_are(spark):
    import glob

    import pyarrow.parquet as pq

    root = tempfile.mkdtemp(prefix="tl-plain-")
    ingest.ingest_lines(spark, lines(spark, [event(f"u{i}", "s", i % 60) for i in range(30)]), root)
    files = glob.glob(f"{root}/events/seg=*/day=*/*.parquet")
    fields = {p for f in files for p in (c.path for c in pq.ParquetFile(f).schema) if p.startswith("payload.")}
    assert fields == {"payload.value", "payload.metadata"}


def test_postings_are_shuffled_once_and_split_once(spark):
    docs = spark.createDataFrame([("a", "two two words"), ("b", ""), ("c", None), ("a", "two"), (None, "Words")], "uuid string, text_content string")
    makes = {"text_postings": search.build_index, "text_postings_english": lambda d, ranged: search.stem_postings(search.build_index(d), ranged=ranged)}
    for table, make in makes.items():
        assert rows_of(make(docs, ranged=True)) == rows_of(make(docs, ranged=False)), table
    rows = ingest._dealt("text_postings", ingest.WAVES[1]["text_postings"](spark, {"messages": docs}), stay=True)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "rangepartitioning" in plan and plan.count("regexp_extract_all") == 1


def test_a_step_looks_up_a_lines_fields_once(spark, monkeypatch):
    root, plans, write = tempfile.mkdtemp(prefix="tl-once-"), {}, store.Step.write

    def spy(self, table, df, level=0):
        plans[table] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(self, table, df, level)

    monkeypatch.setattr(store.Step, "write", spy)
    assert ingest.ingest_lines(spark, lines(spark, [event(f"o{i}", "s", i % 60) for i in range(20)]), root) == 20
    # what a replay would do for nothing is left to the new lines, and a condition computes no field again
    assert "gitBranch" not in plans[ingest.BATCH] and plans[ingest.BATCH].count("try_variant_get") == 1
    assert "gitBranch" in plans["events"]
    # a part that is cast to VARIANT is built anew: none but the fields that need one
    for table in ("events", "messages", "tool_uses", "tool_results"):
        assert "ArrayType(VariantType" not in plans[table], table


def test_session_states_need_no_join_of_events_and_messages(spark):
    make = next(wave["session_parts"] for wave in ingest.WAVES if "session_parts" in wave)
    schemas = ingest.table_schemas(spark)
    t = {name: spark.createDataFrame([], schemas[name]) for name in ("events", "messages", "tool_uses")}
    plan = make(spark, t)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # the prices


def test_session_states_equal_those_of_joined_tables(spark):
    from tracelens.operators import derive
    from tracelens.sources import transcripts as tr
    from tracelens.sources.pricing import model_pricing

    def row(i, kind, message, **more):
        return json.dumps({"uuid": f"j{i}", "sessionId": f"s{i % 3}", "type": kind, "timestamp": f"2026-04-01T10:00:{i:02d}Z", "message": message, **more})

    use = {"type": "tool_use", "id": "t", "name": "Read", "input": {"file_path": "/a"}}
    tokens = {"input_tokens": 7, "output_tokens": 2, "cache_read_input_tokens": "3", "cache_creation_input_tokens": 1e12}
    messages = [{"role": "assistant", "model": "claude-opus-4-6", "usage": tokens, "content": [use, 5, None, {"type": "text", "text": 5}, use]},
                {"role": "user", "model": "m", "usage": [1], "content": [{"type": "tool_result", "content": [{"text": "in"}, {"text": 1}, "x"]}]},
                {"role": 5, "content": "plain"}, "no object", None, ["odd"], {"content": {"type": "tool_use"}}, {"content": 5}]
    rows = [row(i, kind, m, cwd=f"/{i}") for i, (kind, m) in enumerate((k, m) for k in ("user", "assistant", "progress") for m in messages)]
    events = tr.to_events(tr.parse_lines(lines(spark, rows)), host="h")
    prices = model_pricing(spark)
    joined = derive.session_parts(events, tr.derive_messages(events), tr.extract_first_uses(events), prices)
    found = derive.session_parts_lines(tr.session_lines(events), prices)
    assert rows_of(found) == rows_of(joined) and found.schema == joined.schema
    texts = {r.uuid: r.text_content for r in tr.derive_messages(events).collect()}
    assert texts == {f"j{i}": t for k in (0, 8) for i, t in ((k, ""), (k + 1, "in"), (k + 2, "plain"), (k + 3, ""), (k + 5, ""), (k + 6, ""), (k + 7, ""))}
