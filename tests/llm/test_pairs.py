"""Operators on pairs of rows against brute force."""

import random
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard

from tracelens.llm import chosen_path, neighbours, repeats, reputation
from tracelens.llm.components import components, joined_components


def union(n, pairs):
    parent = {i: i for i in n}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)] + [(7, 7)]
    want = union({x for e in edges for x in e}, edges)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: c for i, c in want.items() if i in got}
    assert {i for e in edges if e[0] != e[1] for i in e} == set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def sets_of(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def near_copies(rng):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = [None, "", " \t", "one two", "ONE  two", "Ünï one", "ünï one"]
    for _ in range(30):
        base = [word() for _ in range(rng.randrange(6, 120))]
        for _ in range(rng.randrange(1, 6)):
            t = base[:]
            for _ in range(rng.randrange(0, 1 + len(base) // 40)):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
    hub = [word() for _ in range(150)]
    for _ in range(60):  # a group beyond LEAF below
        t = hub[:]
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = word()
        texts.append(" ".join(t))
    return texts


def test_chosen_path_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "LEAF", 16)
    texts = near_copies(random.Random(2))
    s = sets_of(texts)
    pairs = [(i, j) for i in range(len(s)) for j in range(i) if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j])]
    want = union(range(len(s)), pairs)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, id string, n long")
    got = {r.doc_id: r for r in chosen_path.near_duplicates(df).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(s[i]) and r.kept == (r.component_id == i) for i, r in got.items())


def test_chosen_path_overlaps(monkeypatch):
    monkeypatch.setattr(chosen_path, "RANGE", 50)
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 90, dtype="uint64") << np.uint64(1)
    sets = [np.unique(rng.choice(pool, k)) for k in (0, 1, 40, 90, 300)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert chosen_path.overlaps(sets, np.array([1, 3, 4])).tolist() == [want[1], want[3], want[4]]


def test_chosen_path_trees_follow_from_the_target():
    rng = random.Random(1)
    two, lost, n = chosen_path.second(85) / 100, 0, 20_000
    for _ in range(n):  # common paths of a pair at the threshold
        paths = 1
        for _ in range(3):
            paths = sum(rng.random() < 0.85 for _ in range(paths) for _ in range(1 + (rng.random() < two)))
        lost += not paths
    for target in (0.9, 0.999):
        k = chosen_path.trees(85, 3, target)
        assert 1 - (lost / n) ** k > target - 0.005 and 1 - (lost / n) ** (k - 1) < target + 0.005


def test_template_and_straggling_copies_equal_brute_force(spark, monkeypatch):
    """Documents of one template, most of them alike just below the threshold, and a large
    group of copies with members that hang on by a few others."""
    for name, value in {"LEAF": 8, "BLOCK": 16, "HELD": 16, "DEPTH": 5, "SHALLOW": 2}.items():
        monkeypatch.setattr(chosen_path, name, value)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = []
    for changes, n in ((3, 60), (1, 60)):
        base = [word() for _ in range(150)]
        for i in range(n):
            t = base[:]
            for _ in range(changes + (i % 9 == 0)):
                t[rng.randrange(150)] = word()
            texts.append(" ".join(t))
    s = sets_of(texts)
    pairs = [(i, j) for i in range(len(s)) for j in range(i) if 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j])]
    want = union(range(len(s)), pairs)
    sent = []
    candidates = chosen_path.Join.candidates

    def counted(self, rows):
        out = chosen_path.stored(spark, candidates(self, rows), "test")
        sent.append((rows.count(), out.count()))
        return out

    monkeypatch.setattr(chosen_path.Join, "candidates", counted)
    got = chosen_path.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == want
    assert all(out <= 5 * rows for rows, out in sent)  # a forest of each node at most


def test_large_nodes_on_the_way_are_left_out(spark):
    """Of a step's large nodes those of its last level count; their children cover the others."""
    docs = [(i, " ".join([f"w{j}" for j in range(120)] + [f"t{i}"])) for i in range(60)]
    join = chosen_path.Join(spark.createDataFrame(docs, "doc_id long, text string"), 85, "text", "doc_id")
    rows = join.step(join.start([*range(4)], None), 3).collect()
    assert any(r["size"] > chosen_path.LEAF for r in rows)
    assert all(r["last"] for r in rows if r["size"] > chosen_path.LEAF)
    rows = join.step(join.start([*range(4)], None), 2, small=False).collect()
    assert rows and all(r["last"] and r["size"] > chosen_path.LEAF for r in rows)


def test_chosen_path_join_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert chosen_path.near_duplicates(empty).count() == 0
    t = "a b c d e f g h"
    df = spark.createDataFrame([(4, t), (2, t), (2, t), (None, t), (9, None), (8, "")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in chosen_path.near_duplicates(df).collect())
    assert got == [(-1, 4, None, True), (2, 4, 2, True), (2, 4, 2, True), (4, 4, 2, False), (8, 0, 8, True), (9, 0, 9, True)]


def brute_repeats(rows):
    """rows (id, bytes) -> id -> flags of removed bytes."""
    first = {}
    for i, x in rows:
        for p in range(len(x) - 49):
            w = x[p : p + 50]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, x in rows:
        gone = bytearray(len(x))
        for p in range(len(x) - 49):
            if first[x[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        out[i] = gone
    return out


def passages(rng, n):
    chars = "ab cé\n"
    part = lambda k: "".join(rng.choice(chars) for _ in range(k))
    shared = [part(rng.choice([48, 49, 50, 51, 70, 200])) for _ in range(12)]
    out = [None, "", "x" * 49, "x" * 50, "x" * 120, "x" * 51]
    for _ in range(n):
        out.append("".join(rng.choice([lambda: part(rng.randrange(60)), lambda: rng.choice(shared), lambda: (s := rng.choice(shared))[rng.randrange(9):]])()
                           for _ in range(rng.randrange(1, 5))))
    return out + out[20:25]


def test_repeats_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 2000)
    rng = random.Random(3)
    texts = passages(rng, 150)
    ids = rng.sample(range(-50, 5000), len(texts))
    want = brute_repeats([(i, (t or "").encode()) for i, t in zip(ids, texts, strict=True)])
    df = spark.createDataFrame(list(zip(ids, texts, ids, strict=True)), "doc_id long, text string, block long").repartition(3)
    got = {r.doc_id: r for r in repeats.without_repeats(df).collect()}
    assert len(got) == len(ids)
    for i, t in zip(ids, texts, strict=True):
        x, gone = (t or "").encode(), want[i]
        assert got[i].kept == bytes(c for c, g in zip(x, gone, strict=True) if not g), i
        assert (got[i].n_bytes, got[i].n_removed) == (len(x), sum(gone))
        assert sum(s.end - s.start for s in got[i].spans) == sum(gone)
    cut = {r.doc_id: r for r in repeats.cut_texts(df).collect()}
    assert all(cut[i].text == got[i].kept.decode("utf-8", "ignore") and cut[i].block == i for i in ids)


def test_large_buckets_are_dealt_out_by_windows(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(repeats, "BUCKET_CONTEXTS", 12, raising=False)
    merged = repeats.merge_bucket

    def bounded(rows):
        assert sum(len(repeats.unpacked(z)) for z in rows["least"]) <= 12
        return merged(rows)

    monkeypatch.setattr(repeats, "merge_bucket", bounded)
    rng = random.Random(8)
    phrase = "all rights reserved."
    texts = passages(rng, 60) + ["".join(rng.choices("abc", k=70)) + phrase + "".join(rng.choices("abc", k=70)) for _ in range(60)]
    texts += [t[20:] + "!" for t in texts[-20:]]
    want = brute_repeats([(i, (t or "").encode()) for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in repeats.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    for i, t in enumerate(texts):
        assert got[i].kept == bytes(c for c, g in zip((t or "").encode(), want[i], strict=True) if not g), i


def test_pairs_of_blocks_and_buckets_are_not_worked_on_one_by_one():
    """Their number grows with the square of the corpus: a pair may be packed and unpacked only."""
    rng = random.Random(5)
    shared = ["".join(rng.choices("abcdefgh ", k=400)) for _ in range(40)]
    texts = [(rng.choice(shared) + "".join(rng.choices("xyz ", k=30)) + rng.choice(shared)).encode() for _ in range(120)]
    want = brute_repeats(list(enumerate(texts)))
    sent = pa.record_batch({
        "block": pa.array([1], pa.int64()), "ids": pa.array([np.arange(len(texts)).tobytes()], pa.binary()),
        "sizes": pa.array([np.array([len(t) for t in texts]).tobytes()], pa.binary()), "z": pa.array([zstandard.compress(b"".join(texts))], pa.binary())})
    calls = {}
    for bits in (2, 10):
        made = 0

        def count(frame, event, arg):
            nonlocal made
            made += event in ("call", "c_call")

        anchors = pd.concat(b.to_pandas() for b in repeats.send_anchors(bits)(iter([sent])))
        hits = pd.concat(repeats.repeated(rows) for _, rows in anchors.groupby("bucket"))
        of = sent.append_column("hits", pa.array([hits[["bucket", "hits"]].to_dict("records")]))
        sys.setprofile(count)
        try:
            found = pd.concat(b.to_pandas() for b in repeats.send_contexts(bits)(iter([of])))
            sys.setprofile(None)
            told = pd.concat(repeats.merge_bucket(rows) for _, rows in found.groupby("bucket")).to_dict("records")
            sys.setprofile(count)
            gone = repeats.removed(repeats.Block(*(sent.column(i)[0].as_py() for i in (3, 1, 2))), told)
        finally:
            sys.setprofile(None)
        assert gone.tobytes() == b"".join(want[i] for i in range(len(texts)))
        calls[len(told)] = made
    (few, a), (many, b) = sorted(calls.items())
    assert many > 20 * few and (b - a) / (many - few) < 60, calls


def test_repeats_of_odd_tables(spark):
    assert repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    t = "".join(chr(97 + i % 26) for i in range(60))
    df = spark.createDataFrame([(3, t), (3, t), (None, "0" * 60), (4, "0" * 60), (5, t + "!")], "doc_id long, text string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_removed) for r in repeats.without_repeats(df).collect())
    assert got == [(-1, 0), (3, 0), (3, 0), (4, 60), (5, 60)]


def test_merged_transforms_equal_sorting():
    rng = np.random.default_rng(4)
    base = rng.integers(97, 99, (6, repeats.CONTEXT)).astype("uint8")
    rows = base[rng.integers(0, 6, 300)].copy()
    rows[np.arange(300), rng.integers(0, repeats.CONTEXT, 300)] = 99
    rows[:20, :5] = repeats.OUTSIDE
    keys = rng.integers(0, 50, 300)
    mask = repeats.merge([rows[:100], rows[100:110], rows[110:]], keys)
    for i in range(300):
        for at in range(repeats.STARTS):
            w = rows[i, at : at + repeats.LENGTH]
            least = min(k for r, k in zip(rows, keys, strict=True) if (r[at : at + repeats.LENGTH] == w).all())
            assert bool(mask[i] >> at & 1) == (least < keys[i] and not (w == repeats.OUTSIDE).any())


def test_near_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 24)
    monkeypatch.setattr(neighbours, "K", 6)
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((150, 16))
    x = np.concatenate([x, x[:30] + 0.02 * rng.standard_normal((30, 16)), x[0] + 0.05 * rng.standard_normal((50, 16)), x[5:8] * 3]).astype("float32")
    label = [int(v) for v in rng.integers(0, 2, len(x))]
    label[180:230] = [0] * 50
    rows = [(i, [float(c) for c in v], y, "x") for i, (v, y) in enumerate(zip(x, label, strict=True))]
    rows += [(900, None, 0, "x"), (901, [0.0] * 16, 0, "x"), (902, [float("nan")] * 16, 0, "x"), (903, [None] + [1.0] * 15, 0, "x"), (904, rows[0][1], None, "x"), (905, [1.0, 2.0], 0, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id string")
    u = x.astype("float64")
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = (u @ u.T >= 0.98) & (np.array(label)[:, None] == np.array(label)[None, :])
    np.fill_diagonal(near, False)
    want = union(range(len(x)), zip(*np.nonzero(near), strict=True))
    got = {r.vec_id: r for r in neighbours.near_vectors(df).collect()}
    assert len(got) == len(rows)
    assert [got[i].n_links for i in range(len(x))] == near.sum(1).tolist()
    assert {i: got[i].component_id for i in range(len(x))} == want
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(900, 906))
    assert neighbours.near_vectors(df.limit(0)).count() == 0


def close_pairs(rng, dense):
    """Pairs among vectors that lie close together, but under the threshold: signs hardly part
    them, so that few pairs share a leaf. And a group of ``dense`` near-equal vectors."""
    base = 1 + 0.3 * rng.standard_normal((120, 16))
    x = np.concatenate([base, base + 0.01 * rng.standard_normal((120, 16)), rng.standard_normal(16) + 0.001 * rng.standard_normal((dense, 16))])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.98
    np.fill_diagonal(near, False)
    return x, near


def assert_all_links(spark, monkeypatch, x, near):
    for name, value in {"LEAF": 4, "TREES": 1, "ROUNDS": 0, "K": 6, "BLOCK": 64}.items():
        monkeypatch.setattr(neighbours, name, value)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in neighbours.near_vectors(df).collect()}
    assert [got[i].n_links for i in range(len(near))] == near.sum(1).tolist()
    assert {i: got[i].component_id for i in got} == union(range(len(near)), zip(*np.nonzero(near), strict=True))


def test_links_that_every_attempt_lost_are_found(spark, monkeypatch):
    assert_all_links(spark, monkeypatch, *close_pairs(np.random.default_rng(6), 0))


def test_a_dense_group_does_not_hide_lost_links(spark, monkeypatch):
    assert_all_links(spark, monkeypatch, *close_pairs(np.random.default_rng(7), 500))


def test_rules_and_reputation(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/x?y", "https://example.org/en/12#z", "ftp://org/", "http://org", "http://x.com/fr/1", "http://x.com/de/",
            "http://xcom/de/", "a://b://c/d", "http://h.net?q=/x", "http://H.NET#/x", "http://Ünïcode.NET/É"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in reputation.judge(df).collect()}
    assert [got[i] for i in range(len(urls))] == [
        ("", "", None), ("", "", None), ("", "", None), ("a.example.org", "/es/x", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"),
        ("org", "/", "org/"), ("org", "", None), ("x.com", "/fr/1", "com/fr/"), ("x.com", "/de/", "com/de/"), ("xcom", "/de/", None), ("b:", "//c/d", None),
        ("h.net", "", None), ("h.net", "", None), ("Ünïcode.net".replace("Ü", "Ü"), "/É", None)]
    assert reputation.judge(df.limit(0)).count() == 0


def test_reputation_blocks_on_evidence_only(spark):
    rules = [("block", "bad.test", "/spam"), ("allow", "good.test", "/ok")]
    urls = [f"http://bad.test/spam{i}" for i in range(200)] + [f"http://good.test/ok{i}" for i in range(200)] + ["http://bad.test/x", "http://good.test/x", "http://new.example/x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in reputation.judge(df, rules).collect()}
    assert got[400] == (None, "block") and got[401] == (None, "allow") and got[402] == (None, "allow")


def test_joined_components_whatever_the_tasks(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(rng.randrange(-50, 400), rng.randrange(-50, 400)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    seen = {x for e in edges if e[0] != e[1] for x in e}
    root = {x: x for x in seen}
    for _ in range(len(seen)):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(edges, "a long, b long")
    for part in (1000, 60):
        monkeypatch.setattr("tracelens.llm.components.PART", part)
        got = {r.id: r.component for r in joined_components(df).collect()}
        assert got == root
    assert joined_components(df.limit(0)).count() == 0
