"""Alignment, mixing and vector codes against brute force."""

import functools
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tracelens.llm import alignment, codes, groups, mixing

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@functools.cache
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def whole_tokens(text):
    """Both libraries on the whole text: (id, start, end) lists, or None."""
    a, b = libraries()
    stand_in = alignment.byte_level_bytes()
    if not text:
        return None
    want, out = (" " + text).encode(), []
    sides = [
        [(i, bytes(stand_in[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids],
        [(i, bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)],
    ]
    for side in sides:
        if b"".join(x for _, x in side) != want:
            return None
        at, spans = 0, []
        for i, x in side:
            spans.append((i, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return out


def aligned(texts):
    """By the definition: cuts at offsets where both end, pairs within groups, counts."""
    docs = []
    for t in texts:
        sides = whole_tokens(t)
        if sides is None:
            docs.append((0, 0, [], []))
            continue
        a, b = sides
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        parts, lo = [], 0
        for hi in cuts:
            parts.append(([i for i, s, e in a if lo <= s and e <= hi], [i for i, s, e in b if lo <= s and e <= hi]))
            lo = hi
        docs.append((len(a), len(b), parts, [(x, y) for p, q in parts for x in p for y in q]))
    count = Counter(p for d in docs for p in set(d[3]))
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return [
        (na, nb, len(parts), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links),
         ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in parts))
        for na, nb, parts, links in docs
    ]


def alignment_texts(rng):
    alphabet = ["a", "the", " ", "  ", "\n", "\t", " \n ", "'s", "'", "é", "ß", "日本語", "😀", " ", " ", "▁", "<s>", "<|endoftext|>", "1234", "...", "==", "İ", "\x00", "\x1c", "ﬁ", "x" * 30, "ü̈", "Ω", "\r\n"]
    out = [None, "", " ", "  ", "\n", " a", "a ", "it's  here\n\n  now", "same text", "same text", "naïve café — 50 €", "=" * 200 + " " + "ab" * 100]
    for _ in range(300):
        out.append("".join(rng.choice(alphabet) + (" " if rng.random() < 0.5 else "") for _ in range(rng.randrange(1, 25))))
    return out


COLS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


@pytest.mark.parametrize("head,links,large", [(1 << 18, 1 << 21, 256), (20, 64, 1), (0, 1 << 21, 4)])
def test_alignment_equals_the_definition(spark, monkeypatch, head, links, large):
    monkeypatch.setattr(alignment, "LINKS", links)
    monkeypatch.setattr(alignment, "LARGE_GROUP", large)
    score = alignment.link_scores
    monkeypatch.setattr(alignment, "link_scores", lambda rows, n: score(rows, n, head))
    texts = alignment_texts(random.Random(5))
    docs = spark.createDataFrame([(i if i % 7 else None, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, a long, pairs string").repartition(3)
    got = alignment.compare(docs, A, B)
    want = aligned(texts)
    ids = [i if i % 7 else None for i in range(len(texts))]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((i, *w)) for i, w in zip(ids, want, strict=True))
    assert sum(w[3] > 0 for w in want) > 150


def test_chunks_and_worker_tables_change_nothing():
    rng = random.Random(9)
    texts = alignment_texts(rng)
    table = alignment.ChunkTable(A, B)
    many = alignment.tokens(texts, table)
    table.used = alignment.TABLE_BYTES + 1  # a full table is emptied
    again = alignment.tokens(texts, table)
    assert all((x == y).all() for x, y in zip(many, again, strict=True))


def test_alignment_of_long_texts_and_empty_tables(spark):
    rng = random.Random(2)
    long = " ".join(rng.choice(["word", "Häuser", "12,5", "x=y;", "日本"]) for _ in range(120_000))
    docs = spark.createDataFrame([(1, long), (2, "z" * 300_000), (3, long)], "doc_id long, text string")
    got = {r.doc_id: r for r in alignment.compare(docs, A, B).collect()}
    assert got[1].n_links >= got[1].n_groups > 100_000 and got[1][1:] == got[3][1:] and got[2].n_a > 0
    empty = alignment.compare(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert empty.count() == 0 and empty.columns == ["doc_id", *COLS]


def test_coalescing_breaks_where_both_end():
    ga, gb = alignment.coalesce(np.array([1, 2, 3, 1]), np.array([3, 1, 3]))
    assert ga.tolist() == [0, 0, 1, 1] and gb.tolist() == [0, 1, 1]


# ---------------------------------------------------------------- mixing

BLANKS = "\x20\t\n\x0b\x0c\r"


def water(sizes, weights, most=3):
    """Shares by weight; what is above a cap goes to the others, until none is above."""
    total = sum(sizes)
    target, capped = [0.0] * len(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(most * sizes[i] for i in capped)
        for i in free:
            target[i] = left * weights[i] / sum(weights[j] for j in free)
        over = {i for i in free if target[i] > most * sizes[i]}
        if not over:
            return target
        capped |= over
        for i in over:
            target[i] = most * sizes[i]


def mix_docs(rng):
    rows = []
    for i in range(700):
        source = rng.choice(["b", "a", None, "é", "Z", "tiny", "zz", "none"])
        n = 0 if source == "none" else 3 if source == "tiny" else rng.randrange(0, 60)
        if source == "tiny" and sum(r[2] == "tiny" for r in rows) > 3:
            source = "a"
        words = [rng.choice(["gut", "wort", "x1", "<br>", "Ende.", "日本"]) for _ in range(n)]
        rows.append((i, rng.choice(" \n\t").join(words), source))
    rows += [(5, None, "a"), (None, "ein zwei", "b"), (None, "ein zwei", "b"), (900, "w " * 40_000, "zz"), (901, "  \x1c", "a")]
    return rows


def test_mixing_by_the_definition(spark):
    rows = mix_docs(random.Random(3))
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, size int, draw double").repartition(5)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.source, r.size) for r in out) == Counter((d, s, size(t)) for d, t, s in rows)
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(t) for _, t, s in rows if s == x) for x in sources]
    want = dict(zip(sources, water(sizes, [1 + i % 3 for i in range(len(sources))]), strict=True))
    by_source = defaultdict(list)
    for r in out:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[sources.index(r.source)]
        assert 0 <= r.taken <= 3 * r.size and mixing.LEAST_QUALITY <= r.quality <= 1
        by_source[r.source].append(r)
    for s, docs_of in by_source.items():
        total = docs_of[0].source_size
        assert sum(r.taken for r in docs_of) == math.floor(docs_of[0].target)
        if total:  # whole epochs, then a prefix in the order of the draws, one document cut at most
            epochs, rest = divmod(math.floor(docs_of[0].target), total)
            for r in sorted(docs_of, key=lambda r: (r.draw, r.doc_id is None, r.doc_id or 0)):
                part = max(0, min(r.size, rest))
                rest -= part
                if r.doc_id is not None:
                    assert r.taken == epochs * r.size + part
    again = mixing.mix(docs.repartition(2)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out))


def test_draws_follow_quality(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('w', id, ' w') as text", "if(id % 2 = 0, 'a', 'b') as source", "if(id % 4 < 2, 3.0d, 1.0d) as good")
    out = mixing.mix(docs, weights=(1, 3), quality="good")
    taken = {(r.source, r.quality): r.n for r in out.where("taken > 0").groupBy("source", "quality").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    # source a takes half of its words: of 5,000 documents of either quality the better ones go first
    p = lambda q, t: 1 - math.exp(-q * t)
    t = next(x / 10_000 for x in range(1, 30_000) if p(3, x / 10_000) + p(1, x / 10_000) >= 1)
    assert taken["a", 3.0] == pytest.approx(5000 * p(3, t), rel=0.05) and taken["a", 1.0] == pytest.approx(5000 * p(1, t), rel=0.05)
    assert taken["b", 1.0] == taken["b", 3.0] == 5000  # one whole epoch


def test_mixing_of_empty_tables_and_hot_sources(spark, monkeypatch):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    none = mixing.mix(spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")).collect()
    assert [(r.size, r.taken, r.target) for r in none] == [(0, 0, 0.0)] * 2
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', int(id % 9)) as text", "if(id % 3 = 0, 'hot', concat('s', id % 500)) as source")
    want = Counter(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(groups, "HOT", 1)  # every source by shuffle
    assert Counter(map(tuple, mixing.mix(docs).collect())) == want


def test_running_sums(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(50), rng.randrange(10)) for _ in range(500)] + [(None, 3)]
    got = groups.running_sums(spark.createDataFrame(rows, "k int, v long").repartition(7), [groups.F.asc_nulls_last("k"), groups.F.col("v")], ["v"]).collect()
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    before, want = 0, []
    for k, v in rows:
        want.append((k, v, before))
        before += v
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


# ---------------------------------------------------------------- vector codes


def coded(rows, rounds=2, entries=64):
    """By the definition, with Python integers' numpy arithmetic and no bounds."""
    kept = [(k, [math.floor(256 * x) for x in v], label) for k, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return {}, ""
    w = max(1, -(-max(len(v) for _, v, _ in kept) // 16))
    x = np.array([v + [0] * (16 * w - len(v)) for _, v, _ in kept]).reshape(len(kept), 16, w)
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0], x[i].ravel().tolist()))[:entries]
    books = x[first].transpose(1, 0, 2).copy()

    def assign():
        d = np.stack([((x[:, p, None] - books[p][None]) ** 2).sum(2) for p in range(16)], 1)
        return d.argmin(2), d.min(2).sum(1)

    for _ in range(rounds):
        code, _ = assign()
        for p in range(16):
            for k in range(books.shape[1]):
                mine = x[code[:, p] == k, p]
                if len(mine):
                    books[p, k] = mine.sum(0) // len(mine)
    code, error = assign()
    by_label = Counter()
    for (_, _, label), e in zip(kept, error, strict=True):
        by_label[label] += int(e)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    out = Counter((k, "".join(f"{c:02x}" for c in row), int(e), by_label[label]) for (k, _, label), row, e in zip(kept, code, error, strict=True))
    return out, digest


def check_codes(spark, rows, kind="double", rounds=2):
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], f"vec_id long, embedding array<{kind}>, label int, error int, near string").repartition(3)
    got = codes.codes(df, rounds=rounds).collect()
    want, digest = coded(rows, rounds)
    assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in got) == want
    assert {r.codebooks_sha256 for r in got} <= {digest}


@pytest.mark.parametrize("rounds", [1, 2, 5])
def test_codes_equal_the_definition(spark, rounds):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 48)], int(rng.integers(3)) if i % 5 else None) for i in rng.permutation(900)]
    rows += [(2000 + i, rows[7][1], 1) for i in range(300)]  # one vector many times
    rows += [(3000, None, 1), (3001, [0.1] * 47 + [None], 1), (3002, [float("nan")] * 48, 1), (3003, [float("inf")] + [0.0] * 47, None), (3004, [0.0] * 48, None), (5, rows[9][1], 2), (3005, [0.5] * 20, 0), (3006, [], 0)]
    check_codes(spark, rows, rounds=rounds)


def test_codes_with_ties_and_few_vectors(spark):
    rng = random.Random(6)
    grid = [(i, [rng.randrange(-2, 3) / 256 for _ in range(32)], i % 2) for i in range(400)]  # distances tie all the time
    check_codes(spark, grid, rounds=3)
    check_codes(spark, grid[:5])
    check_codes(spark, [(1, None, 1)])
    check_codes(spark, [])
    check_codes(spark, [(i, [1000.0 * rng.random() for _ in range(16)], 0) for i in range(150)])
    huge = codes.codes(spark.createDataFrame([(1, [1e300] * 16, 0), (2, [-1e300] * 16, 0)], "vec_id long, embedding array<double>, label int")).collect()
    assert [r.error for r in huge] == [0, 0]


def test_bounds_stay_bounds_and_save_work():
    rng = np.random.default_rng(1)
    x = rng.integers(-100, 100, (3000, 4))
    first = rng.integers(-100, 100, (1, 64, 4))
    books = codes.Books(first).moved(first)
    near, lower, outer = codes.nearest_lists(codes.all_distances(x[:, None], first)[:, 0], 16)
    part = np.zeros(len(x), "int64")
    lower, outer = codes.down(lower), codes.down(outer)
    looked = []
    for step in (3, 2, 1, 0):
        books = books.moved(books.entries + rng.integers(-step, step + 1, first.shape))
        near, lower, outer, best, depth = codes.reassign(x, part, near, lower, outer, books, 16)
        d = codes.all_distances(x[:, None], books.entries)[:, 0]
        assert (best == d.min(1)).all() and (near[:, 0] == d.argmin(1)).all()
        lower, outer = codes.down(lower), codes.down(outer)
        root = np.sqrt(d)
        assert (lower.astype(float) <= np.take_along_axis(root, near, 1)).all()
        others = np.ones_like(d, bool)
        np.put_along_axis(others, near, False, 1)
        assert (outer <= np.where(others, root, np.inf).min(1)).all()
        looked.append(depth.mean())
    assert looked[-1] < looked[0] < 20


def test_codes_of_a_whole_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    got = codes.codes(table).collect()
    want, digest = coded(rows)
    assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in got) == want and {r.codebooks_sha256 for r in got} == {digest}


def test_chunk_table_keeps_what_comes_again_and_encodes_lines(monkeypatch):
    def table():
        return alignment.ChunkTable(A, B)

    one, two = table(), table()
    chunks = ["plain", "two\nlines", "", " lead", "trail ", "é", "ﬁ", "\U0001f600", "<s>", "</s>", "\x00", "a▁b", "1/2", *(f"w{i}" for i in range(300))]
    one.learn(chunks)
    two._add(chunks)
    for c in chunks:
        assert one.fine[one[c]] == two.fine[two[c]], c
        if one.fine[one[c]]:
            for side in (0, 1):
                assert one.gather(side, np.array([one[c]]))[0].tolist() == two.gather(side, np.array([two[c]]))[0].tolist(), c
    # a full table forgets the chunks that came once
    monkeypatch.setattr(alignment, "TABLE_BYTES", 40_000)
    held = table()
    texts = ["the cat the cat", " ".join(f"x{i}" for i in range(300)), "dog the"]
    first = [alignment.tokens([t], held) for t in texts]
    assert "the" in held and "cat" in held and "x1" not in held
    for t, got in zip(texts, first, strict=True):
        assert all((x == y).all() for x, y in zip(got, alignment.tokens([t], table()), strict=True))
