"""Operators on single texts against the libraries, brute force and round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tracelens.llm import fingerprints, packing, pieces, pseudonyms, quality, toxicity

ODD = [None, "", " ", "a", "  two  spaces ", "line\nbreak\n\n", "Größe für Über", "it's they'RE don't.", "tab\there", "▁mark ▁▁x", "é combining ́ accent",
       "<|endoftext|> and <s>", "emoji 😀😀", "\x1c control", "x" * 3000, "nb sp", "a,b;c", "THE!! END***"]


def docs(spark, texts, **extra):
    """Documents with columns whose names clash with those inside the operators."""
    rows = [(i, t, "clash", 7, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n long, t string")


def test_sentencepiece_equals_library(spark):
    import sentencepiece

    file = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=file)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(" ab▁\n.é") for _ in range(rng.randrange(60))) for _ in range(200)]
    for r in pieces.encode_decode(docs(spark, texts), file).collect():
        ids = lib.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.decoded == lib.decode(ids)
    assert pieces.encode_decode(docs(spark, ["x"]).limit(0), file).count() == 0


def test_packing_equals_library_and_is_gapless(spark):
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(file)
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice(" aB'sé.,!|9\n") for _ in range(rng.randrange(80))) for _ in range(300)] + ["word " * 5000]
    full = {i: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
    rows = packing.pack(docs(spark, texts).repartition(5), file, length=128).collect()
    seen = {i: np.zeros(len(x), int) for i, x in full.items()}
    for r in rows:
        x = full[r.doc_id]
        assert r.doc_tokens == len(x) and r.length > 0
        assert zlib.crc32(r.ids) == zlib.crc32(x[r.start : r.start + r.length].tobytes())
        seen[r.doc_id][r.start : r.start + r.length] += 1
    assert all((s == 1).all() for s in seen.values())
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert [*ends] == [*range(len(ends))] and set(list(ends.values())[:-1]) <= {128}
    assert packing.pack(docs(spark, ["x"]).limit(0), file).count() == 0


def test_word_table_equals_library_for_marks_after_any_letter():
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    lib, table, rng = Tokenizer.from_file(file), packing.WordTable(file), random.Random(7)
    letters = "aBzIéÉßẞİıΩςΣǅﬁﬀŉǰÅ日本हि١²ªŞ"
    texts = [a + b + m for a in letters for b in letters + " " for m in packing.TAIL] + ["ŞEHRİ.", "MERKEZİ, ANKARA", "İ."]
    texts += ["".join(rng.choice(letters + packing.TAIL + " \n'-") for _ in range(rng.randrange(1, 90))) for _ in range(3000)]
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        assert [np.frombuffer(x, "<u4").tolist() for x in map(table.ids, some)] == [e.ids for e in lib.encode_batch(some, add_special_tokens=False)]


def test_packing_keeps_repeated_rows(spark):
    rows = packing.pack(docs(spark, ["same words"]).union(docs(spark, ["same words"])), public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len(rows) == 2 and len({(r.sequence_id, r.offset) for r in rows}) == 2


def brute_likeness(a, b):
    def units(t):
        import re

        return set(re.findall(r"\S+", t, re.A)) if len(t) <= fingerprints.SHORT else set(
            re.findall(rf"[^\n]{{0,{fingerprints.PARAGRAPH - 1}}}[.!?](?=\s|$)|[^\n]{{1,{fingerprints.PARAGRAPH}}}", t, re.A))

    x, y = units(a), units(b)
    return 1.0 if not x and not y else 1 - len(x ^ y) / (len(x) + len(y))


def test_fingerprints_against_sets_of_paragraphs(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(rng.randrange(1, 20))) + "." for _ in range(n))
    texts = [None, "", "", "one two", "one two"] + [text(rng.randrange(1, 40)) for _ in range(150)] + [text(400), "De " * 2000]
    texts.append(texts[40])
    ids = rng.sample(range(-500, 5000), len(texts))
    df = spark.createDataFrame(list(zip(ids, texts, ["c"] * len(ids), strict=True)), "doc_id long, text string, run string")
    got = {r.doc_id: r for r in fingerprints.compare(df).collect()}
    order = sorted(zip(ids, ((t or "") for t in texts), strict=True))
    prints = {}
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        q = len(t) // 4
        e = t[: len(t) - q] + nxt[:q]
        r = got[i]
        assert (r.t, r.e) == (t, e)
        assert r.near_edited == pytest.approx(brute_likeness(t, e))
        assert r.near_next == pytest.approx(brute_likeness(t, nxt))
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        assert prints.setdefault(e, r.edited_fingerprint) == r.edited_fingerprint
    assert len(set(prints.values())) == len(prints)


def test_fingerprints_of_odd_tables(spark):
    assert fingerprints.compare(docs(spark, ["x"]).limit(0)).count() == 0
    (alone,) = fingerprints.compare(docs(spark, ["one two three four"])).collect()
    assert alone.near_next == 1.0 and alone.e == "one two three" [:13] + alone.e[13:]
    df = spark.createDataFrame([(None, "a b"), (5, "c d"), (5, "e f")], "doc_id long, text string")
    assert {(r.doc_id, r.t) for r in fingerprints.compare(df).collect()} == {(None, "a b"), (5, "c d"), (5, "e f")}


def test_permutations_and_valid_values():
    p = pseudonyms.Permuter(b"k")
    for size in (2, 10, 1000, 4097):
        assert {p.permute(i, size, b"t") for i in range(size)} == {*range(size)}
    out, kinds = pseudonyms.replaced("mail jo.81@mail7.example.com card 4111 1111 1111 1111, 97.51.17.173. (017) 555-7713 born 1987-02-28", p)
    assert sorted(kinds) == ["card", "ip", "iso", "mail", "phone"]
    assert not any(x in out for x in ("jo.81", "4111 1111 1111 1111", "97.51.17.173", "555-7713", "1987-02-28"))
    card = out[out.index("card ") + 5 :][:19].replace(" ", "")
    assert pseudonyms.luhn_digit(card[:-1]) == card[-1]
    account, _ = pseudonyms.replaced("DE89370400440532013000", p)
    assert pseudonyms.mod97(account) == 1 and account != "DE89370400440532013000"
    for plain in ("card 4111111111111112", "2023-02-29", "1.2.3.400", "version 4.0. and 3.", "000-12-3456", "no numbers here", ""):
        assert pseudonyms.replaced(plain, p) == (plain, [])
    again, _ = pseudonyms.replaced("97.51.17.173", p)
    assert again in out  # equal values stay linked
    assert pseudonyms.replaced("97.51.17.173", pseudonyms.Permuter(b"other"))[0] != again


def test_pseudonymise_keeps_rows_and_columns(spark):
    df = docs(spark, [None, "", "call +1 (826) 555-4081 now", "call +1 (826) 555-4081 now", "plain"])
    rows = pseudonyms.pseudonymise(df, b"k").orderBy("doc_id").collect()
    assert [r.text for r in rows[:2]] == [None, ""] and rows[4].text == "plain"
    assert rows[2].text == rows[3].text != "call +1 (826) 555-4081 now" and rows[2].kinds == ["phone"]
    assert rows[2].ids == "clash" and rows[2].n == 7
    assert pseudonyms.pseudonymise(df.limit(0), b"k").count() == 0


def corpus(rng, n):
    """Good prose, shouting and repeated words; some texts hold an insult."""
    words = ["".join(rng.choice(["an", "re", "tion", "sh", "ou", "the"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    out = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["zorgish", "zorgful", "blaxt"]))
        t = " ".join(w)
        if bad:
            t = rng.choice([lambda t: " ".join(x.upper() + "!!" for x in t.split()), lambda t: " ".join(x for x in t.split()[:10] for _ in range(12)),
                            lambda t: " | ".join(t.split())])(t)
        out.append((i, t, int(not bad), int(toxic)))
    return out


def test_classifiers_learn_from_the_other_folds_only(spark):
    rng = random.Random(5)
    rows = corpus(rng, 700)
    df = spark.createDataFrame([(i, t) for i, t, _, _ in rows] + [(10_000, None), (10_001, "")], "doc_id long, text string")
    # what is held out carries wrong labels: they must not be seen
    held = lambda i, of, f: zlib.crc32(str(i).encode()) % of == f
    labels = spark.createDataFrame(
        [(i, 1 - q if held(i, 5, 0) else q, 1 - x if held(i, 4, 2) else x) for i, _, q, x in rows] + [(None, 1, 1), (99_999, 0, 0), (3, None, None)],
        "doc_id long, quality int, toxic int")
    good = {r.doc_id: r.score for r in quality.classify(df, labels).collect()}
    tox = {r.doc_id: r.score for r in toxicity.classify(df, labels).collect()}
    assert len(good) == len(tox) == 702 and all(0 <= s <= 1 for s in [*good.values(), *tox.values()])
    assert np.mean([(good[i] >= 0.3) == (q == 1) for i, _, q, _ in rows]) > 0.97
    assert np.mean([(tox[i] >= 0.3) == (x == 1) for i, _, _, x in rows]) > 0.97
    assert good[10_000] == good[10_001] and tox[10_000] == tox[10_001] < 0.3


def test_stems_beside_copies_of_a_long_toxic_text(spark):
    rng = random.Random(11)
    word = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    common, rare = [word(6) for _ in range(300)], " ".join(word(9) for _ in range(900))
    clean = [(i, " ".join(rng.choices(common, k=40)), 0) for i in range(300)]
    copies = [(1000 + i, f"{rare} {i}", 1) for i in range(100)]
    toxic = [(2000 + i, " ".join([*rng.choices(common, k=40), "zorgling"]), 1) for i in range(60)]
    sample = spark.createDataFrame(clean + copies + toxic, "k long, t string, y int")
    stems = toxicity.learn_stems(sample)
    assert any("zorgling".startswith(s.rstrip("$")) for s in stems)
    assert not any(s.rstrip("$") in rare for s in stems if not "zorgling".startswith(s.rstrip("$")))


def test_classifiers_without_labels(spark):
    df = docs(spark, ["a b", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify(df, none).collect()} == {1.0}
    assert {r.score for r in toxicity.classify(df, none).collect()} == {0.0}
    assert quality.classify(df.limit(0), none).count() == 0


def test_grammar_composes():
    g = toxicity.Grammar({"zorg": 4.0})
    plain, aimed = g.clauses("what a zorgish day"), g.clauses("you are zorgish")
    denied, told = g.clauses("he is not zorgish"), g.clauses("she said he seems like some kind of rather odd zorgish man")
    assert [w for _, w in plain] == [4.0] and aimed[0][1] == 5.0
    assert denied[0][1] == 2.5 and told[0][1] == 3.0
    assert g.clauses("I will kill you.") and not g.clauses("it will kill time") and not g.clauses("bezorg it")
    assert [c for c, _ in g.clauses("fine. zorg! fine")] == ["zorg"]


def test_all_of_a_text_without_blanks_takes_part():
    head = "a1b2c3d4"
    assert not np.allclose(quality.terms(head + "(e,f)" * 50), quality.terms(head + '{"K":"V"}' * 50))
    assert not np.allclose(quality.terms("这是，一个。" * 3 + "!!??" * 40), quality.terms("这是，一个。" * 43))


def test_equal_texts_equal_scores():
    m = quality.Model(np.eye(quality.TERMS + quality.EXTRA)[:, :8], np.eye(8), np.array([1.0, 0] * 4), 0.5)
    t = "The words of a text, twice.\nAgain!"
    assert m.scores([t])[0] == m.scores(["other words"] * 300 + [t])[-1]
    assert hashlib.sha256(quality.terms(t).tobytes()).digest() == hashlib.sha256(quality.terms(t).tobytes()).digest()
