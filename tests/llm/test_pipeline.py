"""Every stage of the pipeline on its own input, against brute force."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_pairs import brute_repeats, sets_of, union
from tracelens.llm import chosen_path, common, packing, pseudonyms, quality
from tracelens.llm.common import stored, table
from tracelens.llm.queries import DEMO_KEY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Inputs and outputs of all stages, from documents with odd rows and clashing columns."""
    docs = table(spark, SF, "documents").withColumns({"score": F.lit("clash"), "kinds": F.lit(1), "component": F.lit("x")})
    odd = docs.limit(3).select(*(F.lit(None).cast(f.dataType).alias(f.name) if f.name in ("text", "doc_id") else F.col(f.name) for f in docs.schema))
    odd = odd.withColumn("doc_id", F.monotonically_increasing_id() + 1_000_000)
    docs = stored(spark, docs.unionByName(odd).unionByName(odd.withColumns({"text": F.lit(""), "doc_id": F.col("doc_id") + 10})), "documents")
    out = []
    for _, stage in corpus_pipeline.STAGES:
        made = stored(spark, stage(spark, docs, SF), "stage")
        out.append((docs, made))
        docs = made
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns(stages):
    for before, after in stages[:-1]:
        assert after.dtypes == before.dtypes
        assert {r.score for r in after.select("score").distinct().collect()} <= {"clash"}


def test_quality_stage(spark, stages):
    before, after = rows(stages[0][0]), rows(stages[0][1])
    scores = {r.doc_id: r.score for r in quality.classify(stages[0][0].select("doc_id", "text"), table(spark, SF, "labels")).collect()}
    assert set(after) == {i for i in before if scores[i] >= 0.3} and all(after[i] == before[i] for i in after)
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    good = [i for i in before if labels.get(i) == 1]
    assert len([i for i in good if i in after]) / len(good) > 0.95


def test_near_duplicate_stage(stages):
    before, after = rows(stages[1][0]), rows(stages[1][1])
    ids = sorted(before)
    s = dict(zip(ids, sets_of([before[i].text for i in ids]), strict=True))
    pairs = [(i, j) for k, i in enumerate(ids) for j in ids[:k] if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])]
    least = union(ids, pairs)
    assert set(after) == {i for i in ids if least[i] == i} and all(after[i] == before[i] for i in after)


def test_repeats_stage(stages):
    before, after = rows(stages[2][0]), rows(stages[2][1])
    gone = brute_repeats([(i, (r.text or "").encode()) for i, r in before.items()])
    assert set(after) == set(before)
    for i, r in before.items():
        kept = bytes(c for c, g in zip((r.text or "").encode(), gone[i], strict=True) if not g).decode("utf-8", "ignore")
        assert after[i].text == kept and after[i].n_chars == len(kept) and after[i].source == r.source


def test_personal_data_stage(stages):
    before, after = rows(stages[3][0]), rows(stages[3][1])
    p = pseudonyms.Permuter(DEMO_KEY)
    assert {i: r.text for i, r in after.items()} == {i: pseudonyms.replaced(r.text, p)[0] for i, r in before.items()}
    assert any(after[i].text != before[i].text for i in before)


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    full = {i: np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for i, r in rows(stages[4][0]).items()}
    pieces = stages[4][1].collect()
    assert sum(r.length for r in pieces) == sum(map(len, full.values()))
    assert all(zlib.crc32(full[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in pieces)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    g = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).orderBy("sequence_id").collect()
    assert all(r.n == 2048 for r in g[:-1])


def test_a_worker_holds_the_tables_of_one_stage():
    """Words that an earlier stage's operator kept in a worker go when the next one starts."""
    first, second = {"a": 1}, {}
    common.keep_only(first)
    common.keep_only(first)
    assert first
    common.keep_only(second)
    assert not first
    quality._SHAPES["word"]
    tasks = chosen_path.sketches, chosen_path.Join.full_sets, quality.score, packing.tokenised
    assert all("keep_only" in f.__code__.co_names or any("keep_only" in getattr(c, "co_names", ()) for c in f.__code__.co_consts) for f in tasks)
