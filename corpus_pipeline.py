"""Corpus pipeline: quality classifier, MinHash near-dedup, repeated passages, pseudonyms,
packing. Every stage is written as Parquet to the shared folder and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.llm import chosen_path, packing, pseudonyms, quality, repeats
from tracelens.llm.common import fresh, stored, table
from tracelens.llm.queries import DEMO_KEY

#: Similarity of two documents' sets of 5-word shingles, in percent, from which one of them goes.
NEAR = 80


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, of the texts as they are now."""
    if "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at least THRESHOLD. Without labels all stay."""
    score = fresh(docs, "score")
    scored = quality.classify(docs, table(spark, sf_dir, "labels"), column=score)
    return scored.where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id."""
    gone = chosen_path.near_duplicates(docs, percent=NEAR).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds. A character that a cut
    leaves in part goes; a document of which nothing is left stays, empty."""
    return _measured(repeats.cut_texts(docs))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their personal numbers, dates, addresses and secrets replaced."""
    return _measured(pseudonyms.pseudonymise(docs, DEMO_KEY, kinds=fresh(docs, "kinds"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_each),
    ("suffix-array dedup", without_repeats),
    ("PII", without_personal_data),
    ("packing", pack),
]

#: Tokenising and the trained stage have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
