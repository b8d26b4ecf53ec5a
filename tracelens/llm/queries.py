"""Registered queries of the training-data operators: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chosen_path, codes, fingerprints, mixing, neighbours, packing, pieces, pseudonyms, quality, repeats, reputation, toxicity
from .common import held_out, table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.compare(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.length("t").cast("bigint").alias("n_chars"), F.sha2(F.encode("e", "UTF-8"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.classify(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out("doc_id", 0, 5).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reputation.judge(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.classify(docs, table(spark, sf_dir, "labels"))
    return out.select(
        "doc_id", held_out("doc_id", 2, 4).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.size("clauses").alias("n_clauses"),
    )


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


#: Of the registered query alone; whoever publishes a corpus passes a secret of their own.
DEMO_KEY = b"demonstration key"


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)
    return out.select("doc_id", "text", F.size("kinds").alias("n_replaced"), "kinds")


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.compare(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"),
        shown=lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups, 256)))
    return out.withColumnRenamed("groups", "groups_sha256")


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.codes(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_quality": op2_quality,
        "op3_packing": op3_packing,
        "op4_url_reputation": op4_url_reputation,
        "op5_toxicity": op5_toxicity,
        "op6_embedding_near_dedup": op6_embedding_near_dedup,
        "op7_minhash_near_dedup": op7_minhash_near_dedup,
        "op8_pseudonyms": op8_pseudonyms,
        "op9_repeated_passages": op9_repeated_passages,
        "op10_sentencepiece": op10_sentencepiece,
        "op11_tokenizer_alignment": op11_tokenizer_alignment,
        "op12_mixing": op12_mixing,
        "op13_vector_codes": op13_vector_codes,
    }


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _strength_sql(children: str) -> str:
    return f"""(SELECT coalesce(1 / r - 1, 1 / {reputation.MOST_R}::DOUBLE - 1) FROM (SELECT least(greatest(CASE
        WHEN sum((n - 1) * parent * (1 - parent)) > 0
        THEN (sum((good - n * parent) ** 2 / n) - sum(parent * (1 - parent))) / sum((n - 1) * parent * (1 - parent))
        ELSE {reputation.MOST_R} END, {reputation.LEAST_R}), {reputation.MOST_R})::DOUBLE AS r FROM {children} WHERE n > 0))"""


def _fits_sql(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


def _rules_sql(value: int) -> str:
    ordered = sorted(reputation.RULES, key=lambda r: -len(r[1] + r[2]))
    return "CASE " + " ".join(f"WHEN {_fits_sql(h, p)} THEN '{(h + p, v)[value]}'" for v, h, p in ordered) + " END"


OP4_SQL = f"""
WITH urls AS (
    SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
    FROM pages),
ruled AS (SELECT *, {_rules_sql(0)} AS rule, {_rules_sql(1)} AS outcome FROM urls),
hosts AS (
    SELECT host, count(outcome) AS n, count(*) FILTER (outcome = 'allow') AS good,
        array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, list_extract(string_split(host, '.'), -1) AS suffix
    FROM ruled GROUP BY host),
c1 AS (
    SELECT suffix, sum(n)::BIGINT AS n, sum(good)::BIGINT AS good,
        (SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM hosts)::DOUBLE AS parent
    FROM hosts GROUP BY suffix),
p1 AS (SELECT suffix, (good + s * parent) / (n + s) AS share FROM c1, (SELECT {_strength_sql("c1")} AS s)),
c2 AS (
    SELECT domain, d.suffix, n, good, share AS parent
    FROM (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(good)::BIGINT AS good FROM hosts GROUP BY ALL) d JOIN p1 ON d.suffix = p1.suffix),
p2 AS (SELECT domain, (good + s * parent) / (n + s) AS share FROM c2, (SELECT {_strength_sql("c2")} AS s)),
c3 AS (SELECT h.host, h.n, h.good, share AS parent FROM hosts h JOIN p2 ON h.domain = p2.domain),
p3 AS (
    SELECT host, (good + s * parent) / (n + s) AS share, good + s * parent AS a, n - good + s * (1 - parent) AS b
    FROM c3, (SELECT {_strength_sql("c3")} AS s)),
known AS (SELECT host, share, share + {reputation.Z} * sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) AS upper FROM p3)
SELECT page_id, ruled.host, path, rule,
    coalesce(outcome, CASE WHEN round(upper, 9) < {reputation.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
    round(share, 6) AS share, round(upper, 6) AS upper
FROM ruled JOIN known ON ruled.host = known.host
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_url_reputation": OP4_SQL}
