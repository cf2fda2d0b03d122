"""The queries of this subpackage, each with production parameters over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, licenses, minhash, mixing, negatives, phrases, quality, topk, warc
from .line_dedup import line_dedup
from .sentencepiece_codec import encode_decode
from .shared import cut, remove, shared_folder
from .simhash import near_duplicates
from .substring_dedup import substring_dedup


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4, distance=4, seeds=(42,))
    return out.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("blocks")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    records = warc.read_records(warc.read_index(spark, folder), folder)
    payload = F.col("payload").isNotNull()
    digests = cut(records.select(
        "page_id",
        F.when(payload, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(payload, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    ))
    remove(spark, folder)
    return digests


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_substring_dedup": op1_substring_dedup, "op2_line_dedup": op2_line_dedup, "op3_sentencepiece": op3_sentencepiece, "op4_mixing": op4_mixing, "op5_simhash": op5_simhash, "op6_licenses": op6_licenses, "op7_topk": op7_topk, "op8_warc": op8_warc, "op9_quality": op9_quality, "op10_chat": op10_chat, "op11_negatives": op11_negatives, "op12_phrases": op12_phrases, "op13_minhash": op13_minhash}

WARC_ORACLE = """
with rows as (
  select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
first as (
  select payload_digest, min(page_id) as first from rows where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, payload_digest, case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
  case when first <> page_id then first end as refers_to
from rows left join first using (payload_digest)
"""

ORACLE_SQL: dict[str, str] = {"op4_mixing": mixing.ORACLE, "op6_licenses": licenses.ORACLE, "op7_topk": topk.ORACLE, "op8_warc": WARC_ORACLE, "op9_quality": quality.ORACLE, "op10_chat": chat.ORACLE, "op11_negatives": negatives.ORACLE, "op12_phrases": phrases.ORACLE}
