"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, tokenising.

Each stage is written as Parquet in the shared folder and read again by the next, so a lost
executor costs at most the stage that was running.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm import line_dedup, mixing, quality, sentencepiece_codec, simhash
from moraine.llm.shared import remove, shared_folder

HAS_WORD = r"[^\x20\x09-\x0D]"


def _rebuilt(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns of documents with another text, and n_chars to match."""
    own = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return rows.select(*[own.get(c, F.col(f"carried.{c}")).alias(c) for c in columns])


def _others(docs: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c != "text")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines that are boilerplate on their source go from the others.

    A null text has no words and is rejected; a null source is one of its own; repeated rows get the
    same verdict and all stay or go; a null doc_id is kept like any other. Other columns are kept.
    """
    return _rebuilt(quality.quality_rules(docs, carry=_others(docs)).where("kept"), docs.columns, "clean_text")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common blocks go from the later of two documents; documents of which no word is left go.

    A null text is kept as it is; rows without doc_id are kept whole; rows that share a doc_id aren't
    compared with each other and lose what smaller ids hold. Other columns are kept.
    """
    rows = line_dedup.line_dedup(docs, carry=_others(docs))
    return _rebuilt(rows.where((F.col("n_removed") == 0) | F.col("kept_text").rlike(HAS_WORD)), docs.columns, "kept_text")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word similarity of 0.8 or more the document with the smallest doc_id stays.

    Documents are told apart by doc_id and text: two texts under one doc_id are two documents,
    rows that repeat both are copies. Texts without words, null or not, are copies of each other.
    A row without doc_id stays only if no document of its group has one. Other columns are kept.
    """
    return simhash.one_of_each(docs, shingle=5, similarity=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice, all columns kept.

    A null text has size 0; the null source is the last one; rows with the same doc_id and text are
    taken or left together.
    """
    return mixing.mixed_documents(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of each row; a null text is empty and has the end id only."""
    import public_tokenizers

    return sentencepiece_codec.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_stage),
    ("mixing", mixing_stage),
    ("SentencePiece", tokens_stage),
]

#: SQL can express neither patience alignment nor the vocabulary's merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")  # only the last stage's rows are read from here on
    return docs
