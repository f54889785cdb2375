"""Raw documents to packed training sequences: each stage reads what the one before has written."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import near_dedup, packing, pii, quality
from docmill.llm.common import Workspace, pick, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose votes for good quality are at least half.

    Null texts and texts without words go. Repeated rows get the same score and stay or go together. Without labels all
    documents with words stay, with a score of 0.5.
    """
    docs = docs.select(*COLUMNS)
    labels = pick(table(spark, sf_dir, "labels"), doc_id="doc_id", label="quality").withColumn("label", F.col("label").cast("int"))
    model = quality.fit(pick(docs, doc_id="doc_id", text="text"), labels.where(~quality.held_out()))
    return quality.score(docs, model).where("score >= 0.5").select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component of near copies: five-word shingles, similarity 0.8 or more.

    Rows without id stay. Rows that share an id are one document; they stay or go together.
    """
    copies = near_dedup.near_duplicates(docs, words=5, percent=80).where("NOT kept").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)


def hide_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms, and their new lengths. Null and empty texts, and all rows' other columns, stay as they are.

    The key is the session's spark.docmill.pii.secretKey, or a fresh one for the run.
    """
    out = pii.pseudonymise(docs.select(*COLUMNS), pii.key_of(spark))
    return out.withColumn("n_chars", F.when(F.col("pii").isNull() | (F.size("pii") == 0), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their ids, in sequences of 1024 tokens. A null or empty text gives its end token alone;
    each of repeated rows is packed."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), length=1024, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_dedup", keep_one_of_near_copies),
    ("pii", hide_private_data),
    ("packing", pack_sequences),
]

#: Votes of neighbours, odd sketches, Feistel networks and dynamic programming have no SQL form; tests use brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name)
        work.keep(name)
    return STAGES[-1][1](spark, docs, sf_dir)
