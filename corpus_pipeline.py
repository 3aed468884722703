"""A corpus from raw documents to packed sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import decontam, langid, packing, pii, simhash
from quernstone.llm.common import materialise

#: Texts of so many characters whose best cosine is lower are junk, not prose: 19 of 20 strings of random letters have 0.14 or less at any length,
#: prose of 200 characters has 0.2 at the least, 0.4 in 99 of 100. Shorter texts say too little and stay if they have a letter.
LEAST_COSINE = 0.13
LEAST_CHARS = 200


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, null texts among them, and longer ones like no language learned from ``docs``.

    A table without ``lang``, or with nulls alone there, teaches nothing; all with letters then stay. Columns
    are as they were, whatever their names.
    """
    prototypes = langid.train(docs) if "lang" in docs.columns else {}
    if not prototypes:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    own = [f"own{i}" for i in range(len(docs.columns))]
    key, text = (own[docs.columns.index(c)] for c in ("doc_id", "text"))
    found = langid.predict(docs.toDF(*own), prototypes, key=key, text=text, keep=tuple(c for c in own if c != key))
    known = (F.col("score") >= LEAST_COSINE) | (F.length(text) < LEAST_CHARS)
    return found.where((F.col("lang_pred") != "und") & known).select(*own).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of texts whose five-word shingles are at least 0.8 alike."""
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def remove_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Generalises personal data, and the terms that reveal it, in every text."""
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences of 2048 tokens: a row a piece, with its ids. A null text packs as an empty one, a null id stays null."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", decontaminate), ("pii", remove_pii), ("packing", pack)]

#: Hashes, hypervectors and a tokenizer are beyond SQL; the stages are held against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each written as Parquet and read again.

    Null, empty and letterless texts go in the first stage; of rows that repeat id and text all stay or go
    together, and a null id is an id like any other, last in order. An empty table gives no piece.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
