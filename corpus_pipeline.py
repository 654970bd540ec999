"""Training-data pipeline over documents: language ID, near-duplicates, personal data, mixing, BPE.

Each stage takes all that the one before kept and returns the columns of documents; the last one returns the
encoded corpus. Every stage is written as Parquet and read again before the next.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.bpe import encode_decode
from loomgraph.llm.common import shared_dir
from loomgraph.llm.language_id import identify
from loomgraph.llm.language_id import train as train_language
from loomgraph.llm.minhash import near_duplicates
from loomgraph.llm.mixing import mixed_documents
from loomgraph.llm.pii import mask
from loomgraph.llm.pii import train as train_field


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are null or have no letter go; lang is what the text says, not what was claimed.

    Where no language can be learned (no text has one), nothing is said of lang. Rows are judged one by one: repeated
    rows and null ids stay as they are, very long texts are read whole, an empty table stays empty, other columns pass.
    """
    model = train_language(docs)
    if not model.families:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = "lang_pred"
    while found in docs.columns or f"{found}_score" in docs.columns:
        found += "_"
    held = identify(docs, model, (found, f"{found}_score")).where(F.col(found) != "und")
    return held.select(*(F.col(found).alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8, the least id.

    Texts without words and rows with a null id stay. Rows that share an id are one document: they stay or go
    together. An empty table stays empty; other columns pass.
    """
    gone = near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"))
    return docs.join(gone, docs["doc_id"] == F.col("gone_id"), "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text is replaced by its kind; n_chars follows the text.

    No row goes. Null and empty texts stay; the field is learned from all texts; an empty table stays empty.
    """
    clean = mask(docs, train_field(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources get their target weights: a document is there as often as the mix takes it, twice at most.

    Null sources are a source; documents without words are kept once; repeated rows are documents of their own; ties
    in the shuffled order go together; an empty table stays empty.
    """
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of every document, with the digest of the decoded text.

    Null texts are empty and have no ids; repeated rows and null ids stay; an empty table stays empty.
    """
    return encode_decode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"), result="hashed")


STAGES = [("language ID", language), ("MinHash near-dedup", near_dedup), ("PII", personal_data), ("mixing sources to target weights", mixing), ("BPE encoding and decoding", encoding)]

#: Training and graph components can't be said in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
