"""The corpus pipeline: language ID, near duplicates, repeated passages, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of ``documents``; other columns of a stage's docs are left out, so
their names may be any. Every stage gives an empty result for an empty table, takes texts whole, however long, and may
run again after a loss with the same rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import bpe, common, langid, mixing, nearjoin, suffixdedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts, texts without a letter, and texts in which the model knows no
    n-gram (score 0), unless their label names a language that the model has not learned, which it cannot judge. A
    missing language is filled in. The model is fitted on the labelled documents of the stage's own input. Rows are
    judged by their texts alone: repeated rows stay or go together, null ids and sources stay as they are."""
    model = langid.fit(docs.where(langid.fold() != 2))
    unlearned = F.coalesce(~F.col("lang").isin(model.languages), F.lit(False))
    found = langid.predict(docs.select(*COLUMNS), model).where((F.col("lang_pred") != "und") & ((F.col("score") > 0) | unlearned))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of similarity 0.8 or more connect, the document with the smallest id stays, with all of
    its rows if they repeat. Rows without an id are in no group and stay; so do wordless texts, but for copies."""
    found = nearjoin.join(docs)
    gone = common.stored(found.where("group_id <> doc_id").select(F.col("doc_id").alias("id")).distinct(), common.scratch(spark, "near-duplicates"))
    return common.without(docs.select(*COLUMNS), "doc_id", gone)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that stand earlier are taken out; documents stay, if only with an empty text. Repeated rows of a
    document lose the same bytes, and none for each other's sake; rows without an id come before all others, in order
    of their texts' digests."""
    found = suffixdedup.clean(docs.select(*COLUMNS))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated to the target weights of their sources and dealt anew; copies keep the id. A null source is
    a source of its own; rows of one id, or without one, are repeated equally often within a source."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit integers) of each row's text, and
    decoded_sha256, the digest of the text that these ids decode to. Each row is encoded on its own; a null text is empty."""
    common.small_batches(spark)
    encode = bpe.encode_column(public_tokenizers.path("byte_bpe_50k.json"), decoded=True)
    return docs.select("doc_id", "lang", "source", encode("text").alias("e")).select("doc_id", "lang", "source", "e.*")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mix_sources", mix_sources),
    ("token_ids", token_ids),
]

#: SQL cannot express the model, the banding or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    folder = common.scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs
