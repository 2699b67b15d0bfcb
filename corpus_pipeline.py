"""The corpus pipeline: language, near duplicates, secrets, mixture and packing, one stage after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. Between stages the rows are written as Parquet and read
again, so every stage works on all that its predecessor kept. All but the last return the columns of ``documents``.

All stages read whole texts, however long, give an empty result for an empty table, and pass other columns through, whatever
their names; what they do with nulls, ties and repeated rows is said at each.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import langid, minhash, mixing, packing, secrets
from ledgerline.llm.common import free_name, new_path
from ledgerline.session import ship

#: SQL cannot express the trained classifier or the tokenizer.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter are rejected. A missing lang is filled in.

    Null texts have no letter and go; a null doc_id counts as one to learn from; repeated rows are told alike; where no row
    has a lang nothing can be told, and no document stays.
    """
    model = langid.fit(docs.filter("coalesce(crc32(cast(cast(doc_id AS string) AS binary)) % 3, 0) <> 1"))
    into = free_name(docs, "language")
    told = langid.identify(docs, model, into=into).filter(F.col(into)["lang"] != langid.UNKNOWN)
    return told.select(*[F.coalesce(F.col("lang"), F.col(into)["lang"]).alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: of those with the smallest doc_id, the one whose text has the least hash.

    Rows that share a doc_id but not their text are documents of their own. Texts without words and rows without a doc_id
    link with nothing and stay. Rows that repeat doc_id and text stay once; should their other columns differ, either stays.
    """
    found = minhash.components(docs)
    first = found.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("k")).select("k.*")
    wordless = found.filter("component IS NULL AND doc_id IS NOT NULL").select("doc_id", "text_key").distinct()
    key, number = free_name(docs, "text_key"), free_name(docs, "kept_id")
    keep = first.unionByName(wordless).select(F.col("doc_id").alias(number), F.col("text_key").alias(key))
    rows = docs.withColumns({key: minhash.text_key(docs["text"]), number: docs["doc_id"].cast("long")})
    once = rows.filter(F.col(number).isNotNull()).dropDuplicates([number, key]).join(keep, [number, key], "left_semi").select(*docs.columns)
    return once.unionByName(docs.filter(docs["doc_id"].cast("long").isNull()))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; n_chars follows the text. Null texts and repeated rows stay as they are."""
    masked = secrets.mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them.

    Null is a source of its own; texts that are null or without words add nothing to a target and go by their places in their
    source as the others do; repeated rows are drawn on their own, ties by doc_id and then by a hash of the text.
    """
    return mixing.repeat_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens.

    A null text is the end token alone; repeated rows are packed as often as they occur; pieces of equal length may change
    places. Of the columns only doc_id goes on.
    """
    pieces = packing.tokenize_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack_pieces(pieces.select("doc_id", "piece", "start", "length", F.crc32("tokens").alias("ids_crc32")))


STAGES = [
    ("language ID", language_stage),
    ("near duplicates", near_duplicate_stage),
    ("secret scan", secret_stage),
    ("source mixture", mixture_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
