"""The corpus operators as registered queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import chat, embeddings, langid, licenses, media, minhash, packing, resampling, secrets, spelling, urlfilter, warc
from ledgerline.llm.common import new_path, written
from ledgerline.llm.mixing import MIXING_SQL, mixing_plan
from ledgerline.llm.oracles import CHAT_SQL, EMBEDDINGS_SQL, MINHASH_SQL, RESAMPLING_SQL, SPELLING_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, all sources by weights 5, 2, 1 and at most three copies."""
    return mixing_plan(_table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License stretches of all documents with their template, what it saves and how the wording differs."""
    return licenses.find_licenses(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and where they lie in sequences of 1024 tokens."""
    import public_tokenizers

    pieces = packing.tokenize_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("tokens").alias("ids_crc32"))
    return packing.pack_pieces(pieces)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at 75 percent of their five-word shingles."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    model = langid.fit(docs.filter("held_out IS NOT TRUE"))
    out = langid.identify(docs.select("doc_id", "text", "held_out"), model)
    return out.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings with equal labels, at cosine 0.98."""
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back: digests, sizes and revisits."""
    place = new_path(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), place)
    records = warc.read_archives(spark, place, payloads=False)
    return records.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


#: What the archives hold, worked out from the pages alone.
WARC_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS latest FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> latest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> latest THEN latest END AS refers_to
FROM g
"""


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as motion-JPEG in AVI and read back: digests, and the shots of its frames."""
    docs = _table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    stored = written(media.store_media(docs).drop("text"), "media")
    read = media.read_media(stored)
    clips = F.array_join(F.transform("read.clips", lambda c: F.concat_ws("-", c["start_ms"].cast("string"), c["end_ms"].cast("string"))), ",")
    feature = F.concat(F.col("read.frames").cast("string"), F.lit(" frames; ms "), clips).alias("feature")
    return read.select("doc_id", "n_bytes", "read.payload_bytes", "read.payload_sha256", "read.tail_crc32", "read.media_bytes", "read.media_sha256", feature)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base digest and all spans of secrets by document."""
    found = secrets.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"] != "entropy")
    digest = F.sha2(F.encode(secrets.joined(base), "UTF-8"), 256).alias("base_sha256")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), digest, secrets.joined(F.col("secrets")).alias("spans"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one of control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -1L AS conv_id, transform(array('user', 'assistant'), r -> named_struct('role', r, 'content', '{said}')) AS messages")
    turns = chat.canonical_turns(_table(spark, sf_dir, "conversations")).unionByName(chat.canonical_turns(extra))
    return chat.digest_parts(chat.format_turns(turns))


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by rules, and where none fits by the trust and distrust of its host."""
    return urlfilter.filter_urls(_table(spark, sf_dir, "pages"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all documents with its near words, its form and the root of its forms."""
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight and score against the benchmark, and the ranks of those drawn."""
    return resampling.importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_licenses": op2_licenses,
        "op3_packing": op3_packing,
        "op4_minhash": op4_minhash,
        "op5_langid": op5_langid,
        "op6_embeddings": op6_embeddings,
        "op7_warc": op7_warc,
        "op8_media": op8_media,
        "op9_secrets": op9_secrets,
        "op10_chat": op10_chat,
        "op11_urls": op11_urls,
        "op12_spelling": op12_spelling,
        "op13_resampling": op13_resampling,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": MIXING_SQL,
        "op4_minhash": MINHASH_SQL,
        "op6_embeddings": EMBEDDINGS_SQL,
        "op7_warc": WARC_SQL,
        "op10_chat": CHAT_SQL,
        "op11_urls": urlfilter.URL_SQL,
        "op12_spelling": SPELLING_SQL,
        "op13_resampling": RESAMPLING_SQL,
    }
