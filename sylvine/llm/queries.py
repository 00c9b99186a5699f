"""The queries of this folder's operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sylvine.llm import ann, flac, licenses, mixing, neardup, quality, segment, suffix, tokens, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.group(table(spark, sf_dir, "documents"), percent=85)


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = suffix.dedup(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = tokens.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return x.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    x = urls.screen(urls.dated_pages(pages), urls.dated_entries(pages))
    return x.withColumns({c: F.col(c).cast("string") for c in ("fetched", "listed_since")})


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    x = segment.decode(segment.encode(table(spark, sf_dir, "documents"), model, kept=5_000_000), model)
    return x.select("doc_id", "sample", "n_pieces", "log_prob", "log_inclusion", F.crc32("ids").alias("ids_crc32"), F.crc32("text").alias("text_crc32"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings")
    return ann.search(x.where(F.col("vec_id") % 20 == 0), x)


def op10_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = flac.decode(flac.encode(table(spark, sf_dir, "documents")))
    return x.select(
        "doc_id",
        "n_bytes",
        F.length("pcm").cast("long").alias("payload_bytes"),
        F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pcm, -16, 16)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.size("frame_offsets").alias("n_blocks"),
    )


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_licenses": op2_licenses,
    "op3_neardup": op3_neardup,
    "op4_suffix": op4_suffix,
    "op5_tokens": op5_tokens,
    "op6_urls": op6_urls,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_quality": op8_quality,
    "op9_ann": op9_ann,
    "op10_flac": op10_flac,
}
ORACLES = {"op1_mixing": mixing.ORACLE, "op2_licenses": licenses.ORACLE, "op6_urls": urls.ORACLE}
