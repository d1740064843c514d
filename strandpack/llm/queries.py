"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandpack.llm import chat, common, digests, langid, mixing, pieces, quality, secrets, simhash, tokenfile, topk


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, common.crc_class("doc_id", 4) != 2)
    held = F.coalesce(common.crc_class("doc_id", 4) == 2, F.lit(False))
    return quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(common.table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = langid.train(docs, common.crc_class("doc_id", 5) != 0)
    held = F.coalesce(common.crc_class("doc_id", 5) == 0, F.lit(False))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents"))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(common.table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.fingerprints(common.table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(common.table(spark, sf_dir, "conversations"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(common.table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_secrets": op2_secrets,
    "op3_mixing": op3_mixing,
    "op4_language": op4_language,
    "op5_simhash": op5_simhash,
    "op6_tokens": op6_tokens,
    "op7_fingerprints": op7_fingerprints,
    "op8_topk": op8_topk,
    "op9_chat": op9_chat,
    "op10_pieces": op10_pieces,
}

ORACLE: dict[str, str] = {
    "op3_mixing": mixing.ORACLE,
    "op8_topk": topk.ORACLE,
}
