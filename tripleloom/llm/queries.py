"""The registered queries of the training-data operators (production parameters, whole tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import idstore, jaccard, langid, lm, media, mixing, packing, quality_mil, quality_rules, secrets_scan
from .common import bucket_of, documents


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets_scan.scan(documents(spark, sf_dir))
    return found.withColumn("candidate_sha256", F.sha2("candidate", 256)).drop("candidate")


def op2_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), bucket_of("doc_id", 5) == 0)


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir), bucket_of("doc_id", 7) == 2, lm.Params.whole())


def op4_idstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = idstore.write(documents(spark, sf_dir), tokenizer_path(), end_id=1)
    return idstore.digest_of(idstore.read(spark, store))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir), n=3, percent=90)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_read(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path(), end_id=1, size=2048)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", bucket_of("doc_id", 3) == 1)
    return langid.identify(docs, ~F.col("held_out"), ["doc_id", "held_out"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_quality_mil": op2_quality_mil,
    "op3_lm": op3_lm,
    "op4_idstore": op4_idstore,
    "op5_mixing": op5_mixing,
    "op6_jaccard": op6_jaccard,
    "op7_quality_rules": op7_quality_rules,
    "op8_media": op8_media,
    "op9_packing": op9_packing,
    "op10_langid": op10_langid,
}
ORACLES: dict[str, str] = {"op5_mixing": mixing.ORACLE, "op6_jaccard": jaccard.ORACLE}
