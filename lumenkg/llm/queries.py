"""The queries of the numbered operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import clustering, decontaminate, fingerprint, langid, linededup, mixing, neardup, packing, pii, sharding, suffixdedup, vectorcodes, warc
from .common import table
from .oracles import ORACLES

#: The setting that names the secret key of op10's surrogates; where it is not set, as in tests, the key is this name.
KEY = "spark.lumenkg.pii.key"
#: The vocabulary that op2 and the pipeline tokenise with.
VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary(), capacity=2048, end_id=0)


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"), folds=5)


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write(table(spark, sf_dir, "pages"), least=0)
    return warc.read(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.removed(table(spark, sf_dir, "documents")).drop("spans")


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.counted(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), shards=40)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(table(spark, sf_dir, "documents"), spark.conf.get(KEY, KEY).encode()).select("doc_id", "text", "n_chars", "n_entities")


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clustered(table(spark, sf_dir, "embeddings"), k=40, rounds=5, seed="2", dims=64, scale=256)


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3).drop("source", "times")


def op13_vectorcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.codes(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_packing, op3_fingerprint, op4_langid, op5_neardup, op6_warc, op7_suffixdedup, op8_linededup, op9_sharding, op10_pii, op11_clustering, op12_mixing, op13_vectorcodes)}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express; tests/llm holds the others against brute-force versions."""
    return dict(ORACLES)
