"""The registered queries of the corpus operators: ``QUERIES`` and, where SQL can express them, ``ORACLES`` (DuckDB)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm import chat, divergence, fingerprints, langid, licences, mixing, ngram_join, pieces, quality, quality_rules, sharding, toxicity, whitening
from tabweave.llm.common import id_remainder, read_table
from tabweave.llm.oracles import ORACLES  # noqa: F401


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), held_out)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(read_table(spark, sf_dir, "documents"), ["doc_id"])


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.grade(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read_table(spark, sf_dir, "documents"), licences.registry(spark))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).withColumns({k: F.round(k, 9) for k in ("weight", "slot")})


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", *quality_rules.STATS, "base_failed", "by_host", "kept")


def host_rules_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of op9 where hosts differ: documents are grouped by the number of digits of their length."""
    host = F.concat(F.lit("len"), F.length(F.length("text").cast("string")))
    docs = read_table(spark, sf_dir, "documents").withColumn("host", host)
    return quality_rules.judge(docs, ["doc_id"], "host").select("doc_id", *quality_rules.STATS, "base_failed", "by_host", "kept")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    remainder = id_remainder(F.col("doc_id"), 4)
    model = langid.train(docs, F.coalesce(remainder != 2, F.lit(True)))
    return langid.detect(docs.withColumn("held_out", F.coalesce(remainder == 2, F.lit(False))), model, ["doc_id", "held_out"])


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (op1_quality, op2_sentencepiece, op3_ngram_jaccard, op4_lz_fingerprint, op5_toxicity, op6_licences, op7_chat, op8_mixing, op9_quality_rules, op10_langid, op11_sharding, op12_divergence, op13_whitening, host_rules_by_length)
}
