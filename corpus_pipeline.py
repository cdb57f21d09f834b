"""A corpus pipeline of five stages over ``documents``. Each stage's rows are written as Parquet and read again by the next.

1. Language identification: documents without a letter, or whose language has a probability under one half, go.
2. Quality rules: documents that fail the base rule go, and those that their host's verdict rejects.
3. N-gram Jaccard join: of each group of near duplicates one row stays, the one with the least id (null ids last); of rows
   with one id, the one with the least hash. Rows are told apart by 64 bits hashed from id and text, so different texts
   with one id, or without an id, are different documents; two rows get one hash with a probability of about n²/2⁶⁵.
4. Mixing: every document is repeated as often as its source's weight asks, once at least.
5. SentencePiece: the remaining texts are encoded, decoded and compared.

Null and empty texts go in stage 1; nulls in other columns are kept. Extra columns pass through the first four stages. Very long texts
are read whole in every stage. An empty table gives an empty table in every stage (without documents no language is learned).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabweave.llm import langid, mixing, ngram_join, pieces, quality_rules
from tabweave.llm.common import fresh, id_remainder, materialize, read_table, small_batches


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = langid.train(docs, F.coalesce(id_remainder(F.col("doc_id"), 4) != 2, F.lit(True)))
    return langid.keep_known(docs, model)


def quality_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality_rules.keep_passing(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    # names that no column of the documents has
    key, nth = fresh("_key", docs.columns), fresh("_nth", docs.columns)
    keyed = docs.withColumn(key, F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull()))
    found = ngram_join.near_duplicates(keyed, key).select(F.col("doc_id").alias(key), "component_id").distinct()
    ids = keyed.select(key, "doc_id").distinct()
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(key).alias("key")))
    first = found.join(ids, key).groupBy("component_id").agg(least.alias("m")).select(F.col("m.key").alias(key))
    order = [f"`{c}`" for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    numbered = keyed.join(first, key, "left_semi").withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return numbered.where(F.col(nth) == 1).select(*[f"`{c}`" for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pieces.encode_documents(docs, ["doc_id", "lang", "source"])


STAGES = [("language_id", language_id), ("quality_rules", quality_by_rules), ("ngram_jaccard", one_of_each_group), ("mixing", mix_sources), ("sentencepiece", encode)]

#: The first stage's model, the third's components over approximate prefixes and the last's pieces are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
