"""A corpus pipeline: quality rules, near-dedup, personal data, mixing, tokens. Each stage works on the table that its predecessor wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernel.llm import bpe, minhash, mixing, pii, quality
from quernel.llm.common import fresh, shared_dir, unstage


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned rules keep. Null texts go, as they have no words."""
    name = fresh("judged", docs.columns)
    return quality.judge(docs, quality.fit(docs, _labels(spark, sf_dir)), name).where(f"{name}.kept").select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the least id. Of rows that share an id the first by text stays; rows without an id all stay."""
    n, place = fresh("rows_of_id", docs.columns), fresh("place_of_row", docs.columns)
    kept = minhash.near_duplicates(docs).where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias(n))
    own = docs.join(kept, "doc_id")
    once = own.where(F.col(n) == 1).select(*docs.columns)
    first = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), *(F.col(c) for c in docs.columns if c not in ("doc_id", "text")))
    several = own.where(F.col(n) > 1).withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).select(*docs.columns)
    return once.unionByName(several).unionByName(docs.where("doc_id is null"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by the kinds' names; n_chars is that of the new text."""
    out = docs.withColumn("text", pii.redact(F.col("text"), pii.fit(docs)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them."""
    return mixing.mixed(docs, _labels(spark, sf_dir))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of the ids and of the bytes that they decode to."""
    import public_tokenizers as tokenizers

    return bpe.round_trip(docs.select("doc_id", "text"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN).drop("text")


STAGES = [("quality rules", keep_good), ("near-dedup", keep_one_of_each), ("personal data", without_personal_data), ("mixing", mix), ("byte-level BPE", encode)]

#: Learned rules and links between near-duplicates aren't SQL's; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again; what a stage has read goes once its own table is written."""
    docs, top = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{top}/{k}")
        if k:
            unstage(docs)
        docs = spark.read.schema(made.schema).parquet(f"{top}/{k}")
    return docs
