"""A training-data pipeline over ``documents`` in five stages: language ID, toxicity, n-gram Jaccard join, mixing, packing.

Each stage works on all rows its predecessor kept. A run writes every stage's rows
as Parquet in the shared folder and reads them again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haploweave.llm import jaccard_join, language_id, mixing, packing, queries, toxicity
from haploweave.llm.store import written


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose id is not in ids; rows with a null id stay.

    Only rows that share one of 2^19 hash values with an id are shuffled for the exact comparison."""
    ids = written(ids.distinct(), "rejected")
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 19)).cast("int").alias("_slot")
    slots = F.broadcast(ids.select(slot).distinct())
    marked = docs.withColumn("_slot", slot)
    near, far = marked.join(slots, "_slot", "left_semi"), marked.join(slots, "_slot", "left_anti")
    return far.unionByName(near.join(ids, "doc_id", "left_anti")).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language (und) go."""
    return docs.where(language_id.language_column(spark, language_id.fit(docs)) != "und")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return docs.where(toxicity.score_column(spark, toxicity.fit(docs, labels)) < 0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the smallest id; of rows that share an id, one."""
    found = written(jaccard_join.join(docs).select("doc_id", "component_id"), "joined")
    kept = _without(docs, found.where("doc_id <> component_id").select("doc_id"))
    twice = found.groupBy("doc_id").count().where("doc_id IS NOT NULL AND count > 1")
    if twice.head(1):
        named = kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
        kept = named.unionByName(kept.where("doc_id IS NULL"))
    return kept


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last repetition cut where the target is met."""
    return mixing.materialise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their places in sequences."""
    return packing.pack_documents(docs, **queries.tokenizer_files())


STAGES = [("language_id", language), ("toxicity", clean), ("near_duplicates", near_duplicates), ("mixing", mixed), ("packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
