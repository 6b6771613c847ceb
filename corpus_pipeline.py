"""A training corpus from raw documents: judged, freed of near copies and test items, mixed, and dealt into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from redbuild.llm import cotrain, decontaminate, mixing, sharding, simhash
from redbuild.llm.common import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely good than bad."""
    return cotrain.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group linked by fingerprints of three-word shingles at 3 bits or fewer."""
    return simhash.one_of_each(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of test items; those that are mostly such passages go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the words of each source come to its target."""
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The manifest of the corpus: every row's shard and slot."""
    sized = docs.select("doc_id", "source", "lang", *sharding.size_and_crc())
    return sharding.shard(sized, key=["doc_id"], carry=["source", "lang", "size", "text_crc32"], shards=40)


#: The numbers of the operators are 8, 4, 3, 6 and 1.
STAGES = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("benchmark_free", benchmark_free),
    ("mixture", mixture), ("shards", shards),
]

#: Fits, fingerprints and draws are not SQL: tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
