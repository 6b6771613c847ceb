"""Stored tables: batches of rows, embeddings, and the pattern table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import knowledge
from . import buckets
from . import schemas as S


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Adds a batch of rows.  Writing the same batch again replaces it, also by
    no rows, so a replay adds nothing and leaves nothing behind."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All batches; sort by batch_id, newest first, where the order matters."""
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def write_embeddings(rows: DataFrame, path: str, batch_id: int) -> None:
    """(failure_id, fingerprint, embedding); rows without a vector are not stored."""
    stored = rows.select("failure_id", "fingerprint", "embedding").filter(F.col("embedding").isNotNull())
    write_batch(stored, path, batch_id)


def attach_embeddings(root_causes: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Adds the stored vector of (failure_id, fingerprint), NULL if absent; of
    several batches the newest counts."""
    newest = embeddings.groupBy("failure_id", "fingerprint").agg(
        F.max_by("embedding", "batch_id").alias("embedding")
    ) if "batch_id" in embeddings.columns else embeddings
    return root_causes.join(newest, ["failure_id", "fingerprint"], "left")


def read_patterns(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The pattern table as of its last commit (before a batch); empty at first."""
    return buckets.read(spark, path, S.PATTERNS, before)


def upsert_patterns(arrivals: DataFrame, path: str, batch_id: int, order: list[str]) -> None:
    """Merges arrivals into the buckets of their fingerprints.  A replayed batch
    starts from the commit before it again, so no recurrence is counted twice."""
    buckets.merge(
        arrivals.filter(F.col("embedding").isNotNull()), path, batch_id, S.PATTERNS, ["fingerprint"],
        lambda stored, new: knowledge.upsert(stored, new, order),
    )
