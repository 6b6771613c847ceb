"""Landed JSON documents: failure payloads, CI jobs and steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ci_runs import normalized_status
from . import schemas as S


def with_documents(texts: DataFrame, text: str = "value") -> DataFrame:
    """A JSON text -> the known fields of a payload, and all of it as `document` (VARIANT), so that unknown fields stay.
    Unreadable text has no fields and is kept as a string; other columns stay."""
    document = F.coalesce(F.try_parse_json(F.col(text)), F.col(text).cast("variant"))
    return texts.filter(F.trim(F.col(text)) != "").select(
        F.from_json(F.col(text), S.PAYLOAD).alias("known"), document.alias("document"),
        *[c for c in texts.columns if c != text],
    ).select("known.*", "document", *[c for c in texts.columns if c != text])


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landed payloads, a JSON text per line, with `document`."""
    return with_documents(spark.read.text(path))


def stream_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Payloads with received_at, the time at which their file landed."""
    found = spark.readStream.text(path)
    return with_documents(found.select("value", F.col("_metadata.file_modification_time").alias("received_at")))


def hub_jobs(runs: DataFrame) -> DataFrame:
    """Job rows of hosted-workflow runs; conclusions become status names."""
    return runs.select("run_id", F.explode("jobs").alias("j")).select(
        "run_id", F.col("j.id").cast("string").alias("id"), F.col("j.name").alias("displayName"),
        normalized_status(F.col("j.conclusion")).alias("result"), F.col("j.status").alias("status"),
        F.col("j.steps").alias("steps"),
    )


def hub_steps(jobs: DataFrame) -> DataFrame:
    return jobs.select("run_id", F.col("id").alias("job_id"), F.col("displayName").alias("stage"), F.posexplode("steps").alias("pos", "s")).select(
        "run_id", "job_id", "stage", "pos", F.col("s.number").cast("string").alias("id"),
        F.col("s.name").alias("name"), F.col("s.conclusion").alias("conclusion"),
        F.col("s.status").alias("status"), F.col("s.log").alias("log"),
    )


def pipeline_jobs(runs: DataFrame) -> DataFrame:
    """Stage rows of pipeline-server runs."""
    return runs.select("run_id", F.explode("nodes").alias("n")).select(
        "run_id", "n.id", "n.displayName", "n.result", F.col("n.state").alias("status"), F.col("n.steps").alias("steps")
    )


def pipeline_steps(jobs: DataFrame) -> DataFrame:
    return jobs.select("run_id", F.col("id").alias("job_id"), F.col("displayName").alias("stage"), F.posexplode("steps").alias("pos", "s")).select(
        "run_id", "job_id", "stage", "pos", "s.id", F.col("s.displayName").alias("name"),
        F.col("s.result").alias("conclusion"), F.col("s.state").alias("status"), F.col("s.log").alias("log"),
    )


def read_hub_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.HUB_RUN).json(path)


def read_pipeline_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.PIPELINE_RUN).json(path)
