"""Stage logs: files in, lines out, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .log_ranges import found_files, lines_of, stream_files


def _path_part(from_end: int) -> Column:
    return F.element_at(F.split(F.col("path"), "/"), -from_end)


def _stage() -> Column:
    return F.replace(_path_part(1), F.lit(".log"), F.lit(""))


def stage_lines(files: DataFrame) -> DataFrame:
    """(path, length) of <failure_id>/<stage>.log -> their lines, in batches or in foreachBatch of a stream of files."""
    return lines_of(files).select(_path_part(2).alias("failure_id"), _stage().alias("stage"), "line_no", "raw")


def read_stage_logs(spark: SparkSession, root: str) -> DataFrame:
    """lines of every <root>/<failure_id>/<stage>.log."""
    return stage_lines(found_files(spark, f"{root}/*/*.log"))


def stream_stage_logs(spark: SparkSession, root: str) -> DataFrame:
    """Stream of new log files; stage_lines gives the lines of a micro-batch."""
    return stream_files(spark, f"{root}/*/*.log")


def read_log_folder(spark: SparkSession, folder: str, failure_id: str) -> DataFrame:
    """Any folder of .log files as one failure; an empty folder is an error."""
    found = found_files(spark, folder, pathGlobFilter="*.log")
    if not found.inputFiles():
        raise ValueError(f"no .log files in {folder}")
    return lines_of(found).select(F.lit(failure_id).alias("failure_id"), _stage().alias("stage"), "line_no", "raw")


def write_stage_logs(lines: DataFrame, path: str, batch_id: int) -> None:
    """Stores lines with sanitised stage names.  Replaying a batch replaces it."""
    (
        lines.withColumn("stage", X.sanitize_stage(F.col("stage"))).withColumn("batch_id", F.lit(batch_id))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
    )
