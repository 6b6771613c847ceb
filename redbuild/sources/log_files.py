"""Stage logs as files: <root>/<failure_id>/<stage>.log, written in two phases.

First the tasks write files of their own names, line by line from sorted rows, and a manifest says which of them count: a
repeated or lost attempt leaves files that no manifest names.  Then each named file is moved to its place, which can be
repeated at any point.  A stage is never held whole: the sort spills, and rows come in Arrow batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .log_ranges import open_uri

MANIFEST = "failure_id string, stage string, staged string, lines long, bytes long"


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as all tasks see it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()


class _File:
    """One staged log."""

    def __init__(self, folder: str, key: tuple[str, str]):
        self.key, self.name, self.lines, self.bytes = key, f"{uuid.uuid4().hex}.part", 0, 0
        files, path = open_uri(folder)
        files.create_dir(path, recursive=True)
        self.out = files.open_output_stream(f"{path}/{self.name}")

    def add(self, lines: list[str | None]) -> None:
        data = "".join(f"{line or ''}\n" for line in lines).encode()
        self.out.write(data)
        self.lines, self.bytes = self.lines + len(lines), self.bytes + len(data)

    def close(self) -> tuple[str, str, str, int, int]:
        self.out.close()
        return (*self.key, self.name, self.lines, self.bytes)


def _stage(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, done = None, []
        for batch in batches:
            rows = batch.to_pandas()
            fresh = (rows["failure_id"] != rows["failure_id"].shift()) | (rows["file"] != rows["file"].shift())
            for _, part in rows.groupby(fresh.cumsum(), sort=False):
                key = (part["failure_id"].iloc[0], part["file"].iloc[0])
                if current is None or current.key != key:
                    if current is not None:
                        done.append(current.close())
                    current = _File(folder, key)
                current.add(part["raw"].tolist())
            if done:
                yield _rows(done)
                done = []
        if current is not None:
            yield _rows([current.close()])

    return write


def _rows(done: list[tuple[str, str, str, int, int]]) -> pa.RecordBatch:
    names = ["failure_id", "stage", "staged", "lines", "bytes"]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*done), types)], names=names)


def stage_files(lines: DataFrame, root: str, batch_id: int) -> None:
    """First phase: (failure_id, stage, line_no, raw) -> staged files and their manifest.

    Stages whose names become the same file follow one another in it; equal line numbers are ordered by text, so a replay
    writes the same bytes.  A NULL line is empty.  A failure id that is no folder name, or a missing stage, is an error.
    """
    base = _qualified(lines.sparkSession, root)
    odd = F.col("failure_id").isNull() | F.col("stage").isNull() | F.col("failure_id").rlike(r"^(|\.|\.\.|_.*)$|[/\\\x00]")
    known = F.when(odd, F.raise_error(F.concat(F.lit("no file for failure "), F.coalesce("failure_id", F.lit("NULL"))))).otherwise(
        F.col("failure_id")
    )
    rows = lines.select(known.alias("failure_id"), X.sanitize_stage(F.col("stage")).alias("file"), "stage", "line_no", "raw")
    ordered = rows.repartition("failure_id", "file").sortWithinPartitions("failure_id", "file", "stage", "line_no", "raw")
    staged = ordered.select("failure_id", "file", "raw").mapInArrow(_stage(f"{base}/_staged/{batch_id}/files"), MANIFEST)
    staged.write.mode("overwrite").parquet(f"{base}/_staged/{batch_id}/manifest")


def commit_files(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    """Second phase: moves what the manifest names into place, and returns (failure_id, stage, lines, bytes).

    A file that was moved before is left where it is, so the phase can be repeated after any failure.
    """
    base = _qualified(spark, root)
    folder = f"{base}/_staged/{batch_id}/files"

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                files, staged = open_uri(f"{folder}/{row.staged}")
                _, place = open_uri(f"{base}/{row.failure_id}/{row.stage}.log")
                if files.get_file_info(staged).type == fs.FileType.File:
                    files.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    files.move(staged, place)
                elif files.get_file_info(place).size != row.bytes:
                    raise OSError(f"neither {staged} nor all of {place} is there")
            yield batch[["failure_id", "stage", "lines", "bytes"]]

    manifest = spark.read.parquet(f"{base}/_staged/{batch_id}/manifest")
    moved = manifest.mapInPandas(move, "failure_id string, stage string, lines long, bytes long")
    moved.write.mode("overwrite").parquet(f"{base}/_written/batch_id={batch_id}")
    files, staging = open_uri(folder)
    if files.get_file_info(staging).type == fs.FileType.Directory:
        files.delete_dir(staging)  # files of attempts that don't count
    return spark.read.parquet(f"{base}/_written/batch_id={batch_id}")


def write_log_files(lines: DataFrame, root: str, batch_id: int) -> DataFrame:
    """Both phases: the log files of a batch, which replace those of an earlier try.  Reads back with read_stage_logs."""
    stage_files(lines, root, batch_id)
    return commit_files(lines.sparkSession, root, batch_id)
