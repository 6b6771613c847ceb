"""Numbered lines of text files, read in byte ranges.

A file of one range is numbered while it is read.  Of a larger one the line breaks of each range are counted first, by a
pass that only looks at bytes; a running sum over its ranges (a row each) gives every range its first line number.  A
line belongs to the range in which it starts.  Nothing is sent to all tasks, and no two scans have to agree on more than
the bytes.

Breaks are CR, LF and CRLF, a byte-order mark is left out, and broken UTF-8 becomes U+FFFD.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = 4 << 20  # bytes read at once
BATCH_BYTES = 8 << 20  # of lines handed on at once
MOST_TASKS = 50_000  # more ranges than these share tasks
BOM = b"\xef\xbb\xbf"


def open_uri(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", uri)
    return fs.FileSystem.from_uri(quote(uri, safe=":/@"))


def count_starts(file, start: int, end: int) -> int:
    """Lines that start in [start, end): the file's first, and one behind each break that ends before another byte."""
    found, at = int(start == 0), max(0, start - 1)
    file.seek(at)
    held = file.read(1)  # the byte behind the last one counted
    while at + 1 < end:
        data = held + file.read(min(CHUNK, end - at - 1))
        body = data[:-1]
        if not body:
            break
        found += body.count(b"\n") + body.count(b"\r") - data.count(b"\r\n")
        at, held = at + len(body), data[-1:]
    return found


def lines_in(file, start: int, end: int) -> Iterator[bytes]:
    """The lines that start in [start, end), without their breaks."""
    at = max(0, start - 1)
    file.seek(at)
    skip, rest = start > 0, b""
    while at < end or rest:
        data = file.read(max(CHUNK, len(rest)))
        pieces = (rest + data).splitlines(keepends=True)
        # A piece may go on, and a CR may belong to an LF behind it.
        rest = pieces.pop() if data and pieces and not pieces[-1].endswith(b"\n") else b""
        for piece in pieces:
            if skip:
                skip = False
            elif at >= end:
                return
            else:
                line = piece.removesuffix(b"\n").removesuffix(b"\r") if piece.endswith(b"\n") else piece.removesuffix(b"\r")
                yield line.removeprefix(BOM) if at == 0 else line
            at += len(piece)
        if not data:
            return


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts = []
        for row in batch.itertuples():
            files, path = open_uri(row.path)
            with files.open_input_file(path) as file:
                counts.append(count_starts(file, row.start, row.end))
        yield batch.assign(starts=pd.Series(counts, index=batch.index, dtype="int64"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(path: str, first: int, lines: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([path] * len(lines), pa.string()), pa.array(range(first, first + len(lines)), pa.int64()), pa.array(lines, pa.string())],
            names=["path", "line_no", "raw"],
        )

    for batch in batches:
        for row in batch.to_pylist():
            files, path = open_uri(row["path"])
            first, held, size = row["first"], [], 0
            with files.open_input_file(path) as file:
                for line in lines_in(file, row["start"], row["end"]):
                    held.append(line.decode(errors="replace"))
                    size += len(line) + 16
                    if size > BATCH_BYTES:
                        yield rows(row["path"], first, held)
                        first, held, size = first + len(held), [], 0
            if held:
                yield rows(row["path"], first, held)


def range_bytes(spark: SparkSession) -> int:
    """The session's size of a split."""
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    return spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size.removesuffix("b"))


def found_files(spark: SparkSession, pattern: str, **options) -> DataFrame:
    """(path, length) of files; contents are not read."""
    return spark.read.format("binaryFile").options(**options).load(pattern).select("path", "length")


def stream_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Stream of (path, length) of new files; lines_of reads a micro-batch of them in foreachBatch."""
    return spark.readStream.format("binaryFile").schema(
        "path string, modificationTime timestamp, length long, content binary"
    ).load(pattern).select("path", "length")


def lines_of(files: DataFrame, size: int | None = None) -> DataFrame:
    """files(path, length) -> (path, line_no, raw), line numbers from 0.  Empty files have no lines."""
    spark = files.sparkSession
    size = size or range_bytes(spark)
    total = files.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, min(MOST_TASKS, total // size))
    ranges = files.filter("length > 0").select(
        "path", "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / size))).alias("nr")
    ).select("path", "length", (F.col("nr") * size).alias("start"), F.least("length", (F.col("nr") + 1) * size).alias("end"))
    large = ranges.filter(F.col("length") > size).repartition(tasks, "path", "start")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    counted = large.mapInPandas(_count, "path string, length long, start long, end long, starts long").select(
        "path", "start", "end", F.coalesce(F.sum("starts").over(before), F.lit(0)).alias("first")
    )
    small = ranges.filter(F.col("length") <= size).select("path", "start", "end", F.lit(0).cast("long").alias("first"))
    return small.unionByName(counted).repartition(tasks, "path", "start").mapInArrow(_read, "path string, line_no long, raw string")
