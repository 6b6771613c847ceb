"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes that separate words, and the same for Python's translate().
SPACES = r"[\x20\x09-\x0D]+"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own on local masters only."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="redbuild-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Computes the rows once, into the shared folder; a lost executor then costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Like checkpointed, as Parquet: smaller, and columns can be read one by one."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Long texts: rows that Arrow hands to Python at once."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that df's columns have already (letter case doesn't tell columns apart)."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slices(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbers(values: list[int]) -> Column:
    """A constant array, of any length, as one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def bounds_of(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most parts - 1 rising values that cut the rows into ranges of about equal counts."""
    cuts = df.select(F.col(column).cast("double")).approxQuantile(column, [i / parts for i in range(1, parts)], 0.2 / parts)
    return sorted({int(x) for x in cuts})


def range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the rising bounds are at most value: a binary search within the row."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    table = numbers(bounds)
    found = lambda at, step: F.coalesce(F.try_element_at(table, (at + step).cast("int")) <= value, F.lit(False))
    return F.aggregate(F.lit(steps).cast("array<int>"), F.lit(0), lambda at, step: at + F.when(found(at, step), step).otherwise(0))


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Adds rank (from 0, gapless) over all rows; counts per range are summed, rows never meet in one task."""
    cut = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = cut.groupBy("_part").agg(F.count("*").alias("_n")).collect()  # one row per partition
    before, total = {}, 0
    for row in sorted(counts):
        before[row["_part"]], total = total, total + row["_n"]
    if not before:
        return cut.select(*df.columns, F.lit(0).cast("long").alias("rank"))
    shift = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_part"))
    from pyspark.sql import Window as W

    own = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return cut.select(*df.columns, (own - 1 + shift).cast("long").alias("rank"))
