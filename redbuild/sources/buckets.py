"""Keyed tables in buckets: an update touches the buckets of its keys only.

    <path>/data/<batch>-<random>/_bucket=<n>/*.parquet     rows, never changed once written
    <path>/commits/<batch>.json                            which folders make up each bucket

Rows of a key are in the bucket of its hash.  A batch writes folders for the buckets it touches and then one small file
that names the folders of all buckets; readers open the newest such file and so see whole batches only.  A batch that runs
again starts from the commit before its own and replaces what it committed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
RUNS = 16  # folders of a bucket, beyond which append() makes one of them
KEPT = 2  # commits: the one before the newest stays for replays and for readers that have just begun


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def names_in(spark: SparkSession, path: str) -> list[str]:
    fs, place = _place(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _place(spark, path)
    fs.delete(place, True)


def commits(spark: SparkSession, path: str, before: int | None = None) -> list[int]:
    found = sorted(int(n[:-5]) for n in names_in(spark, f"{path}/commits") if n.endswith(".json"))
    return [c for c in found if before is None or c < before]


def _commit(spark: SparkSession, path: str, batch_id: int) -> dict:
    fs, place = _place(spark, f"{path}/commits/{batch_id}.json")
    stream = fs.open(place)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def newest(spark: SparkSession, path: str, before: int | None = None, buckets: int = BUCKETS) -> dict:
    """The last commit (before a batch): how many buckets there are, and the folders of each."""
    found = commits(spark, path, before)
    return _commit(spark, path, found[-1]) if found else {"buckets": buckets, "folders": {}}


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def read(
    spark: SparkSession, path: str, schema: str, before: int | None = None, only: list[int] | None = None, commit: dict | None = None
) -> DataFrame:
    """Rows of the last commit (before a batch), of some buckets if `only` says so; empty before the first one."""
    folders = (commit or newest(spark, path, before))["folders"]
    wanted = [f"{path}/{f}" for b, own in folders.items() if only is None or int(b) in only for f in own]
    return spark.read.schema(schema).parquet(*wanted) if wanted else spark.createDataFrame([], schema)


def _written(rows: DataFrame, path: str, batch_id: int, keys: list[str], buckets: int) -> dict[str, list[str]]:
    """Writes rows to folders of their own; the folder of each bucket that has any."""
    folder = f"data/{batch_id}-{uuid.uuid4().hex}"
    dealt = rows.withColumn("_bucket", bucket_of(keys, buckets)).repartition("_bucket")
    dealt.write.partitionBy("_bucket").parquet(f"{path}/{folder}")
    found = [n for n in names_in(rows.sparkSession, f"{path}/{folder}") if n.startswith("_bucket=")]
    return {n.split("=")[1]: [f"{folder}/{n}"] for n in found}


def _publish(spark: SparkSession, path: str, batch_id: int, commit: dict) -> None:
    """Makes a commit the newest, and removes what neither it nor the ones kept before it name."""
    fs, place = _place(spark, f"{path}/commits/{batch_id}.json")
    _, draft = _place(spark, f"{path}/commits/{batch_id}-{uuid.uuid4().hex}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(commit).encode()))
    out.close()
    if fs.exists(place):
        fs.delete(place, False)
    if not fs.rename(draft, place):
        raise OSError(f"commit {batch_id} of {path} could not be put in place")
    kept = commits(spark, path)[-KEPT:]
    for old in commits(spark, path)[:-KEPT]:
        remove(spark, f"{path}/commits/{old}.json")
    named = {f for c in kept for own in _commit(spark, path, c)["folders"].values() for f in own}
    for run in names_in(spark, f"{path}/data"):
        own = [f"data/{run}/{n}" for n in names_in(spark, f"{path}/data/{run}") if n.startswith("_bucket=")]
        gone = [f for f in own if f not in named]
        if len(gone) == len(own):
            remove(spark, f"{path}/data/{run}")
        else:
            for f in gone:
                remove(spark, f"{path}/{f}")


def merge(arrivals: DataFrame, path: str, batch_id: int, schema: str, keys: list[str], merged, buckets: int = BUCKETS) -> None:
    """Rewrites the buckets that arrivals touch as merged(their rows, arrivals); the files of all others stay."""
    spark = arrivals.sparkSession
    base = newest(spark, path, batch_id, buckets)
    # One row for each bucket at most.
    touched = [r["b"] for r in arrivals.select(bucket_of(keys, base["buckets"]).alias("b")).distinct().collect()]
    stored = read(spark, path, schema, only=touched, commit=base)
    found = _written(merged(stored, arrivals), path, batch_id, keys, base["buckets"]) if touched else {}
    _publish(spark, path, batch_id, {"buckets": base["buckets"], "folders": base["folders"] | found})


def append(rows: DataFrame, path: str, batch_id: int, schema: str, keys: list[str], buckets: int = BUCKETS, runs: int = RUNS) -> None:
    """Adds rows to the buckets of their keys; a bucket of more than `runs` folders becomes one."""
    spark = rows.sparkSession
    base = newest(spark, path, batch_id, buckets)
    folders = dict(base["folders"])
    for b, own in _written(rows, path, batch_id, keys, base["buckets"]).items():
        folders[b] = folders.get(b, []) + own
    full = [int(b) for b, own in folders.items() if len(own) > runs]
    if full:
        whole = read(spark, path, schema, only=full, commit={"folders": folders})
        folders |= _written(whole, path, batch_id, keys, base["buckets"])
    _publish(spark, path, batch_id, {"buckets": base["buckets"], "folders": folders})


def unseen(rows: DataFrame, path: str, batch_id: int, schema: str, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """rows whose keys no earlier batch has stored; only the buckets of these keys are read.  A null key equals none."""
    spark = rows.sparkSession
    base = newest(spark, path, batch_id, buckets)
    touched = [r["b"] for r in rows.select(bucket_of(keys, base["buckets"]).alias("b")).distinct().collect()]
    return rows.join(read(spark, path, schema, only=touched, commit=base).select(*keys), keys, "left_anti")
