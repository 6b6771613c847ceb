"""SimHash near-duplicates, found by multi-index hashing.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most one
bit of one of their halves.  Each fingerprint stands in a table under each of
its halves, and looks there under all halves at one bit's distance; whole
distances are then verified.  Equal fingerprints are one from the start, and a
bucket yields a forest of links, not its pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import TO_LOWER, small_batches, slices, unused, written
from .graph import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
RADIUS = 3
HOT_BUCKET = 16_384  # fingerprints under one half; beyond it the bucket is split by the other half
SMALL = 32
PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    tokens = WORD.findall((text or "").encode().translate(TO_LOWER))
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    joined, h = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= size:
        return np.array([h(joined, SEED)], dtype=np.uint64)
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    cuts = zip((ends - lengths)[:len(tokens) - size + 1].tolist(), ends[size - 1:].tolist())
    return np.fromiter((h(joined[a:b], SEED) for a, b in cuts), dtype=np.uint64, count=len(tokens) - size + 1)


def _voted(hashes: np.ndarray) -> int:
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[at:at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<i8")[0])


def simhash(text: str | None, size: int) -> int:
    """The fingerprint as a signed number; 0 for a text without words."""
    return _voted(shingle_hashes(text, size))


def fingerprints(docs: DataFrame, size: int = 3, name: str = "fp") -> DataFrame:
    """docs with the fingerprint of the column text, as `name`.  Words end at white space, A-Z count as a-z; null texts
    have no words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash(t, size) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps, pa.int64())], [*batch.schema.names, name])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def _dealt(values: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(segment, rows, keys, whether it is the table) of both segments of `bits` bits, for unsigned values.

    Of two segments that differ in one bit, the one without it looks under the other, so a pair is met once.
    """
    mask = np.uint64((1 << bits) - 1)
    every = np.arange(len(values))
    for segment in (0, 1):
        part = values >> np.uint64(segment * bits) & mask
        yield segment, every, part, True
        for i in range(bits):
            bit = np.uint64(1 << i)
            without = np.flatnonzero(part & bit == 0)
            yield segment, without, part[without] | bit, False


def _probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False)
        for segment, rows, keys, table in _dealt(fps.view(np.uint64), 32):
            key = (keys | np.uint64(segment << 32)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[rows]), pa.array(np.full(len(rows), table))], ["key", "fp", "stored"])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of hot buckets, dealt again by the segments of the half that the bucket leaves open."""
    for batch in batches:
        key, fps = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp"))
        by_high = (key >> 32 & 1).astype(bool)  # the bucket's key is the upper half
        value = fps.view(np.uint64)
        other = np.where(by_high, value & np.uint64(0xFFFFFFFF), value >> np.uint64(32))
        for segment, rows, part, table in _dealt(other, 16):
            own = (np.int64(1 << 62) | key[rows] << 17 | np.int64(segment << 16)) | part.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(fps[rows]), pa.array(np.full(len(rows), table))], ["key", "fp", "stored"])


def _forest(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that connect all values within RADIUS of each other; each is compared with those not yet reached only."""
    rest = np.unique(values)
    while len(rest):
        root, queue, rest = rest[0], [rest[0]], rest[1:]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= RADIUS
            for x in rest[near]:
                yield root, x
                queue.append(x)
            rest = rest[~near]


def _verified(keys: np.ndarray, fps: np.ndarray, stored: np.ndarray) -> pa.RecordBatch:
    """Links within buckets, given rows in the order of their keys."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    counts = np.diff(np.r_[starts, len(keys)])
    met = (counts > 1) & (np.add.reduceat(stored.astype(np.int64), starts) > 0)
    a, b = [], []
    small = np.repeat(met & (counts <= SMALL), counts)
    run, value = np.repeat(np.arange(len(starts)), counts)[small], fps[small].view(np.uint64)
    for step in range(1, SMALL):
        if len(run) <= step or not (same := run[step:] == run[:-step]).any():
            break
        i = np.flatnonzero(same)
        i = i[np.bitwise_count(value[i] ^ value[i + step]) <= RADIUS]
        a.append(value[i])
        b.append(value[i + step])
    for k in np.flatnonzero(met & (counts > SMALL)):
        if links := list(_forest(fps[starts[k]:starts[k] + counts[k]].view(np.uint64))):
            pairs = np.array(links, dtype=np.uint64)
            a.append(pairs[:, 0])
            b.append(pairs[:, 1])
    both = [np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in both], schema=PAIR)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "stored")]
        held = [np.concatenate(x) for x in zip(held, now)] if held else now
        if not len(held[0]):
            continue
        cut = np.searchsorted(held[0], held[0][-1])  # the last bucket may go on
        if cut:
            yield _verified(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
    if held and len(held[0]):
        yield _verified(*held)


def links(distinct: DataFrame, hot: int = HOT_BUCKET) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (fp) that connect all within RADIUS bits of each other.

    A bucket is sorted through in one task, and never has more than `hot` stored fingerprints: a larger one is dealt
    again by 16-bit segments of its other half, whose buckets can't hold more than 65,536.
    """
    row = "key long, fp long, stored boolean"
    spark = distinct.sparkSession
    rows = distinct.select("fp").mapInArrow(_probes, row)
    halves = distinct.select(F.explode(F.array(F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32) + F.lit(1 << 32))).alias("key"))
    full = written(halves.groupBy("key").count().filter(F.col("count") > hot).select("key"), "buckets")
    if full.head(1):
        rows = written(rows, "probes")
        again = rows.join(full, "key", "left_semi").mapInArrow(_split, row)
        rows = rows.join(full, "key", "left_anti").unionByName(again)
    return rows.repartition(slices(spark), "key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 3, hot: int = HOT_BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs: component_id is the least doc_id among the documents linked to
    it by fingerprints within RADIUS bits, directly or through others, itself included.

    Texts without words (null, empty, white space) share fingerprint 0 and are linked like any other.  Rows with equal
    ids or texts give a row each.  Null ids are ignored in the choice of component_id, which is null if all are null.
    Only doc_id and text are used.  An empty table gives no rows.
    """
    fps = written(fingerprints(docs.select("doc_id", "text"), size).select(F.col("doc_id").cast("long"), "fp"), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    labels = components(links(distinct, hot)).withColumnRenamed("node", "fp")
    joined = distinct.join(labels, "fp")
    least = joined.groupBy("label").agg(F.min("first").alias("component"))
    linked = written(joined.join(least, "label").select("fp", "component"), "linked")
    of = written(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component", "first").alias("component_id")), "components")
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, size: int = 3, hot: int = HOT_BUCKET) -> DataFrame:
    """docs with one row of each group of near_duplicates(): the row of the least doc_id, then of the least hash of its
    text, rows without id last.

    Rows of one id with different texts are documents of their own, each in the group of its text.  All texts without
    words are one group.  All columns are kept, whatever their names.
    """
    rid, fp = unused(docs, "rid", "fp")
    # The numbers are given while writing, so every later read sees the same.
    rows = written(fingerprints(docs, size, fp).withColumn(rid, F.monotonically_increasing_id()), "rows")
    of = [F.col("doc_id").isNull().alias("lost"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.col(rid).alias("rid")]
    best = written(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(F.struct(*of)).alias("best")), "distinct")
    labels = components(links(best, hot)).withColumnRenamed("node", "fp")
    group = best.join(labels, "fp", "left").groupBy(F.coalesce("label", "fp").alias("label")).agg(F.min("best").alias("best"))
    keep = written(group.select(F.col("best.rid").alias(rid)), "kept")
    # Texts are shuffled once, however few documents there are: the plan is the same at every size.
    return rows.join(keep.hint("merge"), rid, "left_semi").select(*docs.columns)
