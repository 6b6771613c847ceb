"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns virtual nodes on a ring of 64-bit positions; a row belongs to
the first node clockwise behind the hash of its key.  A shard takes rows up to
its bound only; what overflows goes on clockwise to the next shard with room.
Rows enter in ring order, so an arc of the ring needs no more than its number
of rows to be settled: the driver walks shards x nodes numbers, however many
rows there are, and each row then finds its shard by its rank within its arc.
"""

from __future__ import annotations

from bisect import bisect_right

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import numbers, range_of

COPIES_AT_ONCE = 8_192


def ring(shards: int, nodes: int, seed: int = 0) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, rising; positions are signed 64-bit numbers."""
    points = {}
    for shard in range(shards):
        for node in range(nodes):
            at = xxhash.xxh64_intdigest(f"{shard}/{node}".encode(), seed)
            points.setdefault(at - (1 << 64) if at >> 63 else at, shard)
    return sorted(points.items())


def bounds(rows: int, shards: int, load_factor: float) -> list[int]:
    """Rows that each shard may take.  At a load factor of 1 they sum to the rows, so counts differ by one at most."""
    if load_factor <= 1:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [-int(-rows * load_factor // shards)] * shards


def settle(counts: dict[int, int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, rows, shard, first slot): who takes which rows of each arc."""
    room, used, out = list(room), [0] * len(room), []
    for arc in sorted(counts):
        rank, left, at = 0, counts[arc], arc
        while left:
            shard = owners[at % len(owners)]
            if take := min(left, room[shard]):
                out.append((arc, rank, take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
                rank, left = rank + take, left - take
            at += 1
    return out


def shard(
    rows: DataFrame, key: list[str], carry: list[str] = (), shards: int = 40, nodes: int = 256,
    load_factor: float = 1.0, seed: int = 0,
) -> DataFrame:
    """Columns key and carry of every row, with shard (from 0), slot (gapless from 0 in each shard) and home, the
    shard on whose arc the row's key lies.

    Each shard takes at most load_factor times its even share; at 1.0 counts of any two shards differ by one at most.
    Nulls in key or carry are values like any other.  Rows equal in key and carry count as often as they are there and
    may go to different shards.  An empty table gives no rows.  Other columns are ignored, and result columns win over
    key columns of the same name only by an error from Spark, so keep those names apart.
    The result depends on the rows alone, not on how they are partitioned.
    """
    if shards < 1 or nodes < 1:
        raise ValueError("a ring needs a shard and a node")
    columns = [*key, *carry]
    points = ring(shards, nodes, seed)
    positions, owners = [p for p, _ in points], [s for _, s in points]
    # Equal rows are counted before anything is dealt out by key, so a key with a third of all rows is one row here.
    items = rows.groupBy(*columns).agg(F.count("*").alias("_n"))
    at = F.xxhash64(*[F.col(c) for c in key], F.lit(seed))
    items = items.withColumn("_at", at).withColumn("_arc", range_of(F.col("_at"), positions) % len(points))
    sums = items.groupBy("_arc").agg(F.sum("_n").alias("n"), F.max("_n").alias("most")).collect()  # at most shards x nodes rows
    counts = {r["_arc"]: r["n"] for r in sums}
    pieces = settle(counts, owners, bounds(sum(counts.values()), shards, load_factor))
    session = rows.sparkSession
    plan = session.createDataFrame(pieces, "_arc int, _first long, _take long, shard int, _slot long")
    owner = F.element_at(numbers(owners), F.col("_arc") + 1).cast("int")
    order = W.partitionBy("_arc").orderBy("_at", *columns)
    ranks = items.withColumn("_rank", F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("_n"))
    # At most shards x nodes + shards pieces: small enough to send to every task, whatever the input.
    met = ranks.join(F.broadcast(plan), "_arc").filter(
        (F.col("_rank") < F.col("_first") + F.col("_take")) & (F.col("_first") < F.col("_rank") + F.col("_n"))
    )
    low = F.greatest("_rank", "_first")
    high = F.least(F.col("_rank") + F.col("_n"), F.col("_first") + F.col("_take"))
    slot = F.col("_slot") + low - F.col("_first")
    placed = met.select(*columns, "shard", owner.alias("home"), slot.alias("slot"), (high - low).alias("_copies"))
    if max((r["most"] for r in sums), default=1) > COPIES_AT_ONCE:  # many equal rows: dealt out before they are written out
        chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(COPIES_AT_ONCE).cast("long")))
        placed = placed.withColumn("_c", chunk).hint("rebalance")
        rest = F.least(F.col("_copies") - F.col("_c"), F.lit(COPIES_AT_ONCE).cast("long"))
        placed = placed.withColumn("slot", F.col("slot") + F.col("_c")).withColumn("_copies", rest)
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1))
    return placed.withColumn("_c", copy).select(*columns, "shard", "home", (F.col("slot") + F.col("_c")).alias("slot"))


def home_of(at: int, points: list[tuple[int, int]]) -> int:
    """The shard of the first node behind a position."""
    return points[bisect_right([p for p, _ in points], at) % len(points)][1]


def size_and_crc() -> tuple[Column, Column]:
    """size (UTF-8 bytes of the text and 16) and text_crc32 (null for a null text) of documents."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    return size.alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32")
