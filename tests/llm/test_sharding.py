from collections import Counter

import pytest
from pyspark.sql import functions as F

from redbuild.llm import sharding


def dealt(frame, **options):
    return sharding.shard(frame, ["doc_id"], ["text"], **options).collect()


def test_counts_are_even_and_slots_gapless(make):
    rows = dealt(make([f"t{i}" for i in range(1003)]), shards=10)
    counts = Counter(r["shard"] for r in rows)
    assert sorted(counts.values()) == [100] * 7 + [101] * 3
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n)) for s, n in counts.items())
    assert sum(r["shard"] != r["home"] for r in rows) < 200  # few leave their arc's shard


def test_equal_to_a_plain_walk_around_the_ring(spark):
    """Rows enter in ring order, each at the first shard with room clockwise."""
    frame = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    for load in (1.0, 1.2):
        points = sharding.ring(7, 16)
        room = sharding.bounds(500, 7, load)
        hashes = {r[0]: r[1] for r in frame.select("doc_id", F.xxhash64("doc_id", F.lit(0))).collect()}
        arc = lambda at: sum(p <= at for p, _ in points) % len(points)
        want = {}
        for doc, at in sorted(hashes.items(), key=lambda x: (arc(x[1]), x[1], x[0])):
            i = arc(at)
            while not room[points[i % len(points)][1]]:
                i += 1
            want[doc] = points[i % len(points)][1]
            room[want[doc]] -= 1
        got = {r["doc_id"]: r["shard"] for r in dealt(frame, shards=7, nodes=16, load_factor=load)}
        assert got == want


def test_a_further_shard_moves_few_rows(make):
    frame = make([f"t{i}" for i in range(4000)])
    before, after = ({r["doc_id"]: r["shard"] for r in dealt(frame, shards=s, load_factor=1.25)} for s in (10, 11))
    assert sum(before[d] != after[d] for d in before) < 4000 * 0.25


def test_a_hot_row_is_spread(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    counts = Counter(r["shard"] for r in dealt(rows, shards=8))
    assert max(counts.values()) - min(counts.values()) <= 1 and sum(counts.values()) == 30_000


def test_odd_input(odd, empty):
    rows = dealt(odd, shards=5)
    assert len(rows) == odd.count() and max(Counter(r["shard"] for r in rows).values()) == 3
    assert dealt(empty, shards=5) == []
    assert sorted(rows, key=str) == sorted(dealt(odd.repartition(3), shards=5), key=str)
    with pytest.raises(ValueError):
        sharding.shard(odd, ["doc_id"], shards=0)
