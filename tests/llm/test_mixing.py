from collections import defaultdict

from pyspark.sql import functions as F

from redbuild.llm import mixing


def plain_targets(sizes, weights, share, most):
    """Water levels by a loop: excess is shared again by weight until no target is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total >= most * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    total = sum(w[s] for s in open_)
    return target | {s: left * w[s] / total for s in open_}


def mixed(frame, **options):
    return mixing.spread_copies(mixing.mix(frame, ["doc_id"], **options)).collect()


def test_targets_and_taken_words(spark):
    frame = spark.range(6000).select(
        F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(90)) + 10).alias("size"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("s"), (F.col("id") % 11).cast("string"))).alias("source"),
    )
    rows = mixed(frame)
    assert len(rows) == 6000 and {r["copies"] for r in rows} <= {0, 1, 2}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        assert r["source_size"] > 0
    want = plain_targets(dict(sizes), (3, 1, 2), 1.5, 2.0)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * want[s] + 1e-6
        assert abs(taken[s] - target[s]) <= 50  # half of the largest document
    assert sorted(rows) == sorted(mixed(frame.repartition(5)))  # the draw follows the rows alone


def test_expectations_stay(spark):
    """Over many seeds a document is taken as often as its share says."""
    frame = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 5 + 1).alias("size"), F.lit("a").alias("source"))
    items = frame.select("source", F.col("doc_id").alias("id"), F.xxhash64("doc_id").alias("h"), F.col("size").cast("double").alias("s"), F.lit(0.3).alias("x"))
    total = defaultdict(int)
    for seed in range(12):
        ups = mixing.round_fractions(items, "source", seed).collect()
        assert len(ups) == 40
        assert abs(sum(r["up"] * (r["id"] % 5 + 1) for r in ups) - 0.3 * 120) <= 2.5
        for r in ups:
            total[r["id"]] += r["up"]
    assert 0.2 < sum(total.values()) / 480 < 0.4 and max(total.values()) < 12


def test_repeated_rows_share_their_copies(make):
    frame = make([(1, "a b c", "x")] * 300 + [(i, "a b c", "y") for i in range(300, 600)])
    rows = mixed(frame.withColumn("size", mixing.word_count(F.col("text"))), weights=(1,), share=1.3)
    assert len(rows) == 600
    for source in "xy":
        assert abs(sum(r["copies"] * 3 for r in rows if r["source"] == source) - 1.3 * 900) <= 3


def test_documents_come_as_often_as_taken(make):
    frame = make([(i, "w " * (i % 9 + 1), f"s{i % 3}") for i in range(200)]).withColumn("copies", F.lit("mine"))
    rows = mixing.mixed_documents(frame).collect()
    assert set(rows[0].asDict()) == set(frame.columns) and all(r["copies"] == "mine" for r in rows)
    words = sum(r["text"].count("w") for r in rows)
    assert abs(words - 1.5 * sum(i % 9 + 1 for i in range(200))) < 15


def test_odd_input(odd, empty):
    rows = mixed(odd.withColumn("size", mixing.word_count(F.col("text"))))
    assert len(rows) == odd.count()
    assert mixed(empty.withColumn("size", F.lit(1))) == []
    assert mixing.mixed_documents(odd).columns == odd.columns and mixing.mixed_documents(odd).count() > 0
    assert mixing.mixed_documents(empty).count() == 0
