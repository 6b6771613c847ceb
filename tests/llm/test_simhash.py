import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from redbuild.llm import graph, simhash


def plain_fingerprint(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(make):
    texts = ["One two THREE four", "a b", "x", "", None, "É é ß x  y\tz", "w " * 500]
    got = {r["doc_id"]: r["fp"] % (1 << 64) for r in simhash.fingerprints(make(texts), 3).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert len(simhash.shingle_hashes("a b c a", 1)) == 4 and len(simhash.shingle_hashes("a b", 2)) == 1


def plain_components(values):
    label = {v: v for v in values}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if bin((a ^ b) % (1 << 64)).count("1") <= 3:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {v: root(v) for v in values}


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(5)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    values = set()
    for _ in range(40):
        v = rng.getrandbits(64)
        for _ in range(rng.randint(1, 30)):  # chains and dense balls
            values.add(signed(v))
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                v ^= 1 << bit
    center = rng.getrandbits(64)  # all in the same bucket
    values |= {signed(center ^ sum(1 << b for b in rng.sample(range(32), k))) for k in (0, 1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4) for _ in range(12)}
    values = sorted(values)
    want = plain_components(values)
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    for hot in (16_384, 5):  # with buckets split, too
        found = {r["node"]: r["label"] for r in graph.components(simhash.links(frame, hot)).collect()}
        assert {v: found.get(v, v) for v in values} == want


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1300)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1300)}


def test_near_copies_and_what_stays(make):
    base = " ".join(f"w{i}" for i in range(400))
    near = base.replace("w200", "changed")
    rows = [(10, base), (4, near), (7, "something else entirely here"), (8, base), (9, None), (11, "  ")]
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(make(rows)).collect()}
    assert bin(simhash.simhash(base, 3) ^ simhash.simhash(near, 3)).count("1") <= 3
    assert found == {10: 4, 4: 4, 8: 4, 7: 7, 9: 9, 11: 9}
    assert {r["doc_id"] for r in simhash.one_of_each(make(rows)).collect()} == {4, 7, 9}


def plain_kept(rows):
    """Of rows (doc_id, text) the (doc_id, text) that stay, comparing all fingerprints."""
    label = plain_components(sorted({simhash.simhash(t, 3) for _, t in rows}))
    best = {}
    for i, t in rows:
        of = label[simhash.simhash(t, 3)]
        row = (i is None, i or 0, t or "")
        best[of] = min(best.get(of, row), row)
    return {(None if lost else i, t) for lost, i, t in best.values()}


def test_one_row_of_each_group_stays(make):
    rng = random.Random(8)
    texts = []
    for i in range(60):
        words = [f"{rng.choice('abcdefgh')}{rng.randint(0, 400)}" for _ in range(150)]
        texts += [" ".join("new" if copy and rng.random() < 0.004 else w for w in words) for copy in range(3)]
    rows = list(enumerate(texts)) + [(None, texts[0]), (None, "only without an id"), (6, "another text of the id"), (500, texts[2])] * 2
    kept = make(rows).withColumn("FP", F.lit(1)).withColumn("rid", F.lit(2))
    got = simhash.one_of_each(kept)
    assert got.columns == kept.columns
    got = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == plain_kept(rows) and len(got) < 130


def test_odd_input(odd, empty):
    found = simhash.near_duplicates(odd)
    assert found.count() == odd.count()
    assert {r["component_id"] for r in found.filter("fp = 0").collect()} == {1}
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert {(r["doc_id"], r["text"] or "") for r in kept.collect()} == {(i, t or "") for i, t in plain_kept(rows)}
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0
    assert np.array_equal(simhash.shingle_hashes(None, 3), [])
    assert odd.filter(F.col("doc_id") == 6).count() == 3
