import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from redbuild.llm import registered, resample

LOWER = {i: i + 32 for i in range(65, 91)}


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_buckets(text, buckets=10_000):
    words = plain_words(text)
    return [zlib.crc32(" ".join(words[i:i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain(docs, target, percent=5, least=20):
    """[(doc_id, n_features, weight, score, rank)] for (doc_id, text) rows and target texts."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(plain_buckets(text))
    for text in target:
        t.update(plain_buckets(text))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in range(10_000)}
    rows = []
    for i, text in docs:
        own = plain_buckets(text)
        weight = sum(gain[b] for b in own)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(own), weight, score, len(plain_words(text))))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0]))
    rank = {r[0]: k for k, r in enumerate(fit[:len(fit) * percent // 100], 1)}
    return sorted((*r[:4], rank.get(r[0])) for r in rows)


def test_query_against_brute_force(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = sorted(tuple(r) for r in registered.op13_resampling(spark, small).collect())
    want = plain(docs, target)
    assert got == want and any(r[4] for r in got)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=1, max_size=300).map(lambda b: b.replace(b" ", b"_")), max_size=8), max_size=4))
def test_crcs_by_cancellation(parts):
    for n, (part, last, crc) in enumerate(resample.run_crcs(parts), 1):
        want = [(p, j, zlib.crc32(b" ".join(parts[p][j - n + 1:j + 1]))) for p in range(len(parts)) for j in range(n - 1, len(parts[p]))]
        assert list(zip(part.tolist(), last.tolist(), crc.tolist())) == want


def test_moves_over_any_length():
    lengths = np.array([0, 1, 2, 127, 128, 129, 255, 256, 5_000, 123_457])
    crc = np.full(len(lengths), zlib.crc32(b"front"), dtype=np.uint32)
    for n, got in zip(lengths.tolist(), resample.moved(crc, lengths).tolist()):
        tail = bytes(n)
        assert got ^ zlib.crc32(tail) == zlib.crc32(b"front" + tail)


def test_long_texts_come_in_parts(monkeypatch):
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(50)}" for _ in range(3_000))
    texts = [text, None, "", "one", text[:500]]
    whole = Counter((int(r), int(b)) for rows, bucket in resample._features(texts, 10_000) for r, b in zip(rows, bucket))
    for piece, at_once in ((64, 100), (1, 10), (1 << 20, 7)):
        monkeypatch.setattr(resample, "PIECE", piece)
        monkeypatch.setattr(resample, "AT_ONCE", at_once)
        parts = Counter((int(r), int(b)) for rows, bucket in resample._features(texts, 10_000) for r, b in zip(rows, bucket))
        assert parts == whole
    assert whole == Counter((i, b) for i, t in enumerate(texts) for b in plain_buckets(t))


def test_ties_and_repeated_rows(spark, make):
    texts = [(i % 40, " ".join(["same"] * 25)) for i in range(400)] + [(500, "too short")]
    rows = resample.weighed(make(texts), make(["same thing"]))
    got = resample.draw(rows, percent=10).collect()
    assert len(got) == 401
    drawn = sorted((r["rank"], -r["score"], r["doc_id"]) for r in got if r["rank"])
    assert [r[0] for r in drawn] == list(range(1, 41)) and [r[1:] for r in drawn] == sorted(r[1:] for r in drawn)
    best = sorted((-r["score"], r["doc_id"]) for r in got if r["n_words"] >= 20)[:40]
    assert best == [r[1:] for r in drawn]


def test_resampled_rows_look_like_the_target(spark, make):
    rng = random.Random(6)
    word = lambda kind: f"{kind}{rng.randrange(30)}"
    docs = make([(i, " ".join(word("abcd"[i % 4]) for _ in range(30))) for i in range(400)])
    target = make([" ".join(word("b") for _ in range(50)) for _ in range(10)])
    got = resample.resampled(docs, target, percent=20)
    assert got.columns == docs.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert len(ids) == 80 and all(i % 4 == 1 for i in ids)


def test_odd_input(odd, empty, make):
    target = make(["the end", None, ""])
    names = ("w0", "f0", "g0")
    rows = resample.weighed(odd, target, names=names)
    assert rows.count() == odd.count()
    assert rows.filter("text IS NULL AND (w0 != 0 OR f0 != 0 OR g0 != 0)").count() == 0
    kept = resample.resampled(odd, target, percent=100, least_words=2)
    assert kept.columns == odd.columns
    assert kept.count() == rows.filter("w0 >= 2").count()
    for docs, wanted in ((empty, target), (odd, target.limit(0)), (empty, empty)):
        light = resample.weighed(docs.select("doc_id", "text"), wanted)
        assert resample.draw(light).count() == docs.count()
    one = resample.draw(resample.weighed(odd.select("doc_id", "text"), target)).filter(F.col("doc_id").isNull())
    assert one.filter("score IS NULL").count() == 0
