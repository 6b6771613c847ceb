import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from redbuild.llm import periods, registered


def plain_runs(words, least=6, times=4):
    """(start, length, period) by trying every period at every place."""
    out, n = {}, len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def plain_left(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def planted(rng):
    size = rng.choice([2, 3, 5, 50, 1000])
    words = [rng.randrange(size) for _ in range(rng.randint(0, 300))]
    for _ in range(rng.randint(0, 4)):
        q = rng.randint(1, 60)
        base = [rng.randrange(size) for _ in range(q)]
        if rng.random() < 0.4 and q > 3:  # a period that is nearly periodic itself
            base = (base[:q // 3] * 4)[:q]
        at = rng.randint(0, len(words))
        words[at:at] = (base * 9)[:rng.randint(q, q * 9)]
    return [str(w).encode() for w in words]


def test_many_texts_at_once_against_brute_force():
    rng = random.Random(1)
    texts = [planted(rng) for _ in range(250)]
    found = periods._searched(texts, 6, 4)
    assert sum(len(runs) for runs, _ in found) > 300
    for words, (runs, left) in zip(texts, found):
        assert runs == plain_runs(words)
        assert left == plain_left(words, runs)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b"]), max_size=70), min_size=1, max_size=4))
def test_short_alphabets(texts):
    assert [runs for runs, _ in periods._searched(texts, 6, 4)] == [plain_runs(t) for t in texts]


def test_runs_of_more_periods_and_the_least():
    words = [b"x"] * 6 + [b"a", b"b"] * 5 + [b"c"]
    assert periods._searched([words], 6, 6)[0][0] == plain_runs(words, 6, 6)
    assert periods._searched([words], 12, 4)[0][0] == plain_runs(words, 12, 4)
    with pytest.raises(ValueError):
        periods.runs_in(np.arange(9), np.array([8]), times=3)


def test_places_depend_on_what_follows_and_are_dense():
    rng = np.random.default_rng(3)
    block = rng.integers(0, 4, 200)
    w = np.concatenate([rng.integers(0, 4, 77), block, rng.integers(0, 4, 90), block])
    t = 8
    h = periods._mixed(w.astype(np.uint64))
    for step in (1, 2, 4):
        h = periods._twice(h, step)
    places = set(periods.synchronising(h, t, np.zeros(len(h), dtype=bool)).tolist())
    first, second = 77, 77 + 200 + 90
    for i in range(200 - 2 * t):
        assert (first + i in places) == (second + i in places)
    assert all(any(i + k in places for k in range(t)) for i in range(len(w) - 3 * t))
    assert len(places) < len(w) / 2


def test_long_text_and_long_periods():
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}".encode() for _ in range(4_000)]
    words = [b"head"] * 3 + base * 4 + [b"tail"]
    (runs, left), = periods._searched([words], 6, 4)
    assert (3, 16_000, 4_000) in runs and left.startswith(b"head head head ") and left.endswith(b" tail")


def test_loops_are_planted_as_stated(spark, make):
    texts = [" ".join(f"w{(i * j) % 37}" for j in range(i % 90)) for i in range(400)]
    docs = make(texts)
    got = {r["doc_id"]: r["t"] for r in docs.select("doc_id", periods.with_loops(docs["text"], docs["doc_id"]).alias("t")).collect()}
    changed = 0
    for i, text in enumerate(texts):
        words, h = text.split(), zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(words[:a] + [words[a + (j - a) % p] for j in range(a, n)])
            changed += 1
        assert got[i] == text
    assert changed > 20


def test_query_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["doc_id"]: r["t"] for r in docs.select("doc_id", periods.with_loops(docs["text"], docs["doc_id"]).alias("t")).collect()}
    rows = registered.op11_periods(spark, small).collect()
    assert len(rows) == len(texts)
    some = 0
    for r in rows:
        words = (texts[r["doc_id"]] or "").encode().split()
        runs = plain_runs(words)
        assert r["n_runs"] == len(runs)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(plain_left(words, runs)).hexdigest()
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r["start"], r["length"], r["period"]) == (best or (None, None, None))
        assert r["exponent_milli"] == (best and 1000 * best[1] // best[2])
        some += bool(runs)
    assert some > 10


def test_odd_input(odd, empty):
    rows = periods.periodic_runs(odd).collect()
    assert len(rows) == odd.count()
    by_text = {r["collapsed"]: r for r in rows}
    assert by_text[""]["n_words"] == 0 and by_text["aa"]["runs"] == [(0, 2000, 1)]
    assert periods.periodic_runs(empty).count() == 0
    texts = odd.select("doc_id", periods.with_loops(odd["text"], odd["doc_id"]).alias("t"))
    assert texts.filter("doc_id IS NULL AND t IS NOT NULL").head()["t"] == "a text without an id"
