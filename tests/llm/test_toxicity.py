import random
import zlib

import numpy as np

from redbuild.llm import registered, toxicity


def corpus(n=700, seed=5):
    """(words, label): in some, a few words have a bad beginning, or are bad words whole."""
    rng = random.Random(seed)
    stem = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 8)))
    out = []
    for i in range(n):
        bad = i % 4 == 0
        words = [stem() for _ in range(rng.choice([3, 20, 60, 200]))]
        if bad:
            for _ in range(max(1, len(words) // 40)):
                words[rng.randrange(len(words))] = "zork" + stem() if i % 8 else "vile"
        out.append((" ".join(words), int(bad)))
    return out


def test_gradients_against_differences():
    rng = np.random.default_rng(2)
    net = toxicity.fresh(rng)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    vocabulary = toxicity.features([b"one", b"two", b"a", b"longerword", "é".encode()])
    place = rng.integers(0, 5, (6, toxicity.WINDOW))
    there = (np.arange(toxicity.WINDOW) < rng.integers(1, toxicity.WINDOW + 1, 6)[:, None]).astype(float)
    label = np.array([1, 0, 1, 1, 0, 0.0])
    # Single precision in the states' buffers bounds how close the two may come.
    _, g = toxicity.gradients(net, vocabulary, place, there, label)
    for name, w in net.weights.items():
        rows = {"word": vocabulary[0], "char": vocabulary[1]}.get(name)
        for _ in range(6):
            at = tuple(int(rng.integers(0, s)) for s in w.shape)
            if rows is not None:
                at = (int(rng.choice(rows)), at[1])
            was, size = w[at], 1e-2
            w[at] = was + size
            up = toxicity.gradients(net, vocabulary, place, there, label)[0]
            w[at] = was - size
            down = toxicity.gradients(net, vocabulary, place, there, label)[0]
            w[at] = was
            assert abs((up - down) / (2 * size) - g[name][at]) < 2e-4 + 0.02 * abs(g[name][at]), name


def test_windows_cover_all_words():
    for n in range(0, 200):
        own = toxicity.windows(n)
        assert sorted({w for a in own for w in range(a, min(n, a + toxicity.WINDOW))}) == list(range(n))
        assert all(b - a <= toxicity.STRIDE for a, b in zip(own, own[1:])) and len(set(own)) == len(own)


def test_held_out_documents(spark, make):
    rows = corpus()
    docs = make([t for t, _ in rows])
    known = [(i, y) for i, (_, y) in enumerate(rows) if i % 3]
    net = toxicity.train(docs, spark.createDataFrame(known, "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, net).collect()}
    held = [(got[i]["score"], y) for i, (_, y) in enumerate(rows) if i % 3 == 0]
    assert np.mean([(s >= 0.5) == bool(y) for s, y in held]) > 0.95
    assert all(0 <= s <= 1 for s, _ in held)
    hits = [i for i, (_, y) in enumerate(rows) if y and got[i]["score"] > 0.7]
    words = {i: rows[i][0].split()[got[i]["worst_start"]:got[i]["worst_end"]] for i in hits}
    assert np.mean([any(w.startswith("zork") or w == "vile" for w in words[i]) for i in hits]) > 0.95
    again = toxicity.train(docs, spark.createDataFrame(known[::-1], "doc_id long, toxic int"))
    assert all(np.array_equal(net.weights[k], again.weights[k]) for k in net.weights)


def test_batches_do_not_matter(spark, make, monkeypatch):
    rows = corpus(60)
    net = toxicity.fit([toxicity.words(t) for t, _ in rows], np.array([y for _, y in rows], dtype=np.float32), rounds=1)
    known = toxicity._Words(net)
    own = [toxicity.words(t) for t, _ in rows]
    alone = [np.sort(toxicity.numbers_of(net, net.inputs(*toxicity.features(w))[1], *toxicity.gathered([np.arange(len(w))])[:2])) for w in own]
    place, there, text, _ = toxicity.gathered(known.of(own))
    raw = toxicity.numbers_of(net, known.gates, place, there)
    for i, want in enumerate(alone):
        assert np.allclose(np.sort(raw[text == i]), want, atol=1e-4)


def test_query_on_held_out_rows(spark, small):
    folder = small.replace("sf0.001", "sf0.1")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = registered.op12_toxicity(spark, folder).collect()
    assert len(rows) == 10_000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    clean = [p for p, y in held if not y]
    toxic = [p for p, y in held if y]
    assert 1 - np.mean(clean) > 0.98 and np.mean(toxic) > 0.8


def test_odd_input(spark, odd, empty, make):
    rows = corpus(200)
    docs, labels = make([t for t, _ in rows]), spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    net = toxicity.train(docs, labels, rounds=1)
    got = toxicity.score(odd, net)
    assert got.count() == odd.count() and got.filter("score IS NULL OR isnan(score) OR score < 0 OR score > 1").count() == 0
    none = got.filter("doc_id <= 3").collect()
    assert len({r["score"] for r in none}) == 1 and all(r["n_windows"] == 0 and r["worst_start"] is None for r in none)
    assert toxicity.score(empty, net).count() == 0
    assert toxicity.train(docs, labels.limit(0)) is None and toxicity.train(empty, labels) is None
    assert toxicity.train(docs, labels.filter("toxic = 1")) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}
    # One id with most of the rows, labelled twice, and null labels.
    many = make([(7, f"{t} {i}") for i, (t, _) in enumerate(rows)] + [(8, "vile zorkabc"), (9, "fine words")])
    odd_labels = spark.createDataFrame([(7, 0), (7, 0), (8, 0), (8, 1), (9, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.train(many, odd_labels, toxic=20, clean=20, rounds=1) is not None
