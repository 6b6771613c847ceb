import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from redbuild.llm import hmm


def small_model(states=3, classes=4, seed=3):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm.Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((classes, states)), 0))


def paths(model, codes):
    """(states, probability) of all latent paths."""
    for z in itertools.product(range(len(model.start)), repeat=len(codes)):
        p = model.start[z[0]] * model.emit[codes[0], z[0]]
        for a, b, c in zip(z, z[1:], codes[1:]):
            p *= model.move[a, b] * model.emit[c, b]
        yield z, p


def test_forward_and_expected_counts_equal_a_sum_over_paths():
    model = small_model()
    sequences = [np.array(s) for s in ([0], [1, 2, 3], [3, 3, 0, 1, 2], [2, 0])]
    got = hmm.forward(model, sequences)
    start, moves, emits = (np.zeros_like(x) for x in (model.start, model.move, model.emit))
    for s, value in zip(sequences, got):
        every = list(paths(model, s))
        total = sum(p for _, p in every)
        assert abs(10**value - total) < 1e-12
        for z, p in every:
            start[z[0]] += p / total
            for a, b in zip(z, z[1:]):
                moves[a, b] += p / total
            for c, a in zip(s, z):
                emits[c, a] += p / total
    for want, found in zip((start, moves, emits), hmm.expected(model, sequences)):
        assert np.allclose(want, found)


def corpus():
    rng = random.Random(0)
    left, right = [f"ab{i}" for i in range(30)], [f"xy{i}" for i in range(30)]
    return [" ".join(rng.choice(left if i % 2 else right) for _ in range(rng.randint(3, 30))) for i in range(300)]


def test_scores(make):
    texts = corpus() + ["unseen words here", None, "", "AB1 ab1"]
    rows = {r["doc_id"]: r for r in hmm.score(make(texts), states=4, rounds=6).collect()}
    tokens = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w] + [None]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))}
    counts = Counter(w for i, t in enumerate(texts) if not held[i] for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[i], len(tokens(t)), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in tokens(t))
        want = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))
        assert abs(r["base_score"] - want) < 1e-6
    out = [i for i in range(300) if held[i]]
    assert sum(rows[i]["score"] for i in out) > sum(rows[i]["base_score"] for i in out) + 10  # it has learned the two sorts


def test_the_tail_joins_to_the_same_scores(make, monkeypatch):
    frame = make(corpus()[:60])
    whole = {r["doc_id"]: r for r in hmm.score(frame, states=2, rounds=2).collect()}
    monkeypatch.setattr(hmm, "HEAD", 20)
    few = {r["doc_id"]: r for r in hmm.score(frame, states=2, rounds=2).collect()}
    for i, r in whole.items():
        assert abs(r["base_score"] - few[i]["base_score"]) < 1e-6 and r["n_known"] == few[i]["n_known"]


def test_probabilities_of_words_sum_to_one(make):
    """One token given a class: all its words and the unknown one."""
    docs = make(corpus())
    vocabulary, table = hmm.count_words(docs)
    words = {r["word"]: r["c"] for r in vocabulary.collect()}
    assert table.tokens == sum(words.values()) + 300 and table.types == len(words) + 1
    share = Counter()
    for w, c in words.items():
        k, _ = table.head[w.encode()]
        if k >= hmm.OWN:
            share[k] += 10 ** (math.log10(c + 0.5) - table.shared[k - hmm.OWN])
    for k, x in share.items():
        assert abs(x + 10 ** (math.log10(0.5) - table.shared[k - hmm.OWN]) - 1) < 1e-9
    assert abs(table.unigram.sum() - 1) < 1e-12


def test_class_in_spark_equals_class_in_python(spark):
    ws = ["a", "ab", "abc", "é", "日本語", "x" * 50, "-"]
    got = {r["w"]: r["k"] for r in spark.createDataFrame([(w,) for w in ws], "w string").select("w", hmm.shared_class_of(F.col("w")).alias("k")).collect()}
    assert got == {w: hmm.shared_class(w.encode()) for w in ws}


def test_odd_input(odd, empty):
    rows = hmm.score(odd, states=2, rounds=1)
    assert rows.count() == odd.count()
    assert rows.filter("score IS NULL OR isnan(score) OR score >= 0").count() == 0
    assert hmm.score(empty).count() == 0


def test_encoded_texts_equal_a_loop_over_the_words():
    import pyarrow as pa

    head = {b"a": (0, 7), b"b": (1, 3), b"ab": (hmm.shared_class(b"ab"), 2)}
    table = hmm.Words(20, 5, 2, head, np.linspace(0.5, 2, hmm.SHARED), np.full(hmm.CLASSES, 1 / hmm.CLASSES))
    texts = ["a B ab zz a", "", None, "zz \u00e9 zz", "ab"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array([False] * 5), pa.array(texts)], ["doc_id", "held_out", "text"])
    shared = type("Shared", (), {"value": table})
    for text, row in zip(texts, next(hmm._encoder(shared)(iter([batch]))).to_pylist()):
        codes, tail, logs, given = [], [], np.log10(2.5), 0.0
        for w in hmm.words(text):
            k, c = head.get(w, (hmm.shared_class(w), None))
            codes.append(k)
            given -= table.shared[k - hmm.OWN] if k >= hmm.OWN else 0
            if c is None:
                tail.append(w.decode())
            else:
                logs += np.log10(c + 0.5)
                given += np.log10(c + 0.5) if k >= hmm.OWN else 0
        assert np.frombuffer(row["codes"], dtype="<u2").tolist() == [*codes, hmm.END] and row["tail"] == tail
        assert (row["n_tokens"], row["known"]) == (len(codes) + 1, len(codes) + 1 - len(tail))
        assert abs(row["logs"] - logs) < 1e-12 and abs(row["given"] - given) < 1e-12
