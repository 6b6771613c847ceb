import random

import numpy as np
from pyspark.sql import functions as F

from redbuild.llm import cotrain


def corpus(spark, make, n=900):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        words = [word() for _ in range(rng.randint(5, 120))]
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" if i % 8 else w + "***" for w in words)
        rows.append((i, text, f"s{i % 5}" if good or i // 4 % 2 else "spam"))
        if i % 3 == 0:
            labels.append((i, int(good), 0))
    return make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_unlabelled_documents_are_judged_right(spark, make):
    docs, labels = corpus(spark, make)
    model = cotrain.train(docs, labels)
    rows = cotrain.score(docs, model).collect()
    right = [(r["good_odds"] >= 0) == (r["doc_id"] % 4 != 0) for r in rows]
    assert sum(right) / len(right) > 0.98
    kept = {r["doc_id"] for r in cotrain.keep_good(docs, labels).collect()}
    clean = {i for i in range(900) if i % 4}
    assert len(clean & kept) / len(clean) > 0.99


def test_views_teach_each_other():
    """With few labels, what one view is sure of makes the other better."""
    rng = np.random.default_rng(0)
    y = rng.random(3000) < 0.5
    text = y[:, None] * 3.0 + rng.normal(size=(3000, 2))
    meta = y[:, None] * 2.5 + rng.normal(size=(3000, 3))
    few = np.arange(40)
    one = cotrain.co_train(text[few], meta[few], y[few].astype(float), text[40:2000], meta[40:2000], rounds=0)
    many = cotrain.co_train(text[few], meta[few], y[few].astype(float), text[40:2000], meta[40:2000], rounds=8)
    accuracy = lambda m: ((m.odds(text[2000:], meta[2000:]) > 0) == y[2000:]).mean()
    assert accuracy(many) > 0.95 and accuracy(many) >= accuracy(one) - 0.005
    odds = many.text.odds(text[2000:])
    sure = np.abs(odds) > 2
    assert abs((cotrain.sigmoid(odds[sure]) - y[2000:][sure]).mean()) < 0.1  # calibrated


def test_odd_input(spark, odd, empty, make):
    docs, labels = corpus(spark, make, 300)
    model = cotrain.train(docs, labels)
    rows = cotrain.score(odd, model)
    assert rows.count() == odd.count() and rows.filter("good_odds IS NULL OR isnan(good_odds)").count() == 0
    assert set(odd.columns) <= set(rows.columns)
    assert cotrain.keep_good(odd, labels).columns == odd.columns
    assert cotrain.score(empty, model).count() == 0 and cotrain.keep_good(empty, labels).count() == 0
    none = labels.limit(0)
    assert cotrain.train(docs, none) is None
    assert cotrain.keep_good(docs, none).count() == docs.count()
    nulls = labels.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("quality"))
    assert cotrain.train(docs, nulls) is None
    assert cotrain.score(docs.drop("source", "n_chars"), model).count() == 300
