"""Quality classifier by co-training of two views of a document.

One classifier sees the text's content, the other the metadata of its page
(source, language, length as stated).  Round by round each gives the other its
most confident labels for documents that have none; at the end both are
calibrated on labelled documents that neither was trained on, and their odds
are combined to score every document.

The fit uses a bounded sample (LABELLED and UNLABELLED rows, chosen by a hash
of the id); scoring covers all rows and all of each text, with no shuffle.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import small_batches

LABELLED = 8_000  # labelled rows that the fit uses
UNLABELLED = 8_000  # rows without labels that get pseudo-labels
ROUNDS = 8
PER_ROUND = 0.05  # of the pool, for each class by its share
SURE = 0.95  # a pseudo-label's least calibrated probability
SOURCES, LANGS = 64, 16  # hashed
META = ["source", "lang", "n_chars"]
SYMBOLS = np.frombuffer(b"#$%&*+/<=>@[\\]^_`{|}~", dtype=np.uint8)


def text_features(text: str | None) -> list[float]:
    """Shares and lengths of what the text is made of; all 0 for a text without words."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * 17
    n, w = len(data), len(words)
    seen = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    letters = seen[65:91].sum() + seen[97:123].sum() + seen[192:].sum()
    lines = [x for x in data.split(b"\n") if x.strip()]
    p = seen[seen > 0] / n
    pairs = sum(a == b for a, b in zip(words, words[1:]))
    return [
        1.0, math.log1p(w), n / w, seen[65:91].sum() / n, seen[48:58].sum() / n, seen[33] / w, (seen[46] + seen[44]) / w,
        seen[SYMBOLS].sum() / n, seen[124] / w, letters / n, len(set(words)) / w, len(set(lines)) / len(lines),
        math.log1p(w / len(lines)), pairs / w, seen[128:].sum() / n, float(-(p * np.log2(p)).sum()), math.log1p(max(map(len, words))),
    ]


def meta_features(source, lang, n_chars) -> np.ndarray:
    """Hashed source and language, and the stated length; nulls have places of their own."""
    out = np.zeros(SOURCES + LANGS + 3)
    out[0 if source is None else 1 + zlib.crc32(str(source).encode()) % (SOURCES - 1)] = 1
    out[SOURCES + (0 if lang is None else 1 + zlib.crc32(str(lang).encode()) % (LANGS - 1))] = 1
    if n_chars is None:
        out[-3] = 1
    else:
        out[-2] = size = math.log1p(max(0, n_chars))
        out[-1] = size * size / 10
    return out


@dataclass
class Linear:
    """Logistic regression on standardised features and their squares, with a calibrated line on top."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.ones(len(z)), z, z * z / 4]) @ self.weights

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Calibrated log odds."""
        return np.clip(self.slope * self.raw(x) + self.shift, -30, 30)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def newton(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 15) -> np.ndarray:
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray) -> Linear:
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.clip((x - mean) / scale, -8, 8)
    return Linear(mean, scale, newton(np.column_stack([np.ones(len(z)), z, z * z / 4]), y, 1.0))


def calibrate(model: Linear, x: np.ndarray, y: np.ndarray) -> Linear:
    """Platt's line, on rows that the model was not trained on."""
    hits = y.sum()
    goal = np.where(y > 0, (hits + 1) / (hits + 2), 1 / (len(y) - hits + 2))
    model.shift, model.slope = newton(np.column_stack([np.ones(len(x)), model.raw(x)]), goal, 1e-3)
    model.slope = max(model.slope, 0.0)
    return model


@dataclass
class CoTrained:
    text: Linear
    meta: Linear
    prior: float  # log odds of a good document
    shares: np.ndarray  # constant, and how much each view's odds count

    def together(self, text_odds: np.ndarray, meta_odds: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(text_odds)), text_odds, meta_odds]) @ self.shares

    def odds(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return self.together(self.text.odds(text), self.meta.odds(meta))


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, rounds: int = ROUNDS) -> CoTrained:
    """y: 1 good, 0 bad.  Every fourth labelled row of either kind is for calibration only."""
    check = np.where(y > 0, np.cumsum(y > 0), np.cumsum(y <= 0)) % 4 == 2
    views, pools = (text, meta), (pool_text, pool_meta)
    share = float(np.clip(y.mean(), 0.01, 0.99))
    # What each view is trained on: labelled rows and what the other has labelled.
    xs, ys = [[v[~check]] for v in views], [[y[~check]] for _ in views]
    open_ = np.ones(len(pool_text), dtype=bool)
    models: list[Linear] = []
    for turn in range(rounds + 1):
        models = [calibrate(fit(np.concatenate(xs[v]), np.concatenate(ys[v])), views[v][check], y[check]) for v in (0, 1)]
        if turn == rounds or not open_.any():
            break
        taken = np.zeros(len(pool_text), dtype=bool)
        for v in (0, 1):
            p = sigmoid(models[v].odds(pools[v]))
            for label, sure, part in ((1.0, p, share), (0.0, 1 - p, 1 - share)):
                most = math.ceil(PER_ROUND * len(p) * part)
                best = np.argsort(-np.where(open_, sure, -1), kind="stable")[:most]
                best = best[open_[best] & (sure[best] >= SURE)]
                xs[1 - v].append(pools[1 - v][best])
                ys[1 - v].append(np.full(len(best), label))
                taken[best] = True
        if not taken.any():
            break
        open_ &= ~taken
    # How far the views may be added up is seen on the rows for calibration, too.
    odds = [np.clip(m.odds(v[check]), -8, 8) for m, v in zip(models, views)]
    shares = newton(np.column_stack([np.ones(check.sum()), *odds]), y[check], 0.1)
    shares[1:] = np.maximum(shares[1:], 0.0)
    return CoTrained(*models, math.log(share / (1 - share)), shares)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [text_features(t) for t in batch.column("text").to_pylist()]
        meta = [meta_features(*m).tolist() for m in zip(*(batch.column(c).to_pylist() for c in META))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("h"), batch.column("quality"), pa.array(text, pa.list_(pa.float64())), pa.array(meta, pa.list_(pa.float64()))],
            ["h", "quality", "text", "meta"],
        )


def _complete(docs: DataFrame) -> DataFrame:
    """docs with all metadata columns."""
    kinds = {"source": "string", "lang": "string", "n_chars": "long"}
    return docs.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in META if c not in docs.columns])


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED, rounds: int = ROUNDS) -> CoTrained | None:
    """None if there are no labels of both kinds.  A document labelled twice counts as bad if one label says so."""
    small_batches(docs.sparkSession)
    marks = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    all_marks, all_docs = marks.count(), docs.count()
    h = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30))
    cut = lambda most, n: (1 << 30) if n <= most else int((1 << 30) * most / n)
    rows = _complete(docs).filter("doc_id IS NOT NULL").select("doc_id", "text", *META, h.alias("h"))
    some = marks.filter(h < cut(labelled, all_marks))  # about `labelled` rows
    known = rows.filter(F.col("h") < cut(labelled, all_marks)).join(some, "doc_id").select("h", "quality", "text", *META)
    # Rows of the pool are few before the join, so that what has a label can be told cheaply.
    pool = rows.filter(F.col("h") < cut(unlabelled, max(1, all_docs - all_marks))).join(marks, "doc_id", "left_anti").select("h", F.lit(None).cast("int").alias("quality"), "text", *META)
    shape = "h long, quality int, text array<double>, meta array<double>"
    found = sorted(known.unionByName(pool).mapInArrow(_features, shape).collect(), key=lambda r: (r["h"], r["text"]))
    with_label = [r for r in found if r["quality"] is not None]
    without = [r for r in found if r["quality"] is None]
    y = np.array([float(r["quality"] > 0) for r in with_label])
    if len(y) < 8 or y.min() == y.max():
        return None
    array = lambda rows, c, width: np.array([r[c] for r in rows], dtype=float).reshape(-1, width)
    wide = (len(text_features(None)), SOURCES + LANGS + 3)
    return co_train(*(array(with_label, c, w) for c, w in zip(("text", "meta"), wide)), y, *(array(without, c, w) for c, w in zip(("text", "meta"), wide)), rounds)


def score(docs: DataFrame, model: CoTrained | None, names: tuple[str, str, str] = ("good_odds", "text_odds", "meta_odds")) -> DataFrame:
    """docs with the columns of `names`: the document's, the text's and the metadata's odds (calibrated log odds of a good document; columns of these names are
    replaced).

    Metadata that docs lacks counts as null.  Texts without words (null, empty) are judged by their metadata alone.
    Without a model all odds are 0.  Equal rows score alike.  An empty table gives no rows.
    """
    docs = docs.drop(*names)
    if model is None:
        return docs.select("*", *[F.lit(0.0).alias(c) for c in names])
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            columns = [batch.column(c).to_pylist() if c in batch.schema.names else [None] * batch.num_rows for c in ["text", *META]]
            text = np.array([text_features(t) for t in columns[0]]).reshape(batch.num_rows, -1)
            meta = np.array([meta_features(*x) for x in zip(*columns[1:])]).reshape(batch.num_rows, -1)
            own = m.text.odds(text) if len(text) else np.zeros(0)
            own = np.where(text[:, 0] > 0, own, m.prior) if len(text) else own
            page = m.meta.odds(meta) if len(meta) else np.zeros(0)
            made = [m.together(own, page), own, page]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.float64()) for x in made)], [*batch.schema.names, *names])

    shape = StructType([*docs.schema.fields, *(StructField(name, DoubleType()) for name in names)])
    return docs.mapInArrow(run, shape)


def keep_good(docs: DataFrame, labels: DataFrame, least_odds: float = 0.0) -> DataFrame:
    """docs that are more likely good than bad (log odds of at least least_odds); all columns are kept."""
    scored = score(docs, train(docs, labels), ("_odds_", "_text_odds_", "_meta_odds_"))
    return scored.filter(F.col("_odds_") >= least_odds).select(*docs.columns)
