"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as the vector of its hash beside the scaled sum of vectors of its
character n-grams (those of three characters, and longer ones from its start).
Two gated recurrent layers read a window of words from either end, attention
weighs their states, and one number comes out.  A text is read in overlapping
windows, all of them, and judged by its worst and by how toxic they are on
average.

The network is trained here, in NumPy, on a bounded sample of labelled
documents.  Only whole documents have labels, so in each round the current
network names each document's worst window; those of toxic documents count as
toxic, the worst and one drawn window of each clean document as clean.  The
vectors' first component starts from the feature's log odds among the training
documents.  Every fifth document is kept from training and sets how the
worst and the average make a probability.

Scoring needs no shuffle.  A task computes a word's vectors once, however often
the word stands in its texts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count, islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

TOXIC, CLEAN = 1_200, 2_400  # labelled documents of either kind that the fit uses, about
SAMPLE_WORDS = 4_096  # of a longer document, the fit sees so many words in windows spread over it
ROUNDS, BATCH, RATE = 8,64,0.03
WINDOW, STRIDE = 32, 24
ROWS = 1 << 14  # of either table of vectors
WORD_SIZE, CHAR_SIZE, STATE, ATTENTION = 8, 8, 8, 8
GRAMS = (3, 4, 5, 6, 7)  # characters, with one that marks the start and one that marks the end; but 3, from the start only
KNOWN = 200_000  # words whose vectors a task keeps
AT_ONCE = 512  # windows
#: A space for ASCII other than digits and letters.
PLAIN = bytes(c if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(PLAIN).split()


# --- what a word is made of -----------------------------------------------------------


def features(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word row, character rows one after the other, where each word's begin) of words."""
    own = np.fromiter(map(crc32, vocabulary), dtype=np.int64, count=len(vocabulary)) % ROWS
    text = np.frombuffer(b"\x01" + b"\x02\x01".join(vocabulary) + b"\x02", dtype=np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, vocabulary), dtype=np.int64, count=len(vocabulary)) + 2
    starts = np.cumsum(lengths) - lengths
    word, rows = [], []
    for n in GRAMS:
        if n == GRAMS[0]:
            of = np.repeat(np.arange(len(vocabulary)), lengths - n + 1)
            at = np.arange(len(of)) + (n - 1) * of
        else:
            of = np.flatnonzero(lengths >= n)
            at = starts[of]
        h = np.full(len(at), 2166136261 + n, dtype=np.uint32)
        for k in range(n):
            h = (h ^ text[at + k]) * np.uint32(16777619)
        word.append(of)
        rows.append((h ^ h >> np.uint32(15)).astype(np.int64) % ROWS)
    word, rows = np.concatenate(word), np.concatenate(rows)
    order = np.argsort(word, kind="stable")
    return own, rows[order], np.searchsorted(word[order], np.arange(len(vocabulary) + 1))


def windows(n: int) -> list[int]:
    """Where the windows of a text of n words begin: every word is in one, all but those at the ends in two."""
    return [*range(0, max(1, n - WINDOW), STRIDE), n - WINDOW] if n > WINDOW else [0] * (n > 0)


# --- the network ------------------------------------------------------------------------


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Network:
    """Weights by name; the two directions' gates stand side by side in `inp`, each in the order update, reset, new."""

    weights: dict[str, np.ndarray]
    line: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0, 0.0]))  # of the worst number, the mean chance, and 1
    prior: float = 0.0  # log odds of a toxic document

    def inputs(self, own: np.ndarray, chars: np.ndarray, ptr: np.ndarray, kept: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, what the gates get from them) of words; `kept` scales the vectors of whole words."""
        w = self.weights
        scale = 1 / np.sqrt(np.diff(ptr)).astype(np.float32)
        x = np.concatenate([w["word"][own] * kept, np.add.reduceat(w["char"][chars], ptr[:-1], axis=0) * scale[:, None]], axis=1)
        return x, x @ w["inp"] + w["bias"]

    def states(self, p: np.ndarray, there: np.ndarray, back: bool, tape: list | None = None) -> np.ndarray:
        """States of one direction for p (windows, places, gates); `there` tells words from padding."""
        u, n = self.weights["back" if back else "fore"], STATE
        h = np.zeros((len(p), n), dtype=np.float32)
        out = np.empty((*there.shape, n), dtype=np.float32)
        for t in range(there.shape[1])[::-1 if back else 1]:
            x, a = p[:, t], h @ u
            gates = sigmoid(x[:, :2 * n] + a[:, :2 * n])
            z, r = gates[:, :n], gates[:, n:]
            c = np.tanh(x[:, 2 * n:] + r * a[:, 2 * n:])
            m = there[:, t, None]
            new = h + m * z * (c - h)
            if tape is not None:
                tape.append((t, h, a[:, 2 * n:], z, r, c, m))
            out[:, t] = h = new
        return out

    def forward(self, p: np.ndarray, there: np.ndarray, tapes: tuple[list, list] | None = None):
        """(number, parts) of windows."""
        w, n = self.weights, 3 * STATE
        both = [self.states(p[..., d * n:(d + 1) * n], there, bool(d), tapes[d] if tapes else None) for d in (0, 1)]
        h = np.concatenate(both, axis=2)
        u = np.tanh(h @ w["look"])
        e = u @ w["see"] - 1e9 * (1 - there)
        e = np.exp(e - e.max(axis=1, keepdims=True))
        alpha = e / e.sum(axis=1, keepdims=True)
        pooled = np.matmul(alpha[:, None, :], h)[:, 0]
        return pooled @ w["out"] + w["base"][0], (h, u, alpha, pooled)

    def judged(self, raw: np.ndarray, text: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """(worst window or -1, log odds) of texts from the numbers of their windows."""
        top, many = worst(raw, text, count), np.bincount(text, minlength=count)
        mean = np.bincount(text, weights=sigmoid(raw), minlength=count) / np.maximum(1, many)
        odds = np.column_stack([raw[top] if len(raw) else np.zeros(count), mean, np.ones(count)]) @ self.line
        return top, np.where(top >= 0, odds, self.prior)


def fresh(rng: np.random.Generator) -> Network:
    size, both = WORD_SIZE + CHAR_SIZE, 2 * STATE
    def some(*shape, by):
        return (rng.normal(size=shape) * by).astype(np.float32)
    return Network({
        "word": some(ROWS, WORD_SIZE, by=0.1), "char": some(ROWS, CHAR_SIZE, by=0.1), "inp": some(size, 6 * STATE, by=size ** -0.5),
        "bias": np.zeros(6 * STATE, dtype=np.float32), "fore": some(STATE, 3 * STATE, by=STATE ** -0.5), "back": some(STATE, 3 * STATE, by=STATE ** -0.5),
        "look": some(both, ATTENTION, by=both ** -0.5), "see": some(ATTENTION, by=ATTENTION ** -0.5), "out": some(both, by=both ** -0.5),
        "base": np.zeros(1, dtype=np.float32),
    })


def gradients(net: Network, vocabulary, place: np.ndarray, there: np.ndarray, label: np.ndarray, kept: np.ndarray | float = 1.0) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy of windows and its gradient.  vocabulary: features() of the words; place: numbers of words."""
    w, n = net.weights, 3 * STATE
    own, chars, ptr = vocabulary
    x, gates = net.inputs(own, chars, ptr, kept)
    tapes: tuple[list, list] = ([], [])
    raw, (h, u, alpha, pooled) = net.forward(gates[place], there, tapes)
    loss = float(np.mean(np.logaddexp(0, raw) - label * raw))
    g = {k: np.zeros_like(v) for k, v in w.items()}
    d = ((sigmoid(raw) - label) / len(label)).astype(np.float32)
    g["out"], g["base"] = pooled.T @ d, np.array([d.sum()], dtype=np.float32)
    d_pooled = d[:, None] * w["out"]
    d_h = alpha[..., None] * d_pooled[:, None]
    d_alpha = np.matmul(h, d_pooled[..., None])[..., 0]
    d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=1, keepdims=True))
    g["see"] = np.tensordot(d_e, u, axes=([0, 1], [0, 1]))
    d_u = d_e[..., None] * w["see"] * (1 - u * u)
    g["look"] = np.tensordot(h, d_u, axes=([0, 1], [0, 1]))
    d_h = d_h + d_u @ w["look"].T
    d_p = np.zeros((*place.shape, 2 * n), dtype=np.float32)
    for side, (name, tape) in enumerate(zip(("fore", "back"), tapes)):
        later = np.zeros((len(place), STATE), dtype=np.float32)
        for t, before, a, z, r, c, m in reversed(tape):
            now = d_h[:, t, side * STATE:(side + 1) * STATE] + later
            d_new = now * m
            d_c = d_new * z * (1 - c * c)
            d_z = d_new * (c - before) * z * (1 - z)
            d_r = d_c * a * r * (1 - r)
            d_x = np.concatenate([d_z, d_r, d_c], axis=1)
            d_a = np.concatenate([d_z, d_r, d_c * r], axis=1)
            g[name] += before.T @ d_a
            later = now - d_new * z + d_a @ w[name].T
            d_p[:, t, side * n:(side + 1) * n] = d_x
    d_gates = np.zeros_like(gates)
    np.add.at(d_gates, place.ravel(), d_p.reshape(-1, 2 * n))
    g["inp"], g["bias"] = x.T @ d_gates, d_gates.sum(axis=0)
    d_x = d_gates @ w["inp"].T
    np.add.at(g["word"], own, d_x[:, :WORD_SIZE] * kept)
    counts = np.diff(ptr)
    scaled = d_x[:, WORD_SIZE:] / np.sqrt(counts).astype(np.float32)[:, None]
    np.add.at(g["char"], chars, np.repeat(scaled, counts, axis=0))
    return loss, g


class Adam:
    def __init__(self, net: Network, rate: float = RATE):
        self.net, self.rate, self.step = net, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in net.weights.items()}
        self.square = {k: np.zeros_like(v) for k, v in net.weights.items()}

    def take(self, g: dict[str, np.ndarray]) -> None:
        self.step += 1
        size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        for k, v in g.items():
            v = v * min(1.0, 1.0 / (size + 1e-9))
            self.mean[k] += 0.1 * (v - self.mean[k])
            self.square[k] += 0.01 * (v * v - self.square[k])
            mean, square = self.mean[k] / (1 - 0.9 ** self.step), self.square[k] / (1 - 0.99 ** self.step)
            self.net.weights[k] -= self.rate * mean / (np.sqrt(square) + 1e-6)


def line(x: np.ndarray, label: np.ndarray, ridge: float = 0.05, steps: int = 50) -> np.ndarray:
    """Slopes, none below 0, and shift of the log odds of a label, by penalised logistic regression."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    used = list(range(x.shape[1]))
    while True:
        z, a = np.column_stack([(x[:, used] - centre[used]) / scale[used], np.ones(len(x))]), np.zeros(len(used) + 1)
        penalty = np.diag([ridge] * len(used) + [1e-3])
        for _ in range(steps):
            p = sigmoid(z @ a)
            step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(len(a)), z.T @ (label - p) - penalty @ a)
            a = a + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-7:
                break
        if (a[:-1] >= 0).all():
            break
        used = [k for k, v in zip(used, a) if v >= 0]
    out = np.zeros(x.shape[1] + 1)
    out[used] = a[:-1] / scale[used]
    out[-1] = a[-1] - out[:-1] @ centre
    return out


# --- texts as windows --------------------------------------------------------------------


def gathered(places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of words, which are there, text, first word) of all windows of texts given as numbers of their words."""
    lengths = np.array([len(p) for p in places], dtype=np.int64)
    offsets = np.cumsum(lengths) - lengths
    begins = [windows(int(n)) for n in lengths]
    text = np.repeat(np.arange(len(places)), [len(b) for b in begins])
    begin = np.array([b for own in begins for b in own], dtype=np.int64)
    flat = np.concatenate([*places, np.zeros(1, dtype=np.int64)])
    at = begin[:, None] + np.arange(WINDOW)
    there = at < lengths[text][:, None]
    place = flat[np.where(there, at + offsets[text][:, None], len(flat) - 1)]
    return place, there.astype(np.float32), text, begin


def numbers_of(net: Network, gates: np.ndarray, place: np.ndarray, there: np.ndarray) -> np.ndarray:
    """The network's number of each window."""
    out = np.empty(len(place), dtype=np.float32)
    for a in range(0, len(place), AT_ONCE):
        out[a:a + AT_ONCE] = net.forward(gates[place[a:a + AT_ONCE]], there[a:a + AT_ONCE])[0]
    return out


def worst(raw: np.ndarray, text: np.ndarray, count: int) -> np.ndarray:
    """For each text the place of its worst window (the first of equals), -1 for texts without windows."""
    order = np.lexsort((np.arange(len(raw)), -raw, text))
    first = np.flatnonzero(np.diff(text[order], prepend=-1))
    out = np.full(count, -1, dtype=np.int64)
    out[text[order[first]]] = order[first]
    return out


def fit(texts: list[list[bytes]], label: np.ndarray, rounds: int = ROUNDS, seed: int = 0) -> Network:
    """The network of texts (their words) labelled 1 (toxic) or 0."""
    rng = np.random.default_rng(seed)
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    places = [np.fromiter(map(number.__getitem__, t), dtype=np.int64, count=len(t)) for t in texts]
    own, chars, ptr = vocabulary = features(list(number) or [b"-"])
    check = np.arange(len(texts)) % 5 == 4
    net = fresh(rng)

    # First components: log odds of a feature, by the documents that have it.
    seen = {k: np.zeros((2, ROWS)) for k in ("word", "char")}
    for p, y in zip(places, label):
        if len(p):
            used = np.unique(p)
            seen["word"][int(y), np.unique(own[used])] += 1
            flat = np.concatenate([chars[ptr[i]:ptr[i + 1]] for i in used.tolist()])
            seen["char"][int(y), np.unique(flat)] += 1
    ratio = max(1.0, label.sum()) / max(1.0, (1 - label).sum())
    for k, (clean, toxic) in seen.items():
        net.weights[k][:, 0] = np.clip(np.log((toxic + 3) / (clean * ratio + 3)), -1, 4) / 2

    place, there, text, _ = gathered(places)
    train = np.flatnonzero(~check)
    adam = Adam(net)
    for _ in range(rounds):
        raw = numbers_of(net, net.inputs(own, chars, ptr)[1], place, there)
        top = worst(raw, text, len(texts))
        named = train[top[train] >= 0]
        clean = named[label[named] == 0]
        many = np.bincount(text, minlength=len(texts))
        drawn = np.cumsum(many)[clean] - 1 - rng.integers(0, 1 << 40, len(clean)) % np.maximum(1, many[clean])
        chosen, goal = np.concatenate([top[named], drawn]), np.concatenate([label[named], np.zeros(len(clean))]).astype(np.float32)
        order = rng.permutation(len(chosen))
        for a in range(0, len(order), BATCH):
            rows = order[a:a + BATCH]
            used, local = np.unique(place[chosen[rows]], return_inverse=True)
            part = np.concatenate([np.arange(ptr[i], ptr[i + 1]) for i in used.tolist()])
            few = own[used], chars[part], np.concatenate([[0], np.cumsum(np.diff(ptr)[used])])
            # Half of the words are known by their characters alone, lest the network learn rare words by heart.
            kept = 2 * rng.integers(0, 2, (len(used), 1)).astype(np.float32)
            adam.take(gradients(net, few, local.reshape(len(rows), WINDOW), there[chosen[rows]], goal[rows], kept)[1])
        adam.rate *= 0.8
    raw = numbers_of(net, net.inputs(own, chars, ptr)[1], place, there)
    top, many = worst(raw, text, len(texts)), np.bincount(text, minlength=len(texts))
    known = np.flatnonzero(check & (top >= 0))
    if len(known) < 8 or label[known].min() == label[known].max():
        known = np.flatnonzero(top >= 0)
    if len(known):
        mean = np.bincount(text, weights=sigmoid(raw), minlength=len(texts)) / np.maximum(1, many)
        net.line = line(np.column_stack([raw[top[known]], mean[known]]).astype(float), label[known].astype(float))
    share = np.clip(label.mean(), 0.001, 0.999)
    net.prior = float(np.log(share / (1 - share)))
    return net


# --- tables ---------------------------------------------------------------------------------


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            own = words(text)
            if len(own) > SAMPLE_WORDS:
                some = SAMPLE_WORDS // WINDOW
                begin = [k * (len(own) - WINDOW) // (some - 1) for k in range(some)]
                own = [w for a in begin for w in own[a:a + WINDOW]]
            out.append(b" ".join(own))
        yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("toxic"), pa.array(out, pa.binary())], ["h", "toxic", "words"])


def train(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN, rounds: int = ROUNDS) -> Network | None:
    """The network fitted on docs (doc_id, text) with labels (doc_id, toxic); None if there are no documents of both kinds.

    The fit uses about `toxic` and `clean` documents of either kind, by a hash of the id (and, where one id has many
    texts, of the text).  A document labelled twice is toxic if one label says so.  Null ids, labels and texts without
    words teach nothing.  The same tables give the same network.
    """
    small_batches(docs.sparkSession)
    full = 1 << 30
    h = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(full))
    marks = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    limits = {1: toxic, 0: clean}
    cut = {k: int(full * min(1.0, limits[k] / max(1, counts.get(k, 0)))) for k in (0, 1)}
    # At most about toxic + clean rows, whatever the input: they go to every task.
    some = marks.filter(h < F.when(F.col("toxic") == 1, cut[1]).otherwise(cut[0]))
    of_row = F.pmod(F.xxhash64("doc_id", "text", F.lit(13)), F.lit(full)).alias("h")
    rows = docs.filter("text IS NOT NULL").select("doc_id", "text", of_row).join(F.broadcast(some), "doc_id").select("h", "toxic", "text")
    distinct = rows.groupBy("h").agg(F.first("toxic").alias("toxic")).groupBy("toxic").count()
    many = {r["toxic"]: r["count"] for r in distinct.collect()}
    if any(many.get(k, 0) > 2 * limits[k] for k in (0, 1)):
        part = {k: int(full * min(1.0, limits[k] / max(1, many.get(k, 0)))) for k in (0, 1)}
        rows = rows.filter(F.col("h") < F.when(F.col("toxic") == 1, part[1]).otherwise(part[0]))
    found = rows.dropDuplicates(["h"]).mapInArrow(_sampled, "h long, toxic int, words binary").toArrow().sort_by("h")
    texts = [w.split() for w in found.column("words").to_pylist()]
    label = np.array(found.column("toxic").to_pylist(), dtype=np.float32)
    if not len(label) or label.min() == label.max():
        return None
    return fit(texts, label, rounds)


class _Words:
    """Numbers of words, and what the gates get from each; starts anew when there are many."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.gates = np.zeros((1_024, 6 * STATE), dtype=np.float32)

    def of(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        if len(self.number) > KNOWN:
            self.clear()
        known, number = len(self.number), self.number
        out = [np.fromiter(map(number.__getitem__, t), dtype=np.int64, count=len(t)) for t in texts]
        if len(number) > known:
            if len(number) > len(self.gates):
                more = np.zeros((2 * len(number), 6 * STATE), dtype=np.float32)
                more[:known] = self.gates[:known]
                self.gates = more
            self.gates[known:len(number)] = self.net.inputs(*features(list(islice(number, known, None))))[1]
        return out


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """For each row of docs: doc_id, score (0 to 1, higher: toxic is likelier), n_windows, and worst_start and worst_end, the
    words of its worst window.

    All overlapping windows of the whole text are read.  Texts without words (null, empty) have no window and get the
    share of toxic documents in the fit's sample; without a network every score is 0.  Equal texts score alike, other columns are ignored.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some 300,000 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, known = shared.value, _Words(shared.value)
        for batch in batches:
            n = batch.num_rows
            odds, many = np.full(n, -np.inf if net is None else net.prior), np.zeros(n, dtype=np.int64)
            start, end = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
            held, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                held.append(words(text))
                rows.append(i)
                if net is not None and (i == n - 1 or sum(map(len, held)) > 50_000):
                    places = known.of(held)
                    place, there, text_of, begin = gathered(places)
                    raw = numbers_of(net, known.gates, place, there)
                    top, odds[rows] = net.judged(raw, text_of, len(held))
                    for at, w, own in zip(rows, top.tolist(), held):
                        if w >= 0:
                            start[at], end[at] = begin[w], min(len(own), begin[w] + WINDOW)
                    many[rows] = np.bincount(text_of, minlength=len(held))
                    held, rows = [], []
            values = np.where(odds == -np.inf, 0.0, 1 / (1 + np.exp(-np.clip(odds, -500, 500))))
            spans = [pa.array([None if x < 0 else x for x in y.tolist()], pa.int64()) for y in (start, end)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(values), pa.array(many), *spans], ["doc_id", "score", "n_windows", "worst_start", "worst_end"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, n_windows long, worst_start long, worst_end long")
