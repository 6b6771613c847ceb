"""A hidden Markov language model, trained by Baum-Welch over all partitions.

Words fall into a bounded number of classes: the most frequent have one of
their own, the others share classes by their first and last letters.  A latent
state emits a class, the class emits the word by smoothed counts, so the model
is a distribution over all words and one unknown word per shared class.  Each
training round sums expected counts over all training texts; the forward
recursion with scaling gives the exact likelihood of a text.

Counts of the most frequent words go to every task (their number and length
are bounded); all other words meet their counts by a join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TO_LOWER, small_batches, slices, written

OWN = 2_048  # words with a class of their own
SHARED = 512  # classes of all other words
HEAD = 131_072  # words whose counts every task gets
LONGEST = 64  # bytes of such a word
END = OWN + SHARED
CLASSES = END + 1
PIECE = 2_048  # words; longer texts are trained on as pieces that start anew
BUFFER = 1_000_000  # words trained on at once
SCORED = 4_000_000  # words scored at once
PRIOR = 50.0  # words that smooth a state's classes
COUNTED = 300_000  # distinct words that a task holds before it passes them on


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TO_LOWER).split()


def shared_class(word: bytes) -> int:
    w = word.decode()
    return OWN + zlib.crc32((w[:2] + w[-2:]).encode()) % SHARED


def shared_class_of(word: Column) -> Column:
    return F.lit(OWN) + (F.crc32(F.concat(F.substring(word, 1, 2), F.right(word, F.lit(2))).cast("binary")) % SHARED).cast("int")


def held_out(doc_id: Column) -> Column:
    """One in five, by the CRC-32 of the id as text; rows without id are trained on."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    ends = 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(seen.values(), pa.int64())], ["word", "c"])

    for batch in batches:
        for text in batch.column("text").to_pylist():
            seen.update(words(text))
            ends += 1
            if len(seen) > COUNTED:
                yield flush()
                seen.clear()
    if seen:
        yield flush()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([ends], pa.int64())], ["word", "c"])


@dataclass
class Words:
    """What every task knows of the words: bounded, whatever the corpus."""

    tokens: int  # N
    types: int  # V
    ends: int
    head: dict  # word -> (class, count)
    shared: np.ndarray  # per class log10 of the count of its words plus half of its types and of the unknown one
    unigram: np.ndarray  # probability of each class


def count_words(train: DataFrame) -> tuple[DataFrame, Words]:
    """The vocabulary (word, c) of the training texts, and what is to be known of it everywhere."""
    small_batches(train.sparkSession)
    counts = train.select("text").mapInArrow(_counter, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))
    counts = written(counts, "counts")
    ends = counts.filter("word IS NULL").agg(F.sum("c")).first()[0] or 0
    vocabulary = counts.filter("word IS NOT NULL")
    # Counts fall into 32 classes per power of two; the head takes whole classes from the top while it stays in bounds.
    grade = F.floor(F.log2(F.col("c").cast("double")) * 32).cast("int")
    short = vocabulary.filter(F.octet_length("word") <= LONGEST).withColumn("grade", grade)
    left, least = HEAD, 1 << 30
    for row in sorted(short.groupBy("grade").count().collect(), reverse=True):  # at most 2,048 rows
        if row["count"] > left:
            break
        left, least = left - row["count"], row["grade"]
    top = sorted(short.filter(F.col("grade") >= least).select("word", "c").collect(), key=lambda r: (-r["c"], r["word"]))
    head = {}
    for i, row in enumerate(top):
        word = row["word"].encode()
        head[word] = (i if i < OWN else shared_class(word), row["c"])
    own = [r["word"] for r in top[:OWN]]
    in_own = F.col("word").isin(own) if own else F.lit(False)
    sums = vocabulary.groupBy(F.when(in_own, -1).otherwise(shared_class_of(F.col("word"))).alias("k")).agg(
        F.sum("c").alias("n"), F.count("*").alias("v")
    ).collect()  # a row per shared class
    counts_of = {r["k"]: (r["n"], r["v"]) for r in sums}
    n = np.array([counts_of.get(OWN + k, (0, 0)) for k in range(SHARED)], dtype=float).reshape(-1, 2)
    mass = np.zeros(CLASSES)
    mass[:len(own)] = [r["c"] for r in top[:OWN]]
    mass[OWN:END] = n[:, 0]
    mass[END] = ends
    tokens = int(mass.sum())
    types = sum(v for _, v in counts_of.values()) + (ends > 0)
    unigram = (mass + 0.5) / (mass + 0.5).sum()
    return vocabulary, Words(tokens, types, int(ends), head, np.log10(n[:, 0] + 0.5 * (n[:, 1] + 1)), unigram)


ENCODED = "doc_id long, held_out boolean, n_tokens long, known long, logs double, given double, tail array<string>, codes binary"


def _encoder(shared):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Words = shared.value
        place = dict(zip(table.head, range(len(table.head))))
        classes = np.array([*(k for k, _ in table.head.values()), END], dtype="<u2")
        logs = np.log10(np.array([*(c for _, c in table.head.values()), table.ends]) + 0.5)
        # What a word adds to the score beside its class; the end stands last.
        extra = np.zeros(len(logs))
        common = (classes >= OWN) & (classes < END)
        extra[common] = logs[common] - table.shared[classes[common] - OWN]
        end = len(place)
        for batch in batches:
            columns = [[] for _ in range(6)]
            for text in batch.column("text").to_pylist():
                ws = words(text)
                at = np.fromiter(map(place.get, ws, repeat(-1)), np.int64, len(ws))
                at = np.append(at, end)
                codes, given = classes[at], extra[at]
                beyond = np.flatnonzero(at < 0).tolist()
                tail = [ws[i].decode() for i in beyond]
                for i in beyond:
                    codes[i] = k = shared_class(ws[i])
                    given[i] = -table.shared[k - OWN]
                # One after the other, the end first: sums as a loop over the words would make them.
                known = np.r_[logs[end], logs[at[:-1][at[:-1] >= 0]]].cumsum()[-1]
                values = len(at), len(at) - len(tail) - (table.ends == 0), known, given.cumsum()[-1], tail, codes.tobytes()
                for column, value in zip(columns, values):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["doc_id", "held_out", "n_tokens", "known", "logs", "given", "tail", "codes"],
            )

    return encode


@dataclass
class Model:
    start: np.ndarray  # state
    move: np.ndarray  # state x state
    emit: np.ndarray  # class x state


def first_model(unigram: np.ndarray, states: int, seed: int) -> Model:
    noise = unigram[:, None] * np.random.default_rng(seed).lognormal(0.0, 1.0, (len(unigram), states))
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Model(np.full(states, 1 / states), move, noise / noise.sum(axis=0))


def _order(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes by position: the first of all sequences, the second of those that have one, ...; where each begins; and
    the order of the sequences, longest first."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    flat, lengths = np.concatenate([sequences[i] for i in order]), lengths[order]
    # Of the longest first, those that go on at a step are the first ones.
    begins = np.concatenate([[0], np.cumsum(np.cumsum(np.bincount(lengths)[::-1])[::-1][1:])])
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    codes = np.empty_like(flat)
    codes[begins[at] + np.repeat(np.arange(len(lengths)), lengths)] = flat
    return codes, begins, order


def forward(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 of the probability of each sequence, all step by step together."""
    codes, begins, order = _order(sequences)
    total = np.zeros(len(sequences))
    alpha = None
    for t in range(len(begins) - 1):
        emitted = model.emit[codes[begins[t]:begins[t + 1]]]
        alpha = emitted * (model.start if alpha is None else alpha[:len(emitted)] @ model.move)
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        total[:len(scale)] += np.log10(scale)
    out = np.empty(len(sequences))
    out[order] = total
    return out


def expected(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of start states, moves and emissions (class x state), by the scaled forward-backward recursion."""
    codes, begins, _ = _order(sequences)
    steps, states = len(begins) - 1, len(model.start)
    alphas, scales = np.empty((len(codes), states)), np.empty(len(codes))
    emitted = model.emit[codes]
    alpha = None
    for t in range(steps):
        now = slice(begins[t], begins[t + 1])
        n = begins[t + 1] - begins[t]
        alpha = emitted[now] * (model.start if alpha is None else alpha[:n] @ model.move)
        scales[now] = alpha.sum(axis=1)
        alpha = alpha / scales[now][:, None]
        alphas[now] = alpha
    moves, last = np.zeros((states, states)), None  # last: emission x backward value over scale, one step ahead
    for t in reversed(range(steps)):
        now = slice(begins[t], begins[t + 1])
        own = alphas[now]
        beta = np.ones_like(own)
        if last is not None:
            n = len(last)
            moves += own[:n].T @ last
            beta[:n] = last @ model.move.T
        last = emitted[now] * beta / scales[now][:, None]
        alphas[now] = own * beta
    counts = np.stack([np.bincount(codes, alphas[:, k], minlength=len(model.emit)) for k in range(states)], axis=1)
    return alphas[:begins[1]].sum(axis=0), moves * model.move, counts


def _codes(column) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype="<u2").astype(np.int64) for x in column.to_pylist()]


def _trainer(shared):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        sums = [np.zeros_like(x) for x in (model.start, model.move, model.emit)]
        held, size = [], 0

        def add():
            for into, x in zip(sums, expected(model, held)):
                into += x

        for batch in batches:
            for codes in _codes(batch.column("codes")):
                for at in range(0, len(codes), PIECE):
                    held.append(codes[at:at + PIECE])
                    size += len(held[-1])
                if size >= BUFFER:
                    add()
                    held, size = [], 0
        if held:
            add()
        flat = np.concatenate([x.ravel() for x in sums])
        cells = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(flat[cells])], ["cell", "value"])

    return train


def baum_welch(encoded: DataFrame, unigram: np.ndarray, states: int, rounds: int, seed: int) -> Model:
    """Each round sums the expected counts of all partitions, cell by cell; only the sums reach the driver, and their
    number is that of the model's parameters."""
    model = first_model(unigram, states, seed)
    spark = encoded.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)  # classes x states numbers
        parts = encoded.select("codes").mapInArrow(_trainer(shared), "cell int, value double")
        sums = np.zeros(states + states * states + CLASSES * states)
        for row in parts.groupBy("cell").agg(F.sum("value").alias("value")).collect():
            sums[row["cell"]] = row["value"]
        if not sums.any():
            break
        start, move, emit = np.split(sums, [states, states + states * states])
        move, emit = move.reshape(states, states) + 0.1, emit.reshape(CLASSES, states) + PRIOR * unigram[:, None]
        model = Model((start + 0.1) / (start + 0.1).sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
        shared.unpersist()
    return model


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value

        def scored(ids, held):
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(forward(model, held))], ["rid", "classes"])

        ids, held, size = [], [], 0
        for batch in batches:
            for rid, codes in zip(batch.column("rid").to_pylist(), _codes(batch.column("codes"))):
                ids.append(rid)
                held.append(codes)
                size += len(codes)
                if size >= SCORED:
                    yield scored(ids, held)
                    ids, held, size = [], [], 0
        if held:
            yield scored(ids, held)

    return score


def score(docs: DataFrame, states: int = 8, rounds: int = 5, seed: int = 1) -> DataFrame:
    """For every row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    score is the model's log10 probability of the text and its end, base_score that of smoothed word counts alone.  The
    model learns from the rows that are not held out.  Null and empty texts are an end alone.  Rows with equal ids give
    a row each.  Without training texts all words are unknown and the model stays as it began.  An empty table gives no
    rows.  Only doc_id and text are used.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    vocabulary, table = count_words(rows.filter("NOT held_out"))
    shared = spark.sparkContext.broadcast(table)  # at most HEAD words of LONGEST bytes
    encoded = rows.mapInArrow(_encoder(shared), ENCODED).withColumn("rid", F.monotonically_increasing_id())
    encoded = written(encoded, "encoded")
    model = baum_welch(encoded.filter("NOT held_out"), table.unigram, states, rounds, seed)
    tail = encoded.select("rid", F.explode("tail").alias("word"))
    met = tail.join(vocabulary, "word", "left").select("rid", F.coalesce("c", F.lit(0)).alias("c"))
    rest = met.groupBy("rid").agg(F.sum(F.log10(F.col("c") + 0.5)).alias("tail_logs"), F.count_if(F.col("c") > 0).alias("tail_known"))
    classes = encoded.select("rid", "codes").mapInArrow(_scorer(spark.sparkContext.broadcast(model)), "rid long, classes double")
    every = encoded.select("rid", "doc_id", "held_out", "n_tokens", "known", "logs", "given").join(classes, "rid").join(rest, "rid", "left")
    tail_logs = F.coalesce("tail_logs", F.lit(0.0))
    base = F.lit(float(np.log10(table.tokens + 0.5 * (table.types + 1))))
    return every.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(table.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + tail_logs - F.col("n_tokens") * base).alias("base_score"),
        (F.col("classes") + F.col("given") + tail_logs).alias("score"),
    )
