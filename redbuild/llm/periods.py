"""Periodic runs in texts, found by string synchronising sets.

A run is a stretch of words that repeats with its smallest period q at least
four times and that no neighbouring word extends.  Texts are compared by words,
many texts at once, with a word of its own between any two of them.

For each t = 4, 8, 16, ... all stretches of t words get a hash, made from two of
half the length.  A place i belongs to the synchronising set of t if the least
hash among the stretches that begin at i .. i + t is that at i or at i + t;
stretches of a period of t/4 or less don't count.  Whether a place belongs thus
depends on the 2t words behind it alone, and any t places in a row have one,
unless they lie in a region of so small a period.  In a run of period q with
t < q <= 2t some place of the set stands in the first t words; q words behind it
the same 2t words stand again, for the first time, and that place is in the set,
too.  So neighbours among the places of equal contexts propose all periods above
t, and each proposal is then measured word by word.  Periods up to 4 are found
by comparing the words with those 1 .. 4 places on; together with the runs of
the scales below they are the regions that a scale leaves out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, small_batches

LEAST = 6  # words of a run
TIMES = 4  # that a run holds its period
DIRECT = 4  # periods that are looked for directly
AT_ONCE = 150_000  # words of several texts that are searched at once
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _twice(h: np.ndarray, t: int) -> np.ndarray:
    """Hashes of stretches of 2t words from those of t words; stretches beyond the end are unlike all others."""
    out = np.empty_like(h)
    n = max(0, len(h) - t)
    out[:n] = _mixed(h[:n] * np.uint64(0x9E3779B97F4A7C15) + (h[t:] ^ h[t:] >> np.uint64(29)) + np.uint64(2 * t + 1))
    out[n:] = _mixed(np.arange(n, len(h), dtype=np.uint64) + np.uint64(0xD1B54A32D192ED03))
    return out


def _least_ahead(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i .. i + width - 1], for all i that have so many."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out, have = np.minimum(out[:-step], out[step:]), have + step
    return out


def _same_from(w: np.ndarray, a: int, b: int) -> int:
    """How many words are equal from a on and from b on, a < b."""
    n, size = 0, 64
    while b + n < len(w):
        size = min(size, len(w) - b - n)
        unlike = w[a + n:a + n + size] != w[b + n:b + n + size]
        at = int(unlike.argmax())
        if unlike[at]:
            return n + at
        n, size = n + size, size * 4
    return n


def _same_before(w: np.ndarray, a: int, b: int) -> int:
    """How many words are equal in front of a and in front of b, a < b."""
    n, size = 0, 64
    while a - n > 0:
        size = min(size, a - n)
        unlike = w[a - n - size:a - n][::-1] != w[b - n - size:b - n][::-1]
        at = int(unlike.argmax())
        if unlike[at]:
            return n + at
        n, size = n + size, size * 4
    return n


def synchronising(h: np.ndarray, t: int, periodic: np.ndarray) -> np.ndarray:
    """Places of the synchronising set, given hashes of stretches of t words and which stretches are not to count."""
    k = np.where(periodic, NONE, h)
    least = _least_ahead(k, t + 1)
    n = len(least)
    return np.flatnonzero((least != NONE) & ((k[:n] == least) | (k[t:t + n] == least)))


def _proposed(h: np.ndarray, twice: np.ndarray, t: int, periodic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(period, place), in this order: neighbours among places of equal contexts whose distance fits the scale."""
    places = synchronising(h, t, periodic)
    context = twice[places]
    order = np.argsort(context, kind="stable")
    near = np.flatnonzero(context[order[1:]] == context[order[:-1]])
    a, b = places[order[near]], places[order[near + 1]]
    fits = (b - a > t) & (b - a <= 2 * t)
    a, q = a[fits], (b - a)[fits]
    order = np.lexsort((a, q))
    return q[order], a[order]


def runs_in(w: np.ndarray, lengths: np.ndarray, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, end, period) of all stretches that hold their smallest period `times` times or more, in any order.

    w: numbers of the words of texts of these lengths, with a number of its own behind each text.
    """
    if times < TIMES:
        raise ValueError("runs of fewer than four periods may have no place of the synchronising set")
    found: dict[tuple[int, int], int] = {}
    for q in range(1, min(DIRECT, len(w) - 1) + 1):
        same = np.zeros(len(w) - q + 2, dtype=np.int8)
        same[1:-1] = w[q:] == w[:-q]
        edges = np.flatnonzero(np.diff(same))
        starts, ends = edges[::2], edges[1::2] + q
        for i in np.flatnonzero(ends - starts >= TIMES * q).tolist():
            found.setdefault((int(starts[i]), int(ends[i])), q)  # the smallest is met first
    h = _mixed(w.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for t in (1, 2):
        h = _twice(h, t)
    at, t = np.arange(len(w)), DIRECT
    while True:
        enough = lengths >= TIMES * (t + 1)
        if not enough.any():
            break
        if not enough.all():  # texts too short for longer periods go
            keep = np.repeat(enough, lengths + 1)
            w, h, at, lengths = w[keep], h[keep], at[keep], lengths[enough]
        twice = _twice(h, t)
        marks = np.zeros(len(w) + 1, dtype=np.int64)
        small = np.array([(s, e) for (s, e), q in found.items() if 4 * q <= t <= e - s], dtype=np.int64).reshape(-1, 2)
        if len(small):
            own = np.searchsorted(at, small[:, 0])
            there = own < len(at)
            there[there] = at[own[there]] == small[there, 0]
            np.add.at(marks, own[there], 1)
            np.add.at(marks, own[there] + (small[there, 1] - small[there, 0]) - t + 1, -1)
        periods, places = _proposed(h, twice, t, np.cumsum(marks[:-1]) > 0)
        last, until = 0, 0
        for q, a in zip(periods.tolist(), places.tolist()):
            if q == last and a < until:
                continue  # within the stretch measured last
            start = a - _same_before(w, a, a + q)
            until, last = a + _same_from(w, a, a + q), q
            if until + q - start >= TIMES * q:
                s = int(at[start])
                found.setdefault((s, s + until + q - start), q)
        h, t = twice, 2 * t
    return [(s, e, q) for (s, e), q in found.items() if e - s >= times * q]


def _searched(texts: list[list[bytes]], least: int, times: int) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """For each text, given by its words: its runs (start, length, period) in order, and what is left of it."""
    number = defaultdict(count().__next__)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    w = np.empty(int(lengths.sum()) + len(texts), dtype=np.int64)
    begin = np.cumsum(lengths + 1) - lengths - 1
    for at, t in zip(begin.tolist(), texts):
        w[at:at + len(t)] = np.fromiter(map(number.__getitem__, t), dtype=np.int64, count=len(t))
    w[begin + lengths] = len(number) + np.arange(len(texts))
    own: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for s, e, q in runs_in(w, lengths, times):
        if e - s >= least:
            i = int(np.searchsorted(begin, s, side="right")) - 1
            own[i].append((s - int(begin[i]), e - s, q))
    out = []
    for t, runs in zip(texts, own):
        runs.sort(key=lambda r: (r[0], r[2]))
        if runs:
            drop = np.zeros(len(t) + 1, dtype=np.int64)
            for s, n, q in runs:
                drop[s + q] += 1
                drop[s + n] -= 1
            kept = np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()
            out.append((runs, b" ".join([t[i] for i in kept])))
        else:
            out.append((runs, b" ".join(t)))
    return out


def _grouped(texts: list[str | None], least: int, times: int) -> Iterator[tuple[int, list, bytes]]:
    """(words, runs, what is left) of each text, in order."""
    held, n = [], 0
    for i, text in enumerate(texts):
        held.append((text or "").encode().split())  # bytes are split at ASCII white space only
        n += len(held[-1])
        if n >= AT_ONCE or i == len(texts) - 1:
            yield from ((len(t), *found) for t, found in zip(held, _searched(held, least, times)))
            held, n = [], 0


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """For each row of docs: doc_id, n_words, runs (start, length, period in words, by start, then period) and collapsed,
    the text without the words that any run holds behind its first period, joined by single spaces.

    A run has `least` words or more and holds its period `times` times or more, 4 at least.  Null and empty texts have
    no words and no runs; their collapsed text is empty.  Equal rows give a row each, other columns are ignored, and an
    empty table gives no rows.  Texts are searched whole, each in one task; nothing is shuffled.  Every run given is
    measured word by word; one is missed only where two of a text's stretches collide in 64 bits.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_grouped(batch.column("text").to_pylist(), least, times))
            flat = [r for _, runs, _ in found for r in runs]
            values = pa.StructArray.from_arrays([pa.array([r[k] for r in flat], pa.int64()) for k in range(3)], fields=list(RUN))
            ends = np.cumsum([0, *(len(runs) for _, runs, _ in found)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([n for n, _, _ in found], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), pa.array([c.decode() for _, _, c in found], pa.string()),
                ],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    )


def with_loops(text: Column, doc_id: Column) -> Column:
    """The text, or, for about every tenth id, the text with its end replaced by repetitions of a stretch of it: cases with
    known runs.  Texts without words and rows without id stay as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def looped(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        end = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda i: F.get(words, (a + i % p).cast("int")))
        return F.when(n > 0, F.concat_ws(" ", F.slice(words, 1, a.cast("int")), end)).otherwise(text)

    return F.when(h % 10 == 0, let(F.filter(F.split(text, SPACES), lambda w: w != ""), looped)).otherwise(text)
