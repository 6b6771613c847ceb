"""Importance resampling towards a target corpus, over hashed runs of words.

Every run of one to three words falls into a bucket by the CRC-32 of its bytes.
A document's words are joined by single spaces and scanned once, with the
running CRC kept at the ends of all words; the CRC of any run then follows from
the two running values at its ends: that of the shorter prefix is moved over as
many zero bytes as the run is long (a linear map over GF(2), from tables) and
cancelled.  Bucket counts of the corpus and of the target give each bucket a
gain, documents sum their gains, and Gumbel noise by a hash of the id makes the
highest sums a draw without replacement.

The corpus is scanned twice: for its bucket counts (one row of each bucket from
each task), and for the sums.  Only ids and sums are shuffled, never texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import TO_LOWER, ranked, small_batches, unused, written

BUCKETS = 10_000
LONGEST = 3  # words of a run
POLYNOMIAL = 0xEDB88320
#: Lower case, and a space for all bytes but digits, letters and those beyond ASCII.
NORMAL = bytes(TO_LOWER[c] if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
PIECE = 1 << 20  # bytes of a long text whose words are held at once
AT_ONCE = 100_000  # words whose runs are hashed at once
ONES = np.uint32(0xFFFFFFFF)


def _steps() -> np.ndarray:
    """What one byte makes of the register."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(POLYNOMIAL), t >> 1)
    return t.astype(np.uint32)


STEP = _steps()


def _mapped(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """x through a linear map that is given by its values for each of the four bytes."""
    return tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255] ^ tables[3][x >> 24]


def _short_moves(count: int) -> np.ndarray:
    """[n, byte, value]: registers moved over n zero bytes, for n below count."""
    own = np.arange(256, dtype=np.uint32)
    moves = [np.stack([own << np.uint32(8 * b) for b in range(4)])]
    for _ in range(count - 1):
        moves.append(STEP[moves[-1] & 255] ^ moves[-1] >> 8)
    return np.stack(moves)


SHORT = 128
MOVES = _short_moves(SHORT).reshape(-1)
#: The maps for 128, 256, 512, ... zero bytes.
DOUBLED = [np.stack([STEP[m & 255] ^ m >> 8 for m in MOVES.reshape(SHORT, 4, 256)[-1]])]
while len(DOUBLED) < 32:
    DOUBLED.append(_mapped(DOUBLED[-1], DOUBLED[-1]))


def moved(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """crc (uint32) moved over n zero bytes each."""
    at = (n & SHORT - 1) << 10
    out = MOVES[at + (crc & 255)] ^ MOVES[at + (256 | crc >> 8 & 255)] ^ MOVES[at + (512 | crc >> 16 & 255)] ^ MOVES[at + (768 | crc >> 24)]
    rest, k = n // SHORT, 0
    while rest.any():
        rows = np.flatnonzero(rest & 1)
        out[rows] = _mapped(DOUBLED[k], out[rows])
        rest, k = rest >> 1, k + 1
    return out


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


def _running(crc: int, word: bytes) -> int:
    return crc32(word, crc32(b" ", crc))


def run_crcs(parts: list[list[bytes]], longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length up to longest: (part, last, crc) of all runs of so many words; last is the place of the run's last
    word in its part."""
    counts = [len(p) for p in parts]
    total = sum(counts)
    part = np.repeat(np.arange(len(parts)), counts)
    first = np.cumsum(counts) - counts
    place = np.arange(total) - first[part] if total else np.zeros(0, dtype=np.int64)
    length = np.fromiter((len(w) for p in parts for w in p), dtype=np.int64, count=total)
    end = np.empty(total, dtype=np.uint32)
    for at, p in zip(first.tolist(), parts):
        running = accumulate(p, _running, initial=0)
        next(running)
        end[at:at + len(p)] = np.fromiter(running, dtype=np.uint32, count=len(p))
    # Before each word: the value at the end of the word before it, and one space.
    before = np.where(place > 0, np.roll(end, 1), np.uint32(0)) ^ ONES
    start = STEP[(before ^ np.uint32(32)) & 255] ^ before >> 8 ^ ONES
    offset = np.cumsum(length + 1)
    for n in range(1, longest + 1):
        size = max(0, total - n + 1)
        inside = np.flatnonzero(part[:size] == part[n - 1:]) if size else np.zeros(0, dtype=np.int64)
        last = inside + n - 1
        span = offset[last] - offset[inside] + length[inside]
        yield part[inside], place[last], end[last] ^ moved(start[inside], span)


def _groups(texts: list[str | None]) -> Iterator[tuple[list[int], list[list[bytes]], list[int]]]:
    """(rows, parts, repeated): words of whole texts, in groups of bounded size.  A part of a long text begins with the
    last words of the part before, `repeated` many, so that every run is whole in one part."""
    rows, parts, repeated, held = [], [], [], 0
    for row, text in enumerate(texts):
        data = (text or "").encode().translate(NORMAL)
        at, tail = 0, []
        while at < len(data) or not at:
            cut = data.find(b" ", at + PIECE)
            cut = len(data) + 1 if cut < 0 else cut
            own = tail + data[at:cut].split()
            rows.append(row)
            parts.append(own)
            repeated.append(len(tail))
            held += len(own)
            at, tail = cut, own[1 - LONGEST:]
            if held >= AT_ONCE:
                yield rows, parts, repeated
                rows, parts, repeated, held = [], [], [], 0
    if parts:
        yield rows, parts, repeated


def _features(texts: list[str | None], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of all runs of the texts, each run once."""
    for rows, parts, repeated in _groups(texts):
        row, skip = np.array(rows), np.array(repeated)
        for part, last, crc in run_crcs(parts):
            new = last >= skip[part]
            yield row[part[new]], crc[new] % np.uint32(buckets)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the runs of all texts; buckets that none falls into are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, bucket in _features(batch.column("text").to_pylist(), buckets):
                seen += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(seen[used])], ["bucket", "n"])

    small_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """A bucket's log ratio of smoothed shares in target and corpus, in thousandths, rounded down."""
    s_all, t_all = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    return [
        math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((corpus.get(b, 0) + 1.0) * t_all))) for b in range(buckets)
    ]


def weighed(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, names: tuple[str, str, str] = ("n_words", "n_features", "weight")) -> DataFrame:
    """docs with its words, the runs in them, and the sum of their gains towards target (a table with a column text).

    Null and empty texts have no words, no runs and weight 0.  Equal rows weigh alike.  An empty target or an empty table
    of docs is smoothed like any other.  The driver holds two counts for each bucket.
    """
    small_batches(docs.sparkSession)
    corpus, wanted = ({r["bucket"]: r["n"] for r in bucket_counts(x, buckets).collect()} for x in (docs, target))
    shared = docs.sparkSession.sparkContext.broadcast(np.array(gains(corpus, wanted, buckets), dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            first, features, weight = (np.zeros(n, dtype=np.int64) for _ in range(3))
            texts = batch.column("text").to_pylist()
            for rows, parts, repeated in _groups(texts):
                row, skip = np.array(rows), np.array(repeated)
                for k, (part, last, crc) in enumerate(run_crcs(parts)):
                    new = last >= skip[part]
                    at = row[part[new]]
                    found = np.bincount(at, minlength=n)
                    features += found
                    first += found * (k == 0)
                    # Whole numbers below 2^53: sums of doubles are exact.
                    weight += np.bincount(at, weights=shared.value[crc[new] % np.uint32(buckets)], minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x) for x in (first, features, weight))], [*batch.schema.names, *names])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(name, LongType()) for name in names)]))


def noise(doc_id, seed: int = 42):
    """Gumbel noise of an id, in thousandths, rounded down; ids are told apart by SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(rows: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """rows (doc_id, n_words, n_features, weight and any others) with score and rank: 1, 2, 3, ... for the highest scores,
    floor(percent x N / 100) of the N rows with least_words words or more; null for all others.

    Ties go to the smaller doc_id, null ids last; then to fewer runs, then by the rows' place in the table.
    """
    rid, = unused(rows, "rid")
    scored = rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn(rid, F.monotonically_increasing_id())
    scored = written(scored, "scored")
    fit = scored.filter(F.col("n_words") >= least_words)
    most = fit.count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col(rid)]
    placed = ranked(fit.drop("rank"), *order)
    drawn = placed.withColumn("rank", F.when(F.col("rank") < most, F.col("rank") + 1))
    rest = scored.filter(~(F.coalesce(F.col("n_words"), F.lit(0)) >= least_words)).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).drop(rid)


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = BUCKETS, seed: int = 42) -> DataFrame:
    """The rows of docs that are drawn, with all their columns.

    Rows are numbered and written once; texts are shuffled once, to meet the numbers drawn.
    """
    rid, *names = unused(docs, "rid", "n_words", "n_features", "weight")
    rows = written(weighed(docs, target, buckets, tuple(names)).withColumn(rid, F.monotonically_increasing_id()), "weighed")
    light = rows.select("doc_id", *[F.col(c).alias(n) for c, n in zip(names, ("n_words", "n_features", "weight"))], F.col(rid).alias("own"))
    keep = written(draw(light, percent, least_words, seed).filter("rank IS NOT NULL").select(F.col("own").alias(rid)), "drawn")
    return rows.join(keep.hint("merge"), rid, "left_semi").select(*docs.columns)
