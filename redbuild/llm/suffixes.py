"""Removal of repeated byte strings, decided in suffix arrays.

The suffix array is built by grouping: suffixes are grouped by their Lyndon
prefixes, groups being refined from the highest down by pointers to the
previous suffix of a lower group, and are then emitted group by group in one
pass, with no renaming or recursion.

To meet, equal strings must come to one task.  Every window of `length` bytes
has an anchor, the first of its 32-byte pieces with the least hash, so equal
windows have equal anchors.  All windows in a row with one anchor make a
context.  Contexts are dealt out by their anchors' hashes: of equal contexts
all but the earliest are repeats as they are; different contexts of one anchor
go into a suffix array, where equal windows stand side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, slices, written

PIECE = 32
SEGMENT = 2_000_000  # bytes hashed at once
BLOCK = 10_000  # bytes of a suffix array, unless a single group is larger: its lists then stay in the processor's cache
BLOCKS = 64  # whose spans are passed on together
RUN = 256  # windows of a context
GROUP = 1_000_000  # bytes of one; windows of a larger group are told apart one by one
_RANDOM = np.random.default_rng(20)
TABLES = _RANDOM.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))  # odd, so they have inverses


def suffix_array(s: list[int]) -> list[int]:
    """Starts of all suffixes in rising order, for symbols above 0; a suffix that is a prefix of another comes first."""
    n = len(s) + 1  # the end, below all symbols, is a suffix too
    s = [*s, 0]
    order = sorted(range(n), key=s.__getitem__)
    place, group, size, before = [0] * n, [0] * n, [0] * n, [-1] * n
    start = 0
    for at, i in enumerate(order):
        if at and s[i] != s[order[at - 1]]:
            start = at
        place[i], group[i] = at, start
        size[start] += 1
    end = n - 1
    while end > 0:
        start = group[order[end]]
        counts: dict[int, int] = {}
        once = True
        for i in sorted(order[start:end + 1]) if start < end else (order[end],):
            # The previous suffix of a lower group; what lies between is in this group or in a higher one.
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[i] = p
            # A group of one has nothing to be told apart from.
            if p >= 0 and size[group[p]] > 1:
                if p in counts:
                    counts[p] += 1
                    once = False
                else:
                    counts[p] = 1
        rounds = [list(counts)]
        if not once:
            levels: dict[int, list[int]] = {}
            for p, c in counts.items():
                levels.setdefault(c, []).append(p)
            rounds = [levels[c] for c in sorted(levels, reverse=True)]
        for found in rounds:
            # Those followed equally often by this group's prefix leave their groups for new ones right behind.
            for p in found:
                g = group[p]
                size[g] = left = size[g] - 1
                to, at = g + left, place[p]
                if at != to:
                    other = order[to]
                    order[at], place[other] = other, at
                    order[to], place[p] = p, to
            for p, new in zip(found, [group[p] + size[group[p]] for p in found]):
                group[p] = new
                size[new] += 1
        end = start - 1
    used = [0] * n
    placed = bytearray(n)
    order[0] = n - 1
    placed[n - 1] = 1
    for at in range(n):
        p = order[at] - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            order[g + used[g]] = p
            used[g] += 1
            placed[p] = 1
            p = before[p]
    return order[1:]


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    base = BASES[which]
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    up, down = np.full(n, base), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    return x ^ x >> np.uint64(29)


class Hashes:
    """Hashes of the substrings of a byte string, equal for equal ones wherever they stand."""

    def __init__(self, data: np.ndarray, which: int):
        up, self.down = _powers(len(data) + 1, which)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(TABLES[which][data] * up[:-1])])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def pieces(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return _mixed((self.sums[length:] - self.sums[:n]) * self.down[:n])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` values in a row."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:len(x) - (width - span)], x[width - span:]) if width > span else x


def _most(x: np.ndarray, width: int) -> np.ndarray:
    return ~_least(~x, width)


def contexts(data: np.ndarray, length: int, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, hash, start, windows, folded) of all contexts: runs of valid windows with one anchor, RUN at most.

    folded marks those that may hold one window twice, as the anchor stands in them more than once.
    """
    none = tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    if len(data) < length or not valid.any():
        return none
    pieces = Hashes(data, 0).pieces(PIECE)
    width = length - PIECE + 1
    least = _least(pieces, width)
    at = np.flatnonzero(valid)
    anchors = least[at]
    new = np.r_[True, (anchors[1:] != anchors[:-1]) | (at[1:] != at[:-1] + 1)]
    first = np.flatnonzero(new)
    new[np.flatnonzero((np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))) % RUN == 0)] = True
    first = np.flatnonzero(new)
    starts, windows = at[first], np.diff(np.r_[first, len(at)])
    # Pieces that are the least of a window, and those among them that come again soon.
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    chosen = np.flatnonzero(_most(padded, width) == pieces)
    values, again = pieces[chosen], np.zeros(len(chosen), dtype=np.int64)
    for step in range(1, min(16, len(chosen))):
        again[:-step] |= (values[:-step] == values[step:]) & (chosen[step:] - chosen[:-step] < length)
    sums = np.concatenate([[0], np.cumsum(again)])
    ends = starts + windows + length - 1
    folded = sums[np.searchsorted(chosen, ends - PIECE + 1)] > sums[np.searchsorted(chosen, starts)]
    return anchors[first].view(np.int64), Hashes(data, 1).of(starts, ends).view(np.int64), starts, windows, folded | (windows > width)


#: kind 0: a context, at = start << 16 | windows << 1 | folded; 1: a span to remove, from key to at; 2: a context to
#: look at, like 0; 3: a window, by two hashes, at = start << 16 | 1 << 1.
ROW = "kind int, key long, hash long, doc long, at long"
NAMES = ["kind", "key", "hash", "doc", "at"]


def _rows(kind: int, *columns) -> pa.RecordBatch:
    columns = [np.ascontiguousarray(c, dtype=np.int64) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *map(pa.array, columns)], NAMES)


def _spans(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """Spans, joined where they meet."""
    order = np.lexsort((starts, docs))
    docs, starts, ends = docs[order], starts[order], ends[order]
    if len(docs):
        # All contexts of a document have rising ends, so a span ends where the next one begins behind it.
        head = np.r_[True, (docs[1:] != docs[:-1]) | (starts[1:] > ends[:-1])]
        cut = np.flatnonzero(head)
        docs, starts, ends = docs[cut], starts[cut], np.maximum.reduceat(ends, cut)
    return _rows(1, starts, np.zeros(len(docs)), docs, ends)


def _scanner(length: int):
    def flush(texts: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        """texts: (doc, first byte's place in it, bytes)."""
        data = np.frombuffer(b"".join(t for _, _, t in texts), dtype=np.uint8)
        sizes = np.array([len(t) for _, _, t in texts])
        begins = np.cumsum(sizes) - sizes
        valid = np.zeros(max(0, len(data) - length + 1), dtype=bool)
        for b, n in zip(begins, sizes):
            valid[b:b + n - length + 1] = True
        anchor, h, starts, windows, folded = contexts(data, length, valid)
        if not len(starts):
            return
        owner = np.searchsorted(begins, starts, side="right") - 1
        docs = np.array([d for d, _, _ in texts], dtype=np.int64)[owner]
        starts = starts - begins[owner] + np.array([p for _, p, _ in texts], dtype=np.int64)[owner]
        order = np.lexsort((starts, docs, h, anchor))
        anchor, h, docs, starts, windows, folded = (x[order] for x in (anchor, h, docs, starts, windows, folded))
        first = np.r_[True, (anchor[1:] != anchor[:-1]) | (h[1:] != h[:-1])]
        yield _rows(0, anchor[first], h[first], docs[first], starts[first] << 16 | windows[first] << 1 | folded[first])
        # An equal context comes earlier even here, so these need not meet any others.
        rest = ~first
        yield _spans(docs[rest], starts[rest], starts[rest] + windows[rest] + length - 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column("_doc").to_pylist(), batch.column("text").to_pylist()):
                data = (text or "").encode()
                for at in range(0, max(0, len(data) - length + 1), SEGMENT):
                    held.append((doc, at, data[at:at + SEGMENT + length - 1]))
                    size += len(held[-1][2])
                    if size >= SEGMENT:
                        yield from flush(held)
                        held, size = [], 0
        if held:
            yield from flush(held)

    return scan


def _met(length: int):
    """Rows in the order of kind, key, hash, doc and at: repeats become spans; contexts whose anchors others share, or
    that are folded, are to be looked at."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, alone = None, None  # the row before; a context that is the only one of its anchor so far
        for batch in batches:
            kind, key, h, doc, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in NAMES)
            if (spans := kind == 1).any():
                yield _rows(1, key[spans], h[spans], doc[spans], at[spans])
            kind, key, h, doc, at = (x[~spans] for x in (kind, key, h, doc, at))
            if not len(key):
                continue
            same_key, same = np.r_[False, key[1:] == key[:-1]], np.r_[False, (key[1:] == key[:-1]) & (h[1:] == h[:-1])]
            if last is not None:
                same_key[0] = key[0] == last[0]
                same[0] = same_key[0] and h[0] == last[1]
            if same.any():
                starts = at[same] >> 16
                yield _spans(doc[same], starts, starts + (at[same] >> 1 & 0x7FFF) + length - 1)
            # Different contexts: to be looked at if there are more of the key.
            i = np.flatnonzero(~same & (kind == 0))
            k, d, a = key[i], doc[i], at[i]
            more = np.zeros(len(i), dtype=bool)
            joined = same_key[i]
            more[joined] = True
            more[np.flatnonzero(joined[1:] & ~joined[:-1])] = True  # the first of a key with others behind it
            more |= (a & 1).astype(bool)
            if alone is not None and len(i) and joined[0]:
                yield _rows(2, [alone[0]], [0], [alone[1]], [alone[2]])
            yield _rows(2, k[more], np.zeros(more.sum()), d[more], a[more])
            if len(i):
                alone = None if more[-1] else (k[-1], d[-1], a[-1])
            last = (key[-1], h[-1])

    return run


def _cutter(length: int):
    """From (doc, text, wanted): the bytes of the contexts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("_doc", "text", "wanted"))):
                data = text.encode()
                for w in wanted:
                    start = w["at"] >> 16
                    out.append((w["key"], doc, start, data[start:start + (w["at"] >> 1 & 0x7FFF) + length - 1]))
            keys, docs, starts, parts = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(parts, pa.binary())],
                ["key", "doc", "start", "part"],
            )

    return run


def repeats(parts: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of all windows in parts (doc, start, bytes) that also stand earlier in them, by a suffix array."""
    text = b"".join(p for _, _, p in parts)
    # Any order of the bytes puts equal windows side by side; with the rare ones lowest, fewer suffixes change groups.
    values = np.frombuffer(text, np.uint8)
    counts = np.bincount(values, minlength=256)
    symbol = np.empty(256, dtype=np.int64)
    symbol[np.argsort(counts, kind="stable")] = np.arange(1, 257)
    order = np.array(suffix_array(symbol[values].tolist()), dtype=np.int64)
    sizes = np.array([len(p) for _, _, p in parts])
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(parts)), sizes)
    whole = np.arange(len(text)) + length <= np.repeat(begins + sizes, sizes)
    order = order[whole[order]]  # windows, in the order of their symbols: equal ones stand side by side
    views = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), length)
    equal = np.zeros(len(order), dtype=bool)
    for at in range(1, len(order), 65_536):
        i = np.arange(at, min(at + 65_536, len(order)))
        equal[i] = (views[order[i]] == views[order[i - 1]]).all(axis=1)
    run = np.cumsum(~equal)
    own = owner[order]
    docs = np.array([d for d, _, _ in parts], dtype=np.int64)[own]
    starts = order - begins[own] + np.array([s for _, s, _ in parts], dtype=np.int64)[own]
    sort = np.lexsort((starts, docs, run))
    run, docs, starts = run[sort], docs[sort], starts[sort]
    # The same place may be in two contexts at once; it isn't its own repeat.
    again = np.r_[False, run[1:] == run[:-1]]
    head = np.maximum.accumulate(np.where(again, 0, np.arange(len(run))))
    again &= (docs != docs[head]) | (starts != starts[head])
    return docs[again], starts[again]


def _sorter(length: int):
    """Contexts in the order of their anchors: spans of what is repeated among them; windows of groups that are too large."""
    def passed_on(found) -> pa.RecordBatch:
        docs, starts = (np.concatenate(x) for x in zip(*found))
        return _spans(docs, starts, starts + length)

    def windows(parts) -> Iterator[pa.RecordBatch]:
        for doc, start, part in parts:
            data = np.frombuffer(part, np.uint8)
            i = np.arange(len(data) - length + 1)
            hashes = [Hashes(data, k).of(i, i + length).view(np.int64) for k in (0, 1)]
            yield _rows(3, *hashes, np.full(len(i), doc), (i + start) << 16 | 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, block, size, group, own, key, large = [], [], 0, [], 0, None, False
        for batch in batches:
            for k, doc, start, part in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "start", "part"))):
                if k != key:
                    block += group
                    size += own
                    if size >= BLOCK:
                        found.append(repeats(block, length))
                        block, size = [], 0
                        if len(found) == BLOCKS:
                            yield passed_on(found)
                            found = []
                    group, own, key, large = [], 0, k, False
                group.append((doc, start, part))
                own += len(part)
                if large or own > GROUP:
                    large = True
                    yield from windows(group)
                    group, own = [], 0
        block += group
        if block:
            found.append(repeats(block, length))
        if found:
            yield passed_on(found)

    return run


def repeated_spans(rows: DataFrame, length: int = 100) -> DataFrame:
    """(doc, spans) for rows (_doc, text) with different _doc: spans to remove, arrays of start and end."""
    spark = rows.sparkSession
    small_batches(spark)
    n = slices(spark)
    order = ["kind", "key", "hash", "doc", "at"]
    scanned = rows.mapInArrow(_scanner(length), ROW)
    # Spans are sent about by where they are, contexts by their anchors.
    to = F.when(F.col("kind") == 1, F.xxhash64("doc", "key")).otherwise(F.col("key"))
    met = written(scanned.repartition(n, to).sortWithinPartitions(*order).mapInArrow(_met(length), ROW), "met")
    wanted = met.filter("kind = 2").groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("key", "at")).alias("wanted"))
    parts = rows.join(wanted, "_doc").mapInArrow(_cutter(length), "key long, doc long, start long, part binary")
    sorted_ = parts.repartition(n, "key").sortWithinPartitions("key", "doc", "start").mapInArrow(_sorter(length), ROW)
    looked = written(sorted_, "looked")
    windows = looked.filter("kind = 3")
    spans = met.filter("kind = 1").unionByName(looked.filter("kind = 1"))
    if windows.head(1):
        told = windows.repartition(n, "key", "hash").sortWithinPartitions(*order).mapInArrow(_met(length), ROW)
        spans = spans.unionByName(told.filter("kind = 1"))
    span = F.struct(F.col("key").alias("start"), F.col("at").alias("end"))
    return spans.groupBy("doc").agg(F.collect_list(span).alias("spans"))


def _remover(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                data, kept, at, removed, runs, end = (text or "").encode(), [], 0, 0, 0, -1
                for start, stop in sorted((s["start"], s["end"]) for s in spans or ()):
                    if start > end:
                        runs += 1
                        kept.append(data[at:start])
                    end = max(end, stop)
                    at = end
                kept.append(data[at:])
                left = b"".join(kept)
                out.append((doc_id, len(data), len(data) - len(left), runs, left))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row: kept has the bytes of the text that are not covered by a
    string of `length` bytes that also starts earlier, in a document of a smaller doc_id or before in the same one.

    All is judged on the input, and strings don't cross documents.  Null and empty texts have no bytes.  Null ids come
    first, and rows with equal ids follow each other by their texts' hashes, each a document of its own.  Only doc_id
    and text are used.  kept may end within a character.  An empty table gives no rows.
    """
    rows = docs.select("doc_id", "text")
    if rows.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").head(1):
        from .common import ranked

        rows = ranked(rows, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).withColumnRenamed("rank", "_doc")
    else:
        rows = rows.withColumn("_doc", F.col("doc_id"))
    spans = repeated_spans(rows.select("_doc", "text"), length).withColumnRenamed("doc", "_doc")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    return rows.join(spans, "_doc", "left").select("doc_id", "text", "spans").mapInArrow(
        _remover(names), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )
