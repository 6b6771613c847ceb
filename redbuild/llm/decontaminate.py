"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items, as sequences of normalised words, go into one automaton (in blocks
of bounded size if there are many).  A document's words then run through it;
the state's length at each word is the longest suffix that stands in an item,
so a run of at least `window` words, or a whole shorter item, is a hit.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TO_LOWER, small_batches, unused, written

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: j for i, j in enumerate(TO_LOWER) if i != j}
BLOCK_WORDS = 200_000  # words of test items in one automaton: a hundred MB at most
SCHEMA = "row long, doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>"


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


class Automaton:
    """Suffix automaton of several word sequences; states are numbers, 0 is the root."""

    def __init__(self, items: list[tuple[str | None, list[str]]], window: int):
        self.window = window
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, item in items:
            last = 0
            for word in item:
                last = self._extend(last, word)
        self.items_at: dict[int, set[str]] = {}
        shorts: dict[int, int] = {}
        for name, item in items:
            state, at = 0, 0
            for word in item:
                state, at = self.step(state, at, word)
                if at >= window:
                    self.items_at.setdefault(self._cut(state, window), set()).add(name)
            if 0 < len(item) < window:
                state = self._cut(state, len(item))
                self.items_at.setdefault(state, set()).add(name)
                shorts[state] = len(item)
        # For each state the states of whole short items among its suffixes, longest first.
        self.shorts: list[tuple[int, ...]] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.shorts[state] = ((state,) if state in shorts else ()) + self.shorts[self.link[state]]
        self.short_length = shorts

    def _extend(self, last: int, word: str) -> int:
        nxt, link, length = self.next, self.link, self.length
        if word in nxt[last]:
            q = nxt[last][word]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, word, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and word not in nxt[p]:
            nxt[p][word] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][word]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return cur

    def _clone(self, p: int, word: str, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def step(self, state: int, at: int, word: str) -> tuple[int, int]:
        """State and matched length after one more word."""
        while state and word not in self.next[state]:
            state = self.link[state]
            at = self.length[state]
        to = self.next[state].get(word)
        return (0, 0) if to is None else (to, at + 1)

    def _cut(self, state: int, length: int) -> int:
        """The state of the last `length` matched words."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def scan(self, tokens: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint hit runs [start, end) of words, rising, and the items that they come from."""
        root, step, window = self.next[0], self.step, self.window
        state = at = 0
        runs: list[list[int]] = []
        found: set[int] = set()
        for i, word in enumerate(tokens):
            if not state:
                if word not in root:
                    continue
                state, at = root[word], 1
            else:
                state, at = step(state, at, word)
                if not state:
                    continue
            long = 0
            if at >= window:
                found.add(self._cut(state, window))
                long = window
            for s in self.shorts[state]:
                if (n := self.short_length[s]) <= at:
                    found.add(s)
                    long = max(long, n)
            if long:
                start = i + 1 - long
                while runs and runs[-1][1] >= start:
                    start = min(start, runs.pop()[0])
                runs.append([start, i + 1])
        return [tuple(r) for r in runs], set().union(*(self.items_at[s] for s in found))


def item_blocks(benchmark: DataFrame, block_words: int) -> list[list[tuple[str | None, list[str]]]]:
    """The items in blocks of bounded size: a block is all that an automaton, and so a task, ever holds."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    blocks, size = [[]], 0
    for row in rows.orderBy("item_id", "text").toLocalIterator():  # the stated query set
        item = words(row["text"])
        if size and size + len(item) > block_words:
            blocks.append([])
            size = 0
        blocks[-1].append((row["item_id"], item))
        size += len(item)
    return blocks


_BUILT: dict[object, Automaton] = {}


def _scanner(shared, key: str, window: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _BUILT:
            _BUILT.clear()  # one at a time
            _BUILT[key] = Automaton(shared.value, window)
        automaton = _BUILT[key]
        for batch in batches:
            n, starts, ends, items = [], [], [], []
            for text in batch.column("text").to_pylist():
                tokens = words(text)
                runs, names = automaton.scan(tokens)
                n.append(len(tokens))
                starts.append([a for a, _ in runs])
                ends.append([b for _, b in runs])
                items.append(sorted(names - {None}))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(starts, pa.list_(pa.int32())),
                 pa.array(ends, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                ["row", "doc_id", "n_words", "starts", "ends", "items"],
            )

    return scan


def _joined(runs):
    """Disjoint runs from sorted overlapping ones, within a row."""
    def add(acc, r):
        last = F.element_at(acc, -1)
        apart = (F.size(acc) == 0) | (F.try_element_at(acc, F.lit(-1))["b"] < r["a"])
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], r["b"]).alias("b"))))
        return F.when(apart, F.concat(acc, F.array(r))).otherwise(grown)

    return F.aggregate(runs, F.array().cast("array<struct<a:int,b:int>>"), add)


def _merged_runs(rows: DataFrame, blocks: list, window: int) -> DataFrame:
    """(row, doc_id, n_words, starts, ends, items) for rows (row, doc_id, text) with unique numbers, over all blocks."""
    parts = []
    for block in blocks:
        shared = rows.sparkSession.sparkContext.broadcast(block)  # at most block_words words and one item
        parts.append(rows.mapInArrow(_scanner(shared, uuid.uuid4().hex, window), SCHEMA))
    if len(parts) == 1:
        return parts[0]
    runs = F.arrays_zip(F.col("starts").alias("a"), F.col("ends").alias("b"))
    every = reduce(DataFrame.unionByName, [p.withColumn("r", runs) for p in parts])
    merged = every.groupBy("row", "doc_id", "n_words").agg(
        _joined(F.array_sort(F.flatten(F.collect_list("r")))).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    return merged.select("row", "doc_id", "n_words", F.col("r.a").alias("starts"), F.col("r.b").alias("ends"), "items")


def hit_runs(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each row of docs: doc_id, n_words, starts and ends (its disjoint hit runs, in words) and items (ids as strings).

    A null or empty text has no words and no hits.  An item of no words never occurs; the words of an item without id are
    hit like any other's, but items can't name it; items of one id count as one.  Equal rows give a row each, however
    many blocks there are: with several, rows are numbered and written once.  Other columns are ignored.  An empty
    benchmark hits nothing.
    """
    small_batches(docs.sparkSession)
    blocks = item_blocks(benchmark, block_words)
    rows = docs.select(F.lit(0).cast("long").alias("row"), "doc_id", "text")
    if len(blocks) > 1:
        rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    return _merged_runs(rows, blocks, window).drop("row")


def _without(batch: pa.RecordBatch, runs: list, most: float) -> pa.RecordBatch:
    """The rows of which at most `most` of the words are in runs, without these."""
    out, keep = [], []
    for text, own in zip(batch.column("text").to_pylist(), runs):
        spans = [m.span() for m in WORD.finditer((text or "").translate(LOWER))]
        keep.append(sum(b - a for a, b in own) <= most * len(spans))
        for a, b in reversed(own):
            text = text[:spans[a][0]] + text[spans[b - 1][1]:]
        out.append(text)
    at = batch.schema.get_field_index("text")
    new = batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))
    return new.filter(pa.array(keep, pa.bool_()))


def _cleaner(shared, key: str, window: int, most: float):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = Automaton(shared.value, window)
        for batch in batches:
            yield _without(batch, [_BUILT[key].scan(words(text))[0] for text in batch.column("text").to_pylist()], most)

    return clean


def _cutter(starts: str, ends: str, most: float):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [list(zip(a, b)) for a, b in zip(batch.column(starts).to_pylist(), batch.column(ends).to_pylist())]
            yield _without(batch.drop_columns([starts, ends]), runs, most)

    return cut


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, most: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the spans that stand in test items; a document goes if more than `most` of its words are hit.

    All columns are kept; n_chars, where there is one, follows the text.  Null and empty texts stay as they are.  Hits are
    those of the text as given, whatever the number of blocks: with several, rows are numbered and written once, and cut
    when all their runs are known.
    """
    small_batches(docs.sparkSession)
    blocks = item_blocks(benchmark, block_words)
    if len(blocks) == 1:
        shared = docs.sparkSession.sparkContext.broadcast(blocks[0])
        out = docs.mapInArrow(_cleaner(shared, uuid.uuid4().hex, window, most), docs.schema)
    else:
        row, starts, ends = unused(docs, "row", "starts", "ends")
        numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
        runs = _merged_runs(numbered.select(F.col(row).alias("row"), "doc_id", "text"), blocks, window)
        runs = runs.select(F.col("row").alias(row), F.col("starts").alias(starts), F.col("ends").alias(ends))
        out = numbered.join(runs, row).select(*docs.columns, starts, ends).mapInArrow(_cutter(starts, ends, most), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
