"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above.

Every line of a file, groups of neighbouring lines and the file as a whole are
compared with the templates, in the space of the templates' words and one
dimension more for each other word; the file as a whole also with full licence
texts.  A file without a licence of its own has that of the nearest ancestor
directory with a licence file; directories are resolved once each, by joins on
their paths.
"""

from __future__ import annotations

import math
import pkgutil
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TO_LOWER, checkpointed, small_batches

#: Licence ids and notices by which they are given (fixed values).
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright; dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved. No part may be reproduced without written permission."),
]
#: Notices that also stand beside licences: they count only where nothing else is found.
BARE = [
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright (c) All rights reserved."),
]
#: Files of licence_texts, compared with whole files only.
FULL = [
    "MIT", "Apache-2.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "BSD-3-Clause", "BSD-2-Clause",
    "MPL-1.1", "MPL-2.0", "ISC", "CC0-1.0", "Unlicense",
]
#: Names of licence files, without their endings (fixed values).
FILE_NAMES = ("license", "licence", "copying", "notice", "unlicense")
LEAST = 0.75  # cosine of a line or a file with a template
_KEEP = bytes(i if chr(i).isalnum() or i >= 128 or i in b"-.\n" else 32 for i in range(256))
_TABLE = bytes(_KEEP[b] for b in TO_LOWER)


def tokens(line: bytes) -> list[bytes]:
    """Lower-case words of letters, digits, hyphens and inner dots."""
    return [w for w in (x.strip(b".-") for x in line.split()) if w]


def cleaned(text: str | None) -> bytes:
    return (text or "").encode().translate(_TABLE)


def full_texts() -> list[tuple[str, str]]:
    """Licence ids and whole texts."""
    texts = [(name, pkgutil.get_data(__package__, f"licence_texts/{name}.txt").decode()) for name in FULL]
    # The two differ in their names and one section.
    affero = dict(texts)["GPL-3.0"].replace("GNU GENERAL PUBLIC", "GNU AFFERO GENERAL PUBLIC").replace("GNU General Public", "GNU Affero General Public")
    return [*texts, ("AGPL-3.0", affero)]


class Scanner:
    """Templates as unit vectors; finds the closest for a bag of words."""

    def __init__(
        self, templates: list[tuple[str, str]], rows: int, df: dict[bytes, int], least: float,
        bare: list[tuple[str, str]] = (), full: list[tuple[str, str]] = (),
    ):
        self.bare = Scanner(bare, rows, df, least) if bare else None
        self.full = Scanner(full, rows, df, least) if full else None
        self.names = [name for name, _ in templates]
        bags = [Counter(tokens(cleaned(text))) for _, text in templates]
        self.idf = {w: math.log((rows + 1) / (df.get(w, 0) + 1)) + 1 for bag in bags for w in bag}
        self.other = sum(self.idf.values()) / max(1, len(self.idf))  # of a word that no template has
        self.least = least
        self.at: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        self.needed: set[bytes] = set()
        self.rare: set[bytes] = set()  # the same without the commonest words
        self.heavy: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        self.margin: list[float] = []
        for t, bag in enumerate(bags):
            norm = math.sqrt(sum((n * self.idf[w]) ** 2 for w, n in bag.items())) or 1.0
            weights = sorted(((n * self.idf[w] / norm, w) for w, n in bag.items()), reverse=True)
            # Heavy words h, light ones with weights r in all, other words o: a cosine is at most sqrt(r^2 + h^2 / o^2).
            light = 1.0
            for weight, w in weights:
                if light <= least * least / 2:
                    break
                self.heavy[w].append((t, weight * self.idf[w]))
                light -= weight * weight
            self.margin.append(least * least - max(0.0, light))
            rest = 1.0
            for weight, w in weights:
                self.at[w].append((t, weight))
                # Whatever has none of the heavier words has a cosine below sqrt(rest), so below the least.
                if rest >= least * least:
                    self.needed.add(w)
                rest -= weight * weight
            rest = 0.0
            for _, weight, w in sorted((self.idf[w], weight, w) for weight, w in weights):
                rest += weight * weight
                if rest >= least * least:
                    self.rare.add(w)

    def best(self, bag: Counter) -> tuple[float, int]:
        """(cosine, template) of the closest template; the first one among equals."""
        idf, other = self.idf, self.other
        norm = math.sqrt(sum((n * idf.get(w, other)) ** 2 for w, n in bag.items()))
        dots: dict[int, float] = defaultdict(float)
        for w in bag:
            for t, weight in self.at.get(w, ()):
                dots[t] += weight * bag[w] * idf[w]
        if not dots:
            return 0.0, -1
        t = min(dots, key=lambda i: (-round(dots[i], 12), i))
        return dots[t] / norm, t

    def closest(self, bags: list[Counter]) -> tuple[float, int, int | None]:
        """(cosine, template, line): the closest line, else group of neighbouring lines, by its first line."""
        best = (0.0, -1, None)
        hit = [not self.needed.isdisjoint(bag) for bag in bags]
        for i, bag in enumerate(bags):
            if hit[i]:
                score, t = self.best(bag)
                if score > best[0] + 1e-12:
                    best = (score, t, i)
        filled = [i for i, bag in enumerate(bags) if bag]
        # How heavy other words may be in a group that starts at a line and reaches `least`, by the heavy words behind it.
        ahead: dict[int, float] = defaultdict(float)
        limits, limit = [0.0] * len(filled), 0.0
        for at in reversed(range(len(filled))):
            for w in bags[filled[at]].keys() & self.heavy.keys():
                for t, weight in self.heavy[w]:
                    ahead[t] += weight * bags[filled[at]][w]
                    limit = max(limit, ahead[t] ** 2 / self.margin[t])
            limits[at] = limit * (1 + 1e-9)
        for at, i in enumerate(filled):
            # Without its first line, if that has no word of a template, a group is closer.
            if limits[at] == 0.0 or self.at.keys().isdisjoint(bags[i]):
                continue
            group: Counter = Counter()
            dots: dict[int, float] = defaultdict(float)
            norm = others = 0.0
            needed = False
            for to in range(at, len(filled)):
                line = filled[to]
                for w, n in bags[line].items():
                    more = (2 * group[w] + n) * n
                    group[w] += n
                    idf = self.idf.get(w)
                    if idf is None:
                        norm += more * self.other ** 2
                        others += more * self.other ** 2
                    else:
                        norm += more * idf * idf
                        for t, weight in self.at[w]:
                            dots[t] += weight * n * idf
                if others > limits[at]:
                    break
                needed = needed or hit[line]
                if needed and to > at:
                    t = min(dots, key=lambda k: (-round(dots[k], 12), k))
                    score = dots[t] / math.sqrt(norm)
                    if score > best[0] + 1e-12:
                        best = (score, t, i)
        return best

    def scan(self, text: str | None) -> tuple[str | None, float, int | None, float]:
        """(licence, cosine, line, cosine of the whole text): the closest line, group of lines (its first line) or the
        whole text (line null).  A full licence text goes before notices in it, bare notices come last."""
        data = cleaned(text)
        words = {w.strip(b".-") for w in set(data.split())}
        notice = not self.needed.isdisjoint(words)
        bare = self.bare is not None and not self.bare.needed.isdisjoint(words)
        whole_text = self.full is not None and not self.full.rare.isdisjoint(words)
        if not (notice or bare or whole_text):
            return None, 0.0, None, 0.0
        bags = [Counter(tokens(line)) for line in data.split(b"\n")] if notice or bare else []
        total = Counter(tokens(data))
        whole, t = self.best(total) if notice else (0.0, -1)
        full = 0.0
        if whole_text:
            full, f = self.full.best(total)
            if full >= self.least and full > whole:
                return self.full.names[f], full, None, full
        best = self.closest(bags) if notice else (0.0, -1, None)
        if whole > best[0] + 1e-12:
            best = (whole, t, None)
        whole = max(whole, full)
        if best[0] >= self.least:
            return self.names[best[1]], best[0], best[2], whole
        if bare:
            own = self.bare.closest(bags)
            if own[0] >= self.least:
                return self.bare.names[own[1]], own[0], own[2], max(whole, self.bare.best(total)[0])
            best = max(best, own, key=lambda x: x[0])
        return None, max(best[0], full), None, whole


def document_counts(files: DataFrame, templates: list[tuple[str, str]]) -> tuple[int, dict[bytes, int]]:
    """Rows, and for each word of the templates the rows that have it."""
    vocabulary = {w for _, text in templates for w in tokens(cleaned(text))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        n = 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                n += 1
                words = set(cleaned(text).split())
                seen.update(vocabulary.intersection(w.strip(b".-") for w in words))
        yield pa.RecordBatch.from_arrays([pa.array([None, *(w.decode() for w in seen)], pa.string()), pa.array([n, *seen.values()], pa.int64())], ["word", "n"])

    small_batches(files.sparkSession)
    rows = files.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # the templates' words
    counts = {r["word"]: r["n"] for r in rows}
    return counts.pop(None, 0), {w.encode(): n for w, n in counts.items()}


def own_licences(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(path, licence, score, line, whole_score) for every row: the closest template among the file's lines, groups of
    neighbouring lines and the file itself; licence is null below `least`.  Full licence texts and BARE notices are
    compared with the file too.

    line counts from 0, null for the file as a whole; of a group of lines it is the first.  Null and empty texts have no licence and score 0.  The first of
    equally close lines and templates wins.  Rows with equal paths give a row each.  Other columns are ignored.
    """
    full = full_texts()
    rows, df = document_counts(files, [*templates, *BARE, *full])
    shared = files.sparkSession.sparkContext.broadcast(Scanner(templates, rows, df, least, BARE, full))  # the templates' words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in batches:
            found = list(zip(*(scanner.scan(t) for t in batch.column("text").to_pylist()))) or [()] * 4
            kinds = (pa.string(), pa.float64(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("path"), *(pa.array(c, k) for c, k in zip(found, kinds))], ["path", "licence", "score", "line", "whole_score"])

    return files.select("path", "text").mapInArrow(run, "path string, licence string, score double, line int, whole_score double")


def directory(path):
    """The part before the last slash, '' at the top, null for null."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), "")


def with_inherited(found: DataFrame, least_file: float = LEAST) -> DataFrame:
    """found (path, licence, whole_score, ...) with effective (own licence, or the inherited one) and inherited_from.

    A licence file is one with a licence and either a name like LICENSE or COPYING, or a text that is close to a template
    as a whole; it speaks for its directory and those below that have none nearer.  The first of a directory's files
    by path wins, then the closest, then by licence.  A null path has no directory, so it inherits nothing.
    """
    base = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    named = reduce(lambda a, b: a | b, [base.startswith(n) for n in FILE_NAMES])
    files = found.filter(F.col("licence").isNotNull() & F.col("path").isNotNull() & (named | (F.col("whole_score") >= least_file)))
    speaks = files.groupBy(directory(F.col("path")).alias("above")).agg(
        F.min(F.struct("path", (-F.col("whole_score")).alias("s"), "licence")).alias("m")
    ).select("above", F.col("m.licence").alias("from_licence"), F.col("m.path").alias("from_path"))
    # Each directory once, with all its ancestors: as many rows as its path is deep.
    dirs = found.filter("path IS NOT NULL").select(directory(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(parts))
    above = dirs.select("dir", F.explode(F.sequence(F.lit(0), depth)).alias("depth"))
    above = above.withColumn("above", F.when(F.col("depth") > 0, F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/")).otherwise(""))
    nearest = above.join(speaks, "above").groupBy("dir").agg(F.max_by(F.struct("from_licence", "from_path"), "depth").alias("m"))
    nearest = checkpointed(nearest.select("dir", "m.from_licence", "m.from_path"))
    met = found.withColumn("dir", directory(F.col("path"))).join(nearest, "dir", "left")
    return met.select(
        *found.columns, F.coalesce("licence", "from_licence").alias("effective"),
        F.when(F.col("licence").isNull(), F.col("from_path")).alias("inherited_from"),
    )
