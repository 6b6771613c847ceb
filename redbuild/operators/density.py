"""Density clusters: the single-link tree of each group, condensed, and its most stable parts.

With one neighbour as the core, the mutual reachability of two points is their distance, so its minimum spanning tree is
that of the distances.  It grows by rounds of Boruvka: every component takes its shortest link out.  A pass over the vectors
finds the few shortest links of each point at once, in single precision with a slack and then exactly; rounds go on over
these as long as a component's shortest known link is no longer than what its points know of.  The next pass is for the
points whose links all lie within their component and that may still have a shorter one than it knows of.  What is known so
is exact, and equal links are told apart by their ids.  Groups of up to a block do all this in one task.  Vectors of larger
ones lie on shelves (neighbours.py), and points look only into metric cells within the reach of their links.

Links then merge components from the shortest up.  A part of at least `least` points that meets another such part ends
there, seen from above it splits off, as a cluster; its stability is the sum over its points of 1/distance at which they
leave it, less that at which it split off.  All of this is known when two parts meet, so a component is one row of sums,
and a group with too many links for a task goes through in bands of links, a task each.  Clusters that are stabler than all those inside them are
picked; one that split off below `epsilon` gives way to the nearest cluster around it that did so above, or else to the
outermost.  The whole group is no cluster.  Links of equal length are cut at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import cells as M
from . import neighbours as N

SMALL_GROUP = 16_384  # a tree of up to this many points is grown in one task
BAND_LINKS = 500_000  # links of a group that a task merges at once
WAYS = 8  # links that a point finds in a pass
LOOK_ROWS = 16_384  # rows that a task holds while it reads shelves
KNOWN_ROWS = 2_000_000  # links and points of a group that a task follows at once
PAIRS = 32_768  # pairs compared one by one at once
TILE = (512, 2_048)  # distances are computed in tiles that stay in the cache
LINK, WAY, POINT, LOOKS = range(4)  # a link of the tree; a known link of two components; what a point knows; one that must look


class Ways:
    """The shortest links of some points to points of other components, among those met so far; equal ones by id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, most: int = WAYS):
        self.ids, self.labels, self.vectors, self.most = ids, labels, vectors, most
        self.squares = (vectors * vectors).sum(axis=1)
        self.narrow = np.hstack([vectors * -2, np.ones((len(ids), 1))]).astype(np.float32)
        self.square = np.full((len(ids), most), np.inf)
        self.to, self.other = (np.repeat(x[:, None], most, axis=1) for x in (ids, labels))

    def meet(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        """The points in `rows` meet others, in order of their ids; nobody meets anybody twice."""
        squares = (vectors * vectors).sum(axis=1)
        top = max(self.squares[rows].max(initial=0.0), squares.max(initial=0.0))
        single = top < 1e30
        slack = 4e-7 * (vectors.shape[1] + 8) * top + M.ROUNDING
        other = np.hstack([vectors, squares[:, None]]).astype(np.float32) if single else None
        mine, theirs = self.labels, labels
        if labels.dtype == object:
            codes = np.unique(np.concatenate([mine, labels]), return_inverse=True)[1]
            mine, theirs = codes[:len(mine)], codes[len(mine):]
        room, hits = np.empty(TILE[0] * TILE[1], dtype=np.float32), np.zeros(TILE[0] * TILE[1], dtype=bool)
        for at in range(0, len(rows), TILE[0]):
            r = rows[at:at + TILE[0]]
            found, waiting = [], 0
            for first in range(0, len(ids), TILE[1]):
                c = slice(first, min(first + TILE[1], len(ids)))
                last, pairs = self.square[r, -1], None
                if single:
                    shape = (len(r), c.stop - first)
                    near = room[:shape[0] * shape[1]].reshape(shape)
                    np.matmul(self.narrow[r], other[c].T, out=near)
                    bound = np.minimum(last + slack - self.squares[r], 1e38).astype(np.float32)
                    open_ = np.flatnonzero(np.isinf(last))
                    if len(open_) and shape[1] > self.most:
                        known = np.where(mine[r[open_]][:, None] == theirs[c][None, :], np.float32(np.inf), near[open_])
                        bound[open_] = np.minimum(np.partition(known, self.most - 1, axis=1)[:, self.most - 1] + 2 * slack, 1e38)
                    hit = hits[:near.size].reshape(shape)
                    np.less_equal(near, bound[:, None], out=hit)
                    count = np.count_nonzero(hit)
                    if count > hit.size // 64:  # mostly within components
                        hit &= mine[r][:, None] != theirs[c][None, :]
                        count = np.count_nonzero(hit)
                    if count <= max(TILE[0], hit.size // 16):
                        # Eight at a time, as there are few.
                        hits[hit.size:-(-hit.size // 8) * 8] = False
                        eight = np.flatnonzero(hits[:-(-hit.size // 8) * 8].view(np.int64))
                        cells = (eight[:, None] * 8 + np.arange(8)).ravel()
                        pairs = np.divmod(cells[hits[cells]], shape[1])
                if pairs is None:
                    pairs = self._few(r, vectors[c], mine[r][:, None] == theirs[c][None, :])
                x, y = r[pairs[0]], first + pairs[1]
                apart = mine[x] != theirs[y]
                x, y = x[apart], y[apart]
                if not len(x):
                    continue
                value = np.concatenate([N.exact(self.vectors, vectors, x[i:i + PAIRS], y[i:i + PAIRS], "l2") for i in range(0, len(x), PAIRS)])
                keep = value <= self.square[x, -1]
                found.append((x[keep], value[keep], ids[y[keep]], labels[y[keep]]))
                waiting += len(found[-1][0])
                if waiting > 2 * len(r) or len(found) == 1 and np.isinf(last).any():
                    self._keep(found)
                    found, waiting = [], 0
            if waiting:
                self._keep(found)

    def _few(self, rows: np.ndarray, vectors: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of many that are equally near the first by id, which is their order."""
        _, values = next(N._tiles(self.vectors[rows], vectors, "l2"))
        values[within] = np.inf
        kth = min(self.most, values.shape[1]) - 1
        limit = np.partition(values, kth, axis=1)[:, kth, None]
        below, equal = values < limit, values == limit
        equal &= np.cumsum(equal, axis=1, dtype=np.int32) <= self.most - below.sum(axis=1, keepdims=True)
        return np.nonzero((below | equal) & np.isfinite(values))

    def _keep(self, found: list[tuple]) -> None:
        new, square, to, other = (np.concatenate(x) for x in zip(*found))
        rows = np.unique(new)
        r = np.concatenate([np.repeat(rows, self.most), new])
        square, to, other = (np.concatenate([x[rows].ravel(), y]) for x, y in ((self.square, square), (self.to, to), (self.other, other)))
        order = np.lexsort((_codes(to), square, r))
        r = r[order]
        best = order[np.arange(len(r)) - np.searchsorted(r, r) < self.most]
        for x, y in ((self.square, square), (self.to, to), (self.other, other)):
            x[rows] = y[best].reshape(len(rows), self.most)


def _codes(ids: np.ndarray) -> np.ndarray:
    """Numbers in the order of ids."""
    return np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids


def grown(ways: tuple, points: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rounds of Boruvka over what is known.

    ways: (label, other, square, a, b) of links between components, a < b; points: (label, square, a, b), no link of the
    point that is not among the ways is shorter.  Returns which ways are links of the tree, the points' labels, whether
    they must look, and the ways' labels and others.
    """
    x, y, square, a, b = ways
    names, codes = np.unique(np.concatenate([x, y, points[0]]), return_inverse=True)
    n = len(square)
    x, y, own = codes[:n], codes[n:2 * n], codes[2 * n:]
    square, a, b = np.concatenate([square, points[1]]), *(_codes(np.concatenate(e)) for e in ((a, points[2]), (b, points[3])))
    order = np.lexsort((b, a, square))
    differ = (square[order][1:] != square[order][:-1]) | (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(np.r_[0, differ])[:len(order)]
    at = np.flatnonzero(x != y)
    at = at[np.argsort(-rank[at], kind="stable")]  # of a component the last is the shortest
    bound = rank[n:]
    label, links, none = np.arange(len(names)), [], len(order)
    while True:
        limit, pick = np.full(len(names), none), np.full(len(names), -1)
        np.minimum.at(limit, label[own], bound)
        pick[label[x[at]]] = at
        best = np.where(pick >= 0, rank[:n][pick] if n else none, none)
        sure = np.flatnonzero((pick >= 0) & (best <= limit))
        if not len(sure):
            break
        links.append(pick[sure])
        label = N.joined(label, x[pick[sure]], y[pick[sure]])
        at = at[label[x[at]] != label[y[at]]]
    taken = np.concatenate(links) if links else np.zeros(0, dtype=np.int64)
    taken = taken[np.unique(rank[taken], return_index=True)[1]]
    own = label[own]
    looks = (bound < best[own]) & np.isfinite(points[1]) & (own != np.bincount(own, minlength=len(names)).argmax())
    return taken, names[own], looks, names[label[x]], names[label[y]]


def spanning_links(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, squared distance) of a minimum spanning tree, from < to."""
    ids = labels = np.arange(len(vectors))
    looks, known, tree = np.ones(len(ids), dtype=bool), [np.zeros(0, dtype=np.int64)] * 2 + [np.zeros(0)] + [np.zeros(0, dtype=np.int64)] * 2, []
    last, end = np.full(len(ids), np.inf), ids.copy()
    while looks.any():
        mine = np.flatnonzero(looks)
        found = Ways(mine, labels[mine], vectors[mine])
        found.meet(np.arange(len(mine)), ids, labels, vectors)
        r, k = np.nonzero(np.isfinite(found.square))
        one, two = mine[r], found.to[r, k]
        fresh = (labels[one], found.other[r, k], found.square[r, k], np.minimum(one, two), np.maximum(one, two))
        known = [np.concatenate(e) for e in zip(known, fresh)]
        last[mine], end[mine] = found.square[:, -1], found.to[:, -1]
        taken, labels, looks, x, y = grown(tuple(known), (labels, last, np.minimum(ids, end), np.maximum(ids, end)))
        tree.append((known[3][taken], known[4][taken], known[2][taken]))
        known = [e[x != y] for e in (x, y, *known[2:])]
    return tuple(np.concatenate(e) for e in zip(*tree))


Node = tuple  # a point (id, id), or the link (a, b) by which points came together


@dataclass(slots=True)
class Part:
    """What meets others at some distance: a cluster with its stability so far, or fewer points than a cluster has."""

    node: Node
    weight: int
    total: float  # 1/distance over the points that left it
    inside: float  # stability of what is picked inside; NaN if nothing split off


@dataclass(slots=True)
class Level:
    """A component and how it came together at its greatest distance (none for a point)."""

    node: Node
    length: float | None
    weight: int
    falls: int = 0  # points in parts smaller than a cluster
    large: int = 0  # other parts: none, one, or more
    one: Part | None = None  # if it is one
    inside: float = 0.0  # if they are more: the stability of what is picked in them


class Merger:
    """Merges components of a group along links of rising length; `links` are (node, node around it, length at which it
    split off or None if it just belongs there, whether it is picked)."""

    def __init__(self, levels: dict, least: int):
        self.levels, self.least = levels, least
        self.above = {c: c for c in levels}
        self.links: list[tuple[Node, Node, float | None, bool]] = []

    def root(self, c):
        above = self.above
        while above[c] != c:
            above[c] = above[above[c]]
            c = above[c]
        return c

    def _part(self, x: Level) -> Part:
        """A component as it meets links that are longer than its own."""
        if x.length is None:
            return Part(x.node, x.weight, math.inf, math.nan)
        density = 1 / x.length if x.length > 0 else math.inf
        if x.large == 0:
            return Part(x.node, x.weight, x.weight * density, math.nan)
        if x.large == 1:
            self.links.append((x.node, x.one.node, None, False))
            gone = x.falls * density if x.falls else 0.0
            return Part(x.one.node, x.weight, x.one.total + gone, x.one.inside)
        return Part(x.node, x.weight, x.weight * density, x.inside)

    def _split(self, z: Level, part: Part) -> None:
        own = part.total - part.weight / z.length
        picked = not part.inside > own
        z.inside += own if picked else part.inside
        self.links.append((part.node, z.node, z.length, picked))

    def _add(self, z: Level, part: Part) -> None:
        if part.weight < self.least or z.length == 0:  # equal points stay together for ever
            z.falls += part.weight
            self.links.append((part.node, z.node, None, False))
        elif z.large == 0:
            z.large, z.one = 1, part
        else:
            if z.large == 1:
                self._split(z, z.one)
                z.large, z.one = 2, None
            self._split(z, part)

    def merge(self, a, b, ca, cb, length: float) -> None:
        """The link of points a and b, which lie in the components that were named ca and cb."""
        ca, cb = self.root(ca), self.root(cb)
        x, y = self.levels.pop(ca), self.levels.pop(cb)
        if y.length == length and x.length != length:
            x, y = y, x
        z = x
        if x.length != length:
            z = Level((a, b), length, 0)
            self._add(z, self._part(x))
        if y.length != length:
            self._add(z, self._part(y))
        else:  # two halves of one cut
            self.links.append((y.node, z.node, None, False))
            z.falls += y.falls
            if y.large == 1:
                self._add(z, y.one)
            elif y.large == 2:
                if z.large == 1:
                    self._split(z, z.one)
                z.large, z.one = 2, None
                z.inside += y.inside
        z.weight = x.weight + y.weight
        to, gone = (ca, cb) if ca < cb else (cb, ca)
        self.above[gone] = to
        self.levels[to] = z


def chosen_nodes(links: list, epsilon: float, nodes: Iterable[Node]) -> list[Node | None]:
    """For each node the cluster around it that is chosen, or None.  What is around a node comes later in `links`."""
    found: dict = {}  # node -> (outermost picked, nearest that split off above epsilon, outermost), with their lengths
    for node, around, length, picked in reversed(links):
        top, loose, outer = found.get(around, (None, None, None))
        own = (node, length)
        if length is not None:
            top = top or (own if picked else None)
            loose = own if length > epsilon else loose
            outer = outer or own
        found[node] = (top, loose, outer)

    def choice(top, loose, outer):
        return top if top[1] >= epsilon else loose or outer

    chosen = {choice(*f)[0] for f in found.values() if f[0]}
    out = []
    for node in nodes:
        top, loose, outer = found.get(node, (None, None, None))
        best = choice(top, loose, outer) if top else loose or outer
        out.append(best[0] if best and best[0] in chosen else None)
    return out


def _labels(ids: list, copies: list[int], links: tuple, least: int, epsilon: float) -> list:
    """The least id of the cluster of each point of a group, or None; ids rise, and links are of their places."""
    a, b, square = links
    merger = Merger({i: Level((i, i), None, w) for i, w in enumerate(copies)}, least)
    order = np.lexsort((b, a, square))
    for x, y, d in zip(a[order].tolist(), b[order].tolist(), np.sqrt(square[order]).tolist()):
        merger.merge(x, y, x, y, d)
    found = chosen_nodes(merger.links, epsilon, ((i, i) for i in range(len(ids))))
    first: dict = {}
    for i, node in enumerate(found):
        first.setdefault(node, ids[i])
    return [None if c is None else first[c] for c in found]


def _small_labels(points: DataFrame, least: int, epsilon: float, shape: str) -> DataFrame:
    """Groups of up to a block, each in one task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")
        found = _labels(rows["id"].tolist(), rows["copies"].tolist(), spanning_links(M.matrix(rows["vec"])), least, epsilon)
        return pd.DataFrame({"g": rows["g"], "id": rows["id"], "label": pd.Series(found, dtype=object, index=rows.index)})

    return points.select("g", "id", "vec", "copies").groupBy("g").applyInPandas(run, shape)


def _tree_labels(points: DataFrame, forest: DataFrame, parts: int, least: int, epsilon: float, shape: str) -> DataFrame:
    """Groups whose trees are grown, each in one task."""

    def run(rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")
        ids = rows["id"].to_numpy()
        places = (*(np.searchsorted(ids, links[c].to_numpy()) for c in "ab"), links["square"].to_numpy())
        found = _labels(rows["id"].tolist(), rows["copies"].tolist(), places, least, epsilon)
        return pd.DataFrame({"g": rows["g"], "id": rows["id"], "label": pd.Series(found, dtype=object, index=rows.index)})

    # As many partitions, whatever their size: a group is a task's work.
    one, other = (x.repartition(parts, "g").groupBy("g") for x in (points.select("g", "id", "copies"), forest))
    return one.cogroup(other).applyInPandas(run, shape)


def _parts(groups: int) -> int:
    """Partitions in which that many groups seldom meet."""
    return max(1, min(4 * groups, 1_000))


def _across_cells(points: DataFrame, block_rows: int, known_rows: int, links: str) -> DataFrame:
    """Spanning trees of larger groups: passes over the shelves, and rounds of Boruvka over what they find."""
    types = dict(points.dtypes)
    spark = points.sparkSession
    # Vectors stay where they are; from pass to pass only links and labels change.
    space, shelves = N.shelve(points.select("g", "id", "vec"), "l2", True, block_rows)
    if not shelves.entries:
        return spark.createDataFrame([], links)
    # A point with the last of its links, which is infinite if there are no more; or a link with its components.
    shape = f"g {types['g']}, kind int, shelf int, label {types['id']}, other {types['id']}, square double, id {types['id']}, to {types['id']}"
    names = [c.split()[0] for c in shape.split(", ")]

    def search(notes: str | None) -> Callable[[tuple, int], pd.DataFrame]:
        """For each point that looks, its shortest links out of its component."""

        def rows_of(shelf: int, g) -> tuple[np.ndarray, ...]:
            """(ids, cells, vectors, labels, whether they look) in order of their ids."""
            ids, cells, vectors = N.take_arrays(shelves.folder, shelf, g)
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            if notes is None:
                return ids, cells[order], vectors[order], ids, np.ones(len(ids), dtype=bool)
            noted = N.take(notes, shelf, g).sort_values("id", kind="stable")
            return ids, cells[order], vectors[order], noted["label"].to_numpy(), noted["kind"].to_numpy() == LOOKS

        def way_out(entry: tuple, first: int) -> pd.DataFrame:
            shelf, g = entry[:2]
            met_ids, cells, met, met_labels, looks = rows_of(shelf, g)
            own = np.argsort(cells, kind="stable")[first:first + LOOK_ROWS]
            own = own[looks[own]]
            if not len(own):
                return pd.DataFrame(columns=names)
            ids, home, ways = met_ids[own], cells[own], Ways(met_ids[own], met_labels[own], met[own])
            ways.meet(np.arange(len(own)), met_ids, met_labels, met)
            needs = N.needed_cells(space, pd.Series(list(ways.vectors)), np.sqrt(ways.square[:, -1] + M.ROUNDING))
            for other, _, _, low, high in shelves.of(g):
                if other == shelf or not needs[:, low:high + 1].any():
                    continue
                met_ids, cells, met, met_labels, _ = rows_of(other, g)
                for r, c in N.pairings(home, needs, cells):
                    c = slice(None) if len(c) == len(cells) else c
                    ways.meet(r, met_ids[c], met_labels[c], met[c])
            r, k = np.nonzero(np.isfinite(ways.square))
            return pd.concat([
                pd.DataFrame({"kind": WAY, "shelf": shelf, "label": ways.labels[r], "other": ways.other[r, k], "square": ways.square[r, k], "id": ids[r], "to": ways.to[r, k]}),
                pd.DataFrame({"kind": POINT, "shelf": shelf, "label": ways.labels, "other": ways.labels, "square": ways.square[:, -1], "id": ids, "to": ways.to[:, -1]}),
            ]).assign(g=g)[names]

        return way_out

    def follow(rows: pd.DataFrame) -> pd.DataFrame:
        """A group in one task: only the columns that change are copied."""
        c = {name: rows[name].to_numpy() for name in names}
        less = c["id"] < c["to"]
        a, b = np.where(less, c["id"], c["to"]), np.where(less, c["to"], c["id"])
        ways, ends = np.flatnonzero(c["kind"] == WAY), np.flatnonzero(c["kind"] == POINT)
        taken, label, looks, x, y = grown(
            tuple(e[ways] for e in (c["label"], c["other"], c["square"], a, b)), tuple(e[ends] for e in (c["label"], c["square"], a, b))
        )
        del a, b

        def at(places: np.ndarray, kind, label: np.ndarray, other: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({**{name: c[name][places] for name in names}, "kind": kind, "label": label, "other": other})

        tree = at(ways[taken], LINK, c["label"][ways[taken]], c["other"][ways[taken]])
        if not looks.any():
            return tree
        left = x != y
        return pd.concat([tree, at(ways[left], WAY, x[left], y[left]), at(ends, np.where(looks, LOOKS, POINT), label, label)])

    parts = _parts(len({e[1] for e in shelves.entries}))
    made: list[DataFrame] = []
    notes, known, pieces = None, None, shelves.pieces(LOOK_ROWS)
    while pieces:
        found = N.over_pieces(spark, shelves, pieces, search(notes), shape)
        found = N.rewritten(found if known is None else known.unionByName(found))
        many = N.rewritten(found.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > known_rows).select("g"))
        after = found.join(F.broadcast(many), "g", "left_anti").repartition(parts, "g").groupBy("g").applyInPandas(follow, shape)
        if not many.isEmpty():
            after = after.unionByName(_followed(found.join(F.broadcast(many), "g", "left_semi")).select(*names))
        after = N.rewritten(after)
        made.append(after.filter(F.col("kind") == LINK).select("g", F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b"), "square"))
        looking = {(r["shelf"], r["g"]) for r in after.filter(F.col("kind") == LOOKS).select("shelf", "g").distinct().collect()}
        if looking:
            notes = N.noted(after.filter(F.col("kind") >= POINT).select("shelf", "g", "id", "label", "kind"))
            known = after.filter(F.col("kind").isin(WAY, POINT))
        pieces = [p for p in shelves.pieces(LOOK_ROWS) if shelves.entries[p[0]][:2] in looking]
    return reduce(DataFrame.unionByName, made)


def _followed(rows: DataFrame) -> DataFrame:
    """`grown` over rows: (g, kind, shelf, label, other, square, id, to)."""
    way = F.struct("square", F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b"))
    points = rows.filter(F.col("kind") == POINT)
    ways = rows.filter(F.col("kind") == WAY).groupBy("g", "label", "other").agg(F.min(way).alias("way"))
    ends = points.groupBy("g", "label").agg(F.min(way).alias("end"))
    names = N.rewritten(points.select("g", "label").distinct().withColumn("now", F.col("label")))
    tree: list[DataFrame] = []
    while True:
        ways, ends = N.rewritten(ways), N.rewritten(ends)
        best = ways.groupBy("g", "label").agg(F.min(F.struct("way", "other")).alias("m"))
        sure = N.rewritten(best.join(ends, ["g", "label"]).filter("m.way <= end").select("g", "label", "m.other", "m.way"))
        if sure.isEmpty():
            break
        tree.append(sure.select("g", "way.*").distinct())
        roots = _roots(sure)
        names = N.rewritten(names.join(roots.withColumnRenamed("label", "now"), ["g", "now"], "left").select("g", "label", F.coalesce("root", "now").alias("now")))
        for end in ("label", "other"):
            ways = ways.join(roots.withColumnRenamed("label", end), ["g", end], "left").withColumn(end, F.coalesce("root", end)).drop("root")
        ways = ways.filter("label != other").groupBy("g", "label", "other").agg(F.min("way").alias("way"))
        ends = ends.join(roots, ["g", "label"], "left").groupBy("g", F.coalesce("root", "label").alias("label")).agg(F.min("end").alias("end"))
    labelled = points.join(names, ["g", "label"])
    sizes = labelled.groupBy("g", "now").agg(F.count("*").alias("n"))
    most = sizes.groupBy("g").agg(F.max_by("now", F.struct("n", "now")).alias("most"), F.count("*").alias("parts")).filter("parts > 1")
    looks = F.coalesce((way < F.col("m.way")) | F.col("m").isNull(), F.lit(False)) & (F.col("square") < float("inf")) & (F.col("now") != F.col("most"))
    left = labelled.join(best.withColumnRenamed("label", "now"), ["g", "now"], "left").join(most, "g").select(
        "g", F.when(looks, LOOKS).otherwise(POINT).alias("kind"), "shelf", F.col("now").alias("label"), F.col("now").alias("other"), "square", "id", "to"
    )
    none = F.lit(-1).alias("shelf")
    links = [t.select("g", F.lit(LINK).alias("kind"), none, F.col("a").alias("label"), F.col("b").alias("other"), "square", F.col("a").alias("id"), F.col("b").alias("to")) for t in tree]
    open_ = ways.select("g", F.lit(WAY).alias("kind"), none, "label", "other", "way.square", F.col("way.a").alias("id"), F.col("way.b").alias("to"))
    return reduce(DataFrame.unionByName, [*links, open_, left])


def _roots(found: DataFrame) -> DataFrame:
    """(g, label, other) -> (g, label, root): components follow each other's links; of two that chose each other the lesser is the root."""
    back = found.select("g", F.col("label").alias("other"), F.col("other").alias("beyond"))
    mutual = (F.col("beyond") == F.col("label")) & (F.col("label") < F.col("other"))
    up = N.rewritten(found.join(back, ["g", "other"], "left").select(
        "g", "label", F.when(F.coalesce(mutual, F.lit(False)), F.col("label")).otherwise(F.col("other")).alias("root")
    ))
    while True:
        beyond = up.select("g", F.col("label").alias("root"), F.col("root").alias("beyond"))
        after = N.rewritten(up.join(beyond, ["g", "root"], "left").select(
            "g", "label", F.coalesce("beyond", "root").alias("root"), (F.col("beyond") != F.col("root")).alias("moved")
        ))
        up = after.drop("moved")
        if after.filter("moved").isEmpty():
            return up


def spanning_forest(points: DataFrame, block_rows: int = N.BLOCK_ROWS, known_rows: int = KNOWN_ROWS) -> DataFrame:
    """points(g, id, vec) -> (g, a, b, square): the links of a minimum spanning tree of each group, a < b.

    Vectors have distances from each other, and ids differ within a group.
    """
    N.ensure_checkpoints(points.sparkSession)
    types = dict(points.dtypes)
    return _across_cells(points, block_rows, known_rows, f"g {types['g']}, a {types['id']}, b {types['id']}, square double")


def _merged(points: DataFrame, forest: DataFrame, least: int, band_links: int) -> DataFrame:
    """The links of a Merger over large groups: (g, node, around, length, picked), nodes as struct(a, b).

    A group's links are dealt into bands of rising length.  A task merges one band with the components that it touches;
    the components in the bands still to come are then renamed.
    """
    types = dict(points.dtypes)
    key = types["id"]
    spark = points.sparkSession
    bands = max(1, math.ceil(2 * forest.count() / band_links))
    cut = N.rewritten(forest.repartitionByRange(bands, "g", "square", "a", "b").withColumn("band", F.spark_partition_id()))
    # A row per group and band.
    turns = cut.select("g", "band").distinct().withColumn("turn", F.row_number().over(Window.partitionBy("g").orderBy("band")))
    edges = N.rewritten(cut.join(turns, ["g", "band"]).select("g", "a", "b", "square", "turn", F.col("a").alias("ca"), F.col("b").alias("cb")))
    number, none = F.lit(None).cast("double"), F.lit(0)
    levels = points.select(
        "g", F.col("id").alias("comp"), F.col("id").alias("a"), F.col("id").alias("b"), F.col("id").alias("pa"), F.col("id").alias("pb"),
        number.alias("length"), F.col("copies").cast("long").alias("weight"), none.cast("long").alias("falls"), none.cast("int").alias("large"),
        none.cast("long").alias("one_weight"), number.alias("one_total"), number.alias("one_inside"), F.lit(0.0).alias("inside"),
    )
    # A level with its one part (pa, pb); a renamed component; or a link with what is around it (pa, pb).
    shape = (
        f"g {types['g']}, kind string, comp {key}, a {key}, b {key}, pa {key}, pb {key}, length double, weight long, falls long, "
        "large int, one_weight long, one_total double, one_inside double, inside double, picked boolean"
    )
    names = [c.split()[0] for c in shape.split(", ")]
    columns = levels.columns

    def run(links: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(links):
            return pd.DataFrame(columns=names)
        g = links["g"].iloc[0]
        known = {}
        for r in zip(*(rows[c].tolist() for c in columns[1:])):
            comp, a, b, pa, pb, length, weight, falls, large, one_weight, one_total, one_inside, inside = r
            one = Part((pa, pb), one_weight, one_total, one_inside) if large == 1 else None
            known[comp] = Level((a, b), None if math.isnan(length) else length, weight, falls, large, one, inside)
        merger = Merger(known, least)
        before = list(known)
        links = links.sort_values(["square", "a", "b"], kind="stable")
        each = (links[c].tolist() for c in ("a", "b", "ca", "cb"))
        for a, b, ca, cb, d in zip(*each, np.sqrt(links["square"].to_numpy()).tolist()):
            merger.merge(a, b, ca, cb, d)
        out = []
        for comp, z in merger.levels.items():
            one = z.one or Part(z.node, 0, math.nan, math.nan)
            out.append((g, "level", comp, *z.node, *one.node, z.length, z.weight, z.falls, z.large, one.weight, one.total, one.inside, z.inside, False))
        for comp in before:
            to = merger.root(comp)
            if to != comp:
                out.append((g, "renamed", comp, to, to, to, to, math.nan, 0, 0, 0, 0, math.nan, math.nan, 0.0, False))
        for at, (node, around, length, picked) in enumerate(merger.links):
            out.append((g, "link", node[0], *node, *around, math.nan if length is None else length, 0, 0, 0, 0, math.nan, math.nan, 0.0, picked))
        return pd.DataFrame(out, columns=names)

    made: list[DataFrame] = []
    last = turns.agg(F.max("turn")).first()[0] or 0
    for turn in range(1, last + 1):
        now = edges.filter(F.col("turn") == turn)
        ends = now.select("g", F.col("ca").alias("comp")).union(now.select("g", "cb")).distinct()
        touched = levels.join(ends, ["g", "comp"], "left_semi")
        after = N.rewritten(now.groupBy("g").cogroup(touched.groupBy("g")).applyInPandas(run, shape))
        made.append(after.filter("kind = 'link'").select(
            "g", F.struct("a", "b").alias("node"), F.struct(F.col("pa").alias("a"), F.col("pb").alias("b")).alias("around"), "length", "picked"
        ))
        if len(made) == N.ROUNDS_AT_ONCE:
            made = [N.rewritten(reduce(DataFrame.unionByName, made))]
        if turn < last:
            levels = N.rewritten(levels.join(ends, ["g", "comp"], "left_anti").unionByName(after.filter("kind = 'level'").select(*columns)))
            renamed = after.filter("kind = 'renamed'").select("g", "comp", F.col("a").alias("to"))
            for end in ("ca", "cb"):
                edges = edges.filter(F.col("turn") > turn).join(renamed.withColumnRenamed("comp", end), ["g", end], "left").withColumn(
                    end, F.coalesce("to", end)
                ).drop("to")
            edges = N.rewritten(edges)
    if not made:
        node = f"struct<a: {key}, b: {key}>"
        return spark.createDataFrame([], f"g {types['g']}, node {node}, around {node}, length double, picked boolean")
    return reduce(DataFrame.unionByName, made)


def _chosen(links: DataFrame, epsilon: float) -> DataFrame:
    """chosen_nodes over rows, for the nodes of the links: (g, node, chosen).  Every round doubles the way that a node sees."""
    own = F.struct("node", "length")
    splits = F.col("length").isNotNull()
    seen = N.rewritten(links.select(
        "g", "node", F.col("around").alias("to"), F.when(splits & F.col("picked"), own).alias("top"),
        F.when(splits & (F.col("length") > epsilon), own).alias("loose"), F.when(splits, own).alias("outer"),
    ))
    while True:
        further = seen.select(
            "g", F.col("node").alias("to"), F.col("to").alias("to2"), F.col("top").alias("top2"), F.col("loose").alias("loose2"), F.col("outer").alias("outer2")
        )
        # Those that see to the end are kept aside from the join.
        moved = seen.filter("to IS NOT NULL").join(further, ["g", "to"], "left").select(
            "g", "node", F.col("to2").alias("to"), F.coalesce("top2", "top").alias("top"),
            F.coalesce("loose", "loose2").alias("loose"), F.coalesce("outer2", "outer").alias("outer"),
        )
        seen = N.rewritten(seen.filter("to IS NULL").unionByName(moved))
        if seen.filter("to IS NOT NULL").isEmpty():
            break
    wide = F.coalesce("loose", "outer")
    best = F.when(F.col("top").isNull() | (F.col("top.length") < epsilon), wide).otherwise(F.col("top"))
    picks = seen.select("g", "node", best["node"].alias("chosen"), F.col("top").isNotNull().alias("sure"))
    chosen = picks.filter("sure").select("g", "chosen").distinct()
    return picks.join(chosen, ["g", "chosen"], "left_semi").select("g", "node", "chosen")


def density_labels(
    points: DataFrame, least: int, epsilon: float, block_rows: int = N.BLOCK_ROWS, small: int = SMALL_GROUP, band_links: int = BAND_LINKS,
    known_rows: int = KNOWN_ROWS,
) -> DataFrame:
    """points(g, id, vec, copies) -> (g, id, label): the least id of the point's cluster, null for noise.

    Ids differ within a group.  A point stands for `copies` equal ones, which are a cluster of their own if they are
    enough.  Vectors that have no distance from anything are noise.
    """
    N.ensure_checkpoints(points.sparkSession)
    types = dict(points.dtypes)
    shape = f"g {types['g']}, id {types['id']}, label {types['id']}"
    usual = points.filter(M.finite(F.col("vec")))
    large = N.rewritten(usual.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > small))
    strange = points.filter(~M.finite(F.col("vec"))).select("g", "id", F.lit(None).cast(types["id"]).alias("label"))
    few = F.broadcast(large.select("g"))  # at most a row for each `small` points
    done = _small_labels(usual.join(few, "g", "left_anti"), least, epsilon, shape).unionByName(strange)
    groups = large.count()
    if not groups:
        return done
    rest = usual.join(few, "g", "left_semi").select("g", "id", "vec", "copies")
    forest = N.rewritten(spanning_forest(rest, block_rows, known_rows))
    long = F.broadcast(large.filter(F.col("n") > band_links // 2).select("g"))
    whole = (x.join(long, "g", "left_anti") for x in (rest, forest))
    done = done.unionByName(_tree_labels(*whole, _parts(groups), least, epsilon, shape))
    if large.filter(F.col("n") > band_links // 2).isEmpty():
        return done
    rest, forest = (x.join(long, "g", "left_semi") for x in (rest, forest))
    found = N.rewritten(_chosen(_merged(rest, forest, least, band_links), epsilon).filter("node.a = node.b"))
    named = found.groupBy("g", "chosen").agg(F.min("node.a").alias("label"))
    labels = found.join(named, ["g", "chosen"]).select("g", F.col("node.a").alias("id"), "label")
    return done.unionByName(rest.select("g", "id").join(labels, ["g", "id"], "left"))
