"""Exact neighbour search over vectors, by metric cells and blocks of bounded size.

A group of up to a block is one task's.  Vectors of larger groups, and a large
stored side, are written once, as shelves: Parquet folders of bounded size in
the checkpoint folder, in order of their metric cells (cells.py).  A task holds
a few thousand rows, reads one shelf after the other and compares its rows with
the cells that can hold something near enough.  So vectors are shuffled once,
whatever is left to compare, and what comes out is a row per vector or a link
per row and task, never the pairs: a group of near copies costs arithmetic only.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import cells as M

BLOCK_ROWS = 32_768
BLOCK_BYTES = 64 << 20  # and no block of vectors is larger
BROADCAST_ROWS = 20_000  # a right side up to this size goes to every task
BROADCAST_BYTES = 16 << 20  # if it isn't larger than this either
PIECE_ROWS = 4_096  # rows that a task holds while it reads shelves
ASKED_ROWS = 16_384  # queries that a task holds; they lie in no order of cells
ASKED_BYTES = 16 << 20  # and they take no more than this, unless they are fewer than PIECE_ROWS
WALK_ROWS = 1_024  # rows that are compared with each other one by one
ROUNDS_AT_ONCE = 16
CELLS = 8_000_000  # largest distance matrix held at once
PAIRS = 100_000  # pairs compared one by one at once


def ensure_checkpoints(spark: SparkSession) -> None:
    """Uses the session's spark.checkpoint.dir; without one, a folder of our own in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="redbuild-"))


def rewritten(df: DataFrame) -> DataFrame:
    """The rows, computed once, as Parquet in the checkpoint folder.

    For loops of joins: a checkpoint keeps the planner's size estimates, and those of joins multiply from round to round.
    """
    ensure_checkpoints(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _tiles(left: np.ndarray, right: np.ndarray, metric: str) -> Iterator[tuple[int, np.ndarray]]:
    """(first left row, matrix of left rows x right rows), a few rows at a time.

    Rounded to nine places, so that equal distances stay equal.
    """
    step = max(1, CELLS // max(1, len(right)))
    right_squares = (right * right).sum(axis=1)
    for at in range(0, len(left), step):
        rows = left[at:at + step]
        product = rows @ right.T
        if metric == "cosine":
            lengths = np.sqrt((rows * rows).sum(axis=1))[:, None] * np.sqrt(right_squares)[None, :]
            product = np.divide(product, lengths, out=np.zeros_like(product), where=lengths > 0)
        elif metric == "l2":
            product = (rows * rows).sum(axis=1)[:, None] + right_squares[None, :] - 2 * product
            product = np.maximum(product, 0.0)
        yield at, np.round(product, 9)


Reducer = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]


def _extent(vectors: DataFrame) -> tuple[int, int]:
    """(rows, bytes of a row as doubles)."""
    n, width = vectors.agg(F.count("*"), F.max(F.size("vec"))).first()
    return n, 8 * max(1, width or 0)


# --- shelves -----------------------------------------------------------------------


@dataclass
class Shelves:
    """Rows in folders `shelf=...`, one each of bounded size; entries are (shelf, group or None, rows, least cell, greatest)."""

    folder: str
    entries: list[tuple]

    def of(self, g) -> list[tuple]:
        return [e for e in self.entries if e[1] == g]

    def pieces(self, rows: int = PIECE_ROWS) -> list[tuple[int, int]]:
        """(entry, first row) of all pieces of up to `rows` rows."""
        return [(i, at) for i, e in enumerate(self.entries) for at in range(0, e[2], rows)]


def shelve(points: DataFrame, metric: str, by_cell: bool, block_rows: int, group: str | None = "g") -> tuple[M.Cells, Shelves]:
    """Deals points(id, vec, ...) into cells and writes them in ranges of (group, cell, id), or of (group, id); a row per
    shelf and group comes back.

    This is the only copy of the vectors, and they are shuffled once for it: the points are read several times instead.
    Vectors that have no distance from anything are left out `by_cell`, otherwise they lie in cell -1.
    """
    n, size = _extent(points)
    space = M.drawn(points, metric, n, size)
    rows = max(1, min(block_rows, BLOCK_BYTES // size))
    folder = f"{points.sparkSession.sparkContext.getCheckpointDir()}/shelves-{uuid.uuid4().hex}"
    if not n or by_cell and not len(space.pivots):
        return space, Shelves(folder, [])
    parts, before, usual = max(1, math.ceil(n / rows)), [group] if group else [], M.finite(F.col("vec"))
    if by_cell:
        homed = points.filter(usual).withColumn("h", M.home_of(space)).select(*points.columns, "h.cell", "h.away")
        dealt = homed.repartitionByRange(parts, *before, "cell", "id")
    else:
        dealt = points.repartitionByRange(parts, *before, "id")
        if len(space.pivots):
            # Ranges are cut without a look at the cells, so these are found once.
            vec = F.when(usual, F.col("vec")).otherwise(F.transform("vec", lambda x: F.lit(0.0)))
            dealt = dealt.withColumn("h", M.home_of(space, vec)).select(
                *points.columns, F.when(usual, F.col("h.cell")).otherwise(-1).alias("cell"), F.when(usual, F.col("h.away")).alias("away")
            )
        else:
            dealt = dealt.withColumn("cell", F.lit(-1)).withColumn("away", F.lit(None).cast("double"))
    dealt = dealt.withColumn("shelf", F.spark_partition_id())
    dealt.write.partitionBy("shelf").parquet(folder)
    stored = points.sparkSession.read.parquet(folder)
    keys = ["shelf", F.col(group).alias("_g") if group else F.lit(None).cast("int").alias("_g")]
    facts = stored.groupBy(*keys).agg(F.count("*"), F.min("cell"), F.max("cell"))
    entries = sorted((tuple(r) for r in facts.collect()), key=lambda e: (e[0], str(e[1])))
    return M.measured(space, stored.filter("cell >= 0")), Shelves(folder, entries)


def take(folder: str, shelf: int, g=None) -> pd.DataFrame:
    """The rows of a shelf, or those of a group in it; in a task."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(quote(folder if ":" in folder else f"file://{folder}", safe=":/@"))
    rows = pq.read_table(f"{root}/shelf={shelf}", filesystem=system, partitioning=None).to_pandas()
    return rows if g is None else rows[rows["g"] == g]


def take_arrays(folder: str, shelf: int, g) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, cells, vectors) of a group in a shelf; in a task."""
    import pyarrow.compute as pc
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(quote(folder if ":" in folder else f"file://{folder}", safe=":/@"))
    rows = pq.read_table(f"{root}/shelf={shelf}", columns=["g", "id", "cell", "vec"], filesystem=system, partitioning=None)
    rows = rows.filter(pc.equal(rows["g"], g)).combine_chunks()
    vec = rows["vec"].combine_chunks()
    widths = vec.value_lengths().to_numpy(zero_copy_only=False)
    if len(np.unique(widths)) > 1:
        raise ValueError(f"vectors of {widths.min()} to {widths.max()} dimensions")
    vectors = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(widths), -1)
    return rows["id"].to_numpy(), rows["cell"].to_numpy(), vectors


def has_shelf(folder: str, shelf: int) -> bool:
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(quote(folder if ":" in folder else f"file://{folder}", safe=":/@"))
    return system.get_file_info(f"{root}/shelf={shelf}").type == fs.FileType.Directory


def noted(rows: DataFrame, folder: str | None = None) -> str:
    """Writes what is known of rows, (shelf, g, id, ...), by their shelves; the folder."""
    folder = folder or f"{rows.sparkSession.sparkContext.getCheckpointDir()}/notes-{uuid.uuid4().hex}"
    rows.repartition("shelf").write.partitionBy("shelf").parquet(folder)
    return folder


def over_pieces(spark: SparkSession, shelves: Shelves, pieces: list[tuple[int, int]], run: Callable[[tuple, int], pd.DataFrame], schema: str) -> DataFrame:
    """run(entry, first row) for every piece, in tasks of their own."""
    entries = shelves.entries
    rows = spark.createDataFrame(spark.sparkContext.parallelize(pieces, max(1, len(pieces))), "entry int, at long")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for entry, at in zip(batch["entry"].tolist(), batch["at"].tolist()):
                yield run(entries[entry], at)

    return rows.mapInPandas(each, schema)


def pairings(home: np.ndarray, needs: np.ndarray, cells: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, columns) to compare: `needs` (rows x cells) says which cells a row needs, `cells` where the columns lie.

    Rows with the same home go together; those that need most of the columns meet them all.
    """
    most = []
    for c in np.unique(home):
        rows = np.flatnonzero(home == c)
        wanted = needs[rows].any(axis=0)[cells]
        if 2 * wanted.sum() > len(cells):
            most.append(rows)
        elif wanted.any():
            yield rows, np.flatnonzero(wanted)
    if most:
        yield np.concatenate(most), np.arange(len(cells))


def needed_cells(space: M.Cells, vectors: pd.Series, reach: np.ndarray) -> np.ndarray:
    """rows x cells: whether a row may have a stored vector within its reach there."""
    found, at = [], 0
    for rows, away, home in space.tiles(vectors, False):
        found.append(space.within(rows, away, home, reach[at:at + len(rows)]))
        at += len(rows)
    return np.concatenate(found)


def maybe_near(left: np.ndarray, right: np.ndarray, limits: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, rows and columns of pairs) a few rows at a time: no pair within the squared distance `limits` of its
    row is left out.  Single precision with a slack; all pairs beyond its range."""
    left_squares, right_squares = (left * left).sum(axis=1), (right * right).sum(axis=1)
    top = max(left_squares.max(initial=0.0), right_squares.max(initial=0.0))
    step = max(1, CELLS // max(1, len(right)))
    if not top < 1e30:
        for at in range(0, len(left), step):
            rows = min(step, len(left) - at)
            yield at, rows, at + np.repeat(np.arange(rows), len(right)), np.tile(np.arange(len(right)), rows)
        return
    slack = 4e-7 * (left.shape[1] + 8) * top + M.ROUNDING
    narrow = (left * -2).astype(np.float32)
    turned, other = right.astype(np.float32).T.copy(), right_squares.astype(np.float32)
    bounds = np.minimum(limits + slack - left_squares, 1e38).astype(np.float32)
    for at in range(0, len(left), step):
        product = narrow[at:at + step] @ turned
        product += other
        rows, columns = np.nonzero(product <= bounds[at:at + step, None])
        yield at, len(product), at + rows, columns


def exact(left: np.ndarray, right: np.ndarray, rows: np.ndarray, columns: np.ndarray, metric: str) -> np.ndarray:
    """The values of pairs, as in _tiles."""
    a, b = left[rows], right[columns]
    value = np.einsum("ij,ij->i", a, b)
    squares = (a * a).sum(axis=1), (b * b).sum(axis=1)
    if metric == "cosine":
        lengths = np.sqrt(squares[0]) * np.sqrt(squares[1])
        value = np.divide(value, lengths, out=np.zeros_like(value), where=lengths > 0)
    else:
        value = np.maximum(squares[0] + squares[1] - 2 * value, 0.0)
    return np.round(value, 9)


def near_pairs(left: np.ndarray, right: np.ndarray, metric: str, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, columns) of pairs at a squared distance of up to `limit` ("l2") or a cosine above it, a few rows at a time."""
    cosine = metric == "cosine"
    # Vectors without a distance are near nothing.
    real = [np.flatnonzero(np.isfinite(x).all(axis=1)) for x in (left, right)]
    placed = [M.place(x[r], metric, stored) for x, r, stored in ((left, real[0], False), (right, real[1], True))]
    limits = np.full(len(real[0]), 2 - 2 * limit if cosine else limit)
    for _, _, rows, columns in maybe_near(*placed, limits):
        for at in range(0, len(rows), PAIRS):
            a, b = real[0][rows[at:at + PAIRS]], real[1][columns[at:at + PAIRS]]
            value = exact(left, right, a, b, metric)
            hit = value > limit if cosine else value <= limit
            yield a[hit], b[hit]


# --- nearest -----------------------------------------------------------------------


def nearest(
    queries: DataFrame, stored: DataFrame, k: int, metric: str,
    at_least: float | None = None,
    block_rows: int = BLOCK_ROWS, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """The k nearest stored vectors of each query, ties by stored id.

    queries(id, vec), stored(id, vec) -> (id, stored_id, value, rank).  `value`
    is the squared L2 distance (metric "l2") or the cosine ("cosine", where
    `at_least` drops what is below it).  A small stored side, counted first,
    goes to every task; of a larger one each query meets its own cell and then
    those that its k-th best so far leaves open.
    """
    sign = -1.0 if metric == "cosine" else 1.0
    id_type = dict(queries.dtypes)["id"]
    stored_type = dict(stored.dtypes)["id"]

    def search(ids, vectors: np.ndarray, known_ids: np.ndarray, known: np.ndarray) -> pd.DataFrame:
        found = []
        for at, values in _tiles(vectors, known, metric):
            ranked = sign * values
            picked = ranked
            if at_least is not None:
                picked = np.where(values >= at_least, ranked, np.inf)
            # Up to the k-th smallest value; of those equal to it the first by
            # stored id (the columns' order), so copies make no more than k rows.
            kth = min(k, picked.shape[1]) - 1
            limit = np.partition(picked, kth, axis=1)[:, kth, None]
            below, equal = picked < limit, picked == limit
            room = k - below.sum(axis=1, keepdims=True)
            equal &= np.cumsum(equal, axis=1, dtype=np.int32) <= room
            rows, cols = np.nonzero((below | equal) & np.isfinite(picked))
            found.append(pd.DataFrame({
                "id": np.asarray(ids)[at + rows], "stored_id": known_ids[cols],
                "value": values[rows, cols], "order": ranked[rows, cols],
            }))
        every = pd.concat(found) if found else pd.DataFrame(columns=["id", "stored_id", "value", "order"])
        every = every.sort_values(["id", "order", "stored_id"], kind="stable")
        every["rank"] = every.groupby("id").cumcount() + 1
        return every.loc[every["rank"] <= k, ["id", "stored_id", "value", "rank"]].astype(
            {"value": "float64", "rank": "int32"}
        )

    schema = f"id {id_type}, stored_id {stored_type}, value double, rank int"
    n, size = _extent(stored)
    if n == 0:
        return queries.sparkSession.createDataFrame([], schema)
    if n <= broadcast_rows and n * size <= BROADCAST_BYTES:
        sample = stored.select("id", "vec").toPandas().sort_values("id")
        shared = queries.sparkSession.sparkContext.broadcast(
            (sample["id"].to_numpy(), M.matrix(sample["vec"]))
        )

        def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known_ids, known = shared.value
            for batch in batches:
                if len(batch):
                    yield search(batch["id"].to_numpy(), M.matrix(batch["vec"]), known_ids, known)

        return queries.select("id", "vec").mapInPandas(per_batch, schema)

    # Of equal stored vectors only the first k by id can be among the nearest; the window keeps k per task already.
    copies = Window.partitionBy("vec").orderBy("id")
    first_copies = stored.select("id", "vec").withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k)
    space, shelves = shelve(rewritten(first_copies.drop("copy")), metric, True, block_rows, group=None)
    if not shelves.entries:
        return queries.sparkSession.createDataFrame([], schema)
    ahead = max(0.0, 2 - 2 * at_least) + M.ROUNDING if at_least is not None else math.inf

    def best_of(found: list[pd.DataFrame]) -> pd.DataFrame:
        every = pd.concat(found).drop_duplicates(["id", "stored_id"])
        every["order"] = sign * every["value"]
        every = every.sort_values(["id", "order", "stored_id"], kind="stable")
        return every[every.groupby("id").cumcount() < k]

    def search_shelves(rows: pd.DataFrame) -> pd.DataFrame:
        """The home cells give a bound, then the cells within it are searched."""
        vectors = M.matrix(rows["vec"])
        homes = [(home, space.upper(away, k)) for _, away, home in space.tiles(rows["vec"], False)]
        home, upper = (np.concatenate(x) for x in zip(*homes))
        best = pd.DataFrame({"id": np.zeros(0, dtype=np.int64), "stored_id": [], "value": [], "order": []})
        needs = np.zeros((len(rows), len(space.pivots)), dtype=bool)
        needs[np.arange(len(rows)), home] = True
        placed = M.place(vectors, metric, False)

        def reaches() -> np.ndarray:
            """No vector beyond this distance is among the k nearest."""
            last = best[best.groupby("id").cumcount() == k - 1]
            squares = (2 - 2 * last["value"] if metric == "cosine" else last["value"]).to_numpy(dtype=np.float64)
            reach, at = upper.copy(), last["id"].to_numpy(dtype=np.int64)
            reach[at] = np.minimum(reach[at], np.sqrt(np.maximum(squares + M.ROUNDING, 0.0)))
            return np.minimum(reach, math.sqrt(ahead))

        def meet(r: np.ndarray, known_ids: np.ndarray, known: np.ndarray, limits: np.ndarray) -> Iterator[pd.DataFrame]:
            """Single precision leaves out what is surely beyond the limits; where much is left, all pairs are ranked."""
            for at, step, a, b in maybe_near(placed[r], M.place(known, metric, True), limits[r] ** 2):
                if len(a) > step * len(known) // 20:
                    own = r[at:at + step]
                    yield search(own, vectors[own], known_ids, known)
                    continue
                value = np.concatenate([exact(vectors[r], known, a[i:i + PAIRS], b[i:i + PAIRS], metric) for i in range(0, max(1, len(a)), PAIRS)])
                keep = slice(None) if at_least is None else value >= at_least
                yield pd.DataFrame({"id": r[a[keep]], "stored_id": known_ids[b[keep]], "value": value[keep]})

        for turn in ("home", "beyond"):
            if turn == "beyond":
                needs = needed_cells(space, rows["vec"], reaches())
                needs[np.arange(len(rows)), home] = False
            asked = needs.any(axis=0)
            for shelf, _, _, low, high in shelves.entries:
                if not asked[low:high + 1].any():
                    continue
                known = take(shelves.folder, shelf).sort_values("id", kind="stable")
                known_ids, known_vectors = known["id"].to_numpy(), M.matrix(known["vec"])
                limits, found = reaches(), []
                for r, c in pairings(home, needs, known["cell"].to_numpy()):
                    found.extend(f for f in meet(r, known_ids[c], known_vectors[c], limits) if len(f))
                if found:
                    best = best_of([*([best] if len(best) else []), *found])
        return pd.DataFrame({
            "id": rows["id"].to_numpy()[best["id"].to_numpy(dtype=np.int64)], "stored_id": best["stored_id"].to_numpy(),
            "value": best["value"].to_numpy(dtype=np.float64), "rank": np.zeros(len(best), dtype=np.int32),
        })

    hold = max(PIECE_ROWS, min(ASKED_ROWS, ASKED_BYTES // size))

    def per_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= hold:
                yield search_shelves(pd.concat(held, ignore_index=True))
                held = []
        if sum(map(len, held)):
            yield search_shelves(pd.concat(held, ignore_index=True))

    # Queries are searched where they are: only what they find is shuffled.
    asking = queries.select("id", "vec").filter(M.finite(F.col("vec")))
    found = asking.mapInPandas(per_task, schema)
    return (
        _best(found.drop("rank"), k, sign)
        .select("id", F.posexplode("best").alias("pos", "b"))
        .select("id", "b.stored_id", "b.value", (F.col("pos") + 1).cast("int").alias("rank"))
    )


def _best(found: DataFrame, k: int, sign: float) -> DataFrame:
    """(id, stored_id, value) -> (id, best): the k best in order.  At most k rows per block and query meet here."""
    each = F.struct((F.col("value") * sign).alias("order"), "stored_id", "value")
    return found.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(each)), 1, k).alias("best"))


# --- groups ------------------------------------------------------------------------


def _by_size(points: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame, bool]:
    """(rows of groups of up to a block, rows of larger groups, whether there are any of these)."""
    large = rewritten(points.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > block_rows).select("g"))
    few = F.broadcast(large)  # at most a row for each block of points
    return points.join(few, "g", "left_anti"), points.join(few, "g", "left_semi"), not large.isEmpty()


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links a - b, where label[i] is the least place that is linked with place i."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        up = np.arange(len(label))
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up[up] != up).any():
            up = up[up]
        label = up[label]


def components(points: DataFrame, radius: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Connected components of the "closer than `radius`" graph inside a group.

    points(g, id, vec) -> (g, id, label); label is the least id of the
    component.  Rows with equal ids are one point.  In a large group each task
    gives the links that join its rows and those they meet, at most one for
    each, and the components of these are found by contraction.
    """
    ensure_checkpoints(points.sparkSession)
    types = dict(points.dtypes)
    square = radius * radius
    rows = points.select("g", "id", "vec").filter("g IS NOT NULL AND id IS NOT NULL AND vec IS NOT NULL")
    small, large, any_large = _by_size(rows, block_rows)
    shape = f"g {types['g']}, id {types['id']}, label {types['id']}"

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        ids, place = np.unique(group["id"].to_numpy(), return_inverse=True)
        vectors, label = M.matrix(group["vec"]), np.arange(len(ids))
        for a, b in near_pairs(vectors, vectors, "l2", square):
            label = joined(label, place[a], place[b])
        return pd.DataFrame({"g": group["g"], "id": group["id"], "label": ids[label[place]]})

    done = small.groupBy("g").applyInPandas(whole, shape)
    if not any_large:
        return done
    space, shelves = shelve(large, "l2", True, block_rows)

    def links(entry: tuple, first: int) -> pd.DataFrame:
        shelf, g = entry[:2]
        own = take(shelves.folder, shelf, g).sort_values(["cell", "id"], kind="stable").iloc[first:first + PIECE_ROWS]
        ids, home, vectors = own["id"].to_numpy(), own["cell"].to_numpy(), M.matrix(own["vec"])
        needs = needed_cells(space, own["vec"], np.full(len(own), math.sqrt(square + M.ROUNDING)))
        label, p, out = np.arange(len(own)), len(own), []
        for other, _, _, low, high in shelves.of(g):
            # Of two shelves the first looks into the second.
            if other < shelf or not needs[:, low:high + 1].any():
                continue
            met = take(shelves.folder, other, g)
            met_ids, met_vectors = met["id"].to_numpy(), M.matrix(met["vec"])
            both = np.concatenate([label, np.arange(p, p + len(met))])
            for r, c in pairings(home, needs, met["cell"].to_numpy()):
                for a, b in near_pairs(vectors[r], met_vectors[c], "l2", square):
                    both = joined(both, r[a], p + c[b])
            label, hit = both[:p], np.flatnonzero(both[p:] < p)
            out.append(pd.DataFrame({"a": ids[both[p + hit]], "b": met_ids[hit]}))
        out.append(pd.DataFrame({"a": ids, "b": ids[label]}))
        found = pd.concat(out)
        return found[found["a"] != found["b"]].assign(g=g)[["g", "a", "b"]]

    found = rewritten(over_pieces(points.sparkSession, shelves, shelves.pieces(), links, f"g {types['g']}, a {types['id']}, b {types['id']}"))
    labels = _contracted(found)
    return done.unionByName(large.select("g", "id").join(labels, ["g", "id"], "left").select("g", "id", F.coalesce("label", "id").alias("label")))


def _contracted(links: DataFrame) -> DataFrame:
    """(g, a, b) -> (g, id, label) of all ends: the least id that each is linked with.

    Each round hooks every end to its least neighbour, if that is less, follows the hooks to their ends and goes on with
    the links that are left between these.
    """
    def falling(rows: DataFrame) -> DataFrame:
        return rows.filter("a != b").select("g", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    links = rewritten(falling(links))
    labels = rewritten(links.select("g", F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("label", F.col("id")))
    while not links.isEmpty():
        up = links.groupBy("g", F.col("a").alias("id")).agg(F.min("b").alias("to"))
        while True:
            beyond = up.select("g", F.col("id").alias("to"), F.col("to").alias("beyond"))
            after = rewritten(up.join(beyond, ["g", "to"], "left").select(
                "g", "id", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")
            ))
            up = after.drop("moved")
            if after.filter("moved").isEmpty():
                break
        labels = rewritten(labels.join(up.select("g", F.col("id").alias("label"), "to"), ["g", "label"], "left").select(
            "g", "id", F.coalesce("to", "label").alias("label")
        ))
        for end in ("a", "b"):
            links = links.join(up.withColumnRenamed("id", end), ["g", end], "left").withColumn(end, F.coalesce("to", end)).drop("to")
        links = rewritten(falling(links))
    return labels


def _walk(ids: np.ndarray, vectors: np.ndarray, above: float) -> np.ndarray:
    """Which rows, in order of their ids, are kept: all of an id, unless one of them is near a kept row of a lesser id."""
    kept = np.zeros(len(ids), dtype=bool)
    starts = [*np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]).tolist(), len(ids)] if len(ids) else [0]
    at = 0
    while at < len(starts) - 1:
        end = at + 1
        while end < len(starts) - 1 and starts[end + 1] - starts[at] <= WALK_ROWS:
            end += 1
        first, last = starts[at], starts[end]
        dropped = np.zeros(last - first, dtype=bool)
        before = vectors[:first][kept[:first]]
        if len(before):
            for r, _ in near_pairs(vectors[first:last], before, "cosine", above):
                dropped[r] = True
        near = None
        if end > at + 1:  # rows of one id are not compared
            near = np.zeros((last - first, last - first), dtype=bool)
            for r, c in near_pairs(vectors[first:last], vectors[first:last], "cosine", above):
                near[r, c] = True
        for i in range(at, end):
            own = slice(starts[i] - first, starts[i + 1] - first)
            seen = dropped[own].any() or (near is not None and (near[own, :own.start] & kept[first:first + own.start]).any())
            kept[starts[i]:starts[i + 1]] = not seen
        at = end
    return kept


def greedy_keep(points: DataFrame, above: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Goes through each group in id order and keeps a point unless an earlier
    kept one has a cosine greater than `above` with it.

    points(g, id, vec) -> (g, id) of the kept points.  A group of up to a block
    is one task's.  Larger ones are cut into ranges of ids, and all groups take
    turns of a range each: its rows are compared with what was kept before, in
    many tasks, and then walked through in one.
    """
    ensure_checkpoints(points.sparkSession)
    spark, types = points.sparkSession, dict(points.dtypes)
    rows = points.select("g", "id", "vec").filter("g IS NOT NULL AND id IS NOT NULL AND vec IS NOT NULL")
    small, large, any_large = _by_size(rows, block_rows)
    shape = f"g {types['g']}, id {types['id']}"

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        return group.loc[_walk(group["id"].to_numpy(), M.matrix(group["vec"]), above), ["g", "id"]]

    done = small.groupBy("g").applyInPandas(whole, shape)
    if not any_large:
        return done
    # Vectors without a distance are near nothing, but they stay unless another row of their id goes.
    reach = math.sqrt(max(0.0, 2 - 2 * above) + M.ROUNDING)
    space, shelves = shelve(large, "cosine", False, block_rows)
    turns: dict = {}
    for i, e in enumerate(shelves.entries):
        turns.setdefault(e[1], []).append(i)
    every = f"{spark.sparkContext.getCheckpointDir()}/kept-{uuid.uuid4().hex}"
    notes: list[str] = []  # kept rows by turn

    def kept_before(g, turn: int) -> Iterator[pd.DataFrame]:
        for t in range(turn):
            shelf = shelves.entries[turns[g][t]][0]
            if has_shelf(notes[t], shelf):
                ids = take(notes[t], shelf, g)[["id"]].drop_duplicates()
                if len(ids):
                    yield take(shelves.folder, shelf, g).merge(ids, on="id")

    for turn in range(max(map(len, turns.values()))):
        now = [own[turn] for own in turns.values() if turn < len(own)]

        def near_kept(entry: tuple, first: int) -> pd.DataFrame:
            shelf, g = entry[:2]
            own = take(shelves.folder, shelf, g).sort_values(["cell", "id"], kind="stable").iloc[first:first + PIECE_ROWS]
            own = own[own["cell"] >= 0]
            dropped = np.zeros(len(own), dtype=bool)
            if len(own):
                home, vectors = own["cell"].to_numpy(), M.matrix(own["vec"])
                needs = needed_cells(space, own["vec"], np.full(len(own), reach))
                for kept in kept_before(g, turn):
                    kept = kept[kept["cell"] >= 0]
                    kept_vectors = M.matrix(kept["vec"]) if len(kept) else None
                    left = np.flatnonzero(~dropped)
                    for r, c in pairings(home[left], needs[left], kept["cell"].to_numpy()) if len(kept) and len(left) else ():
                        for a, _ in near_pairs(vectors[left[r]], kept_vectors[c], "cosine", above):
                            dropped[left[r[a]]] = True
            return own.loc[dropped, ["id"]].assign(g=g, shelf=shelf)[["shelf", "g", "id"]]

        gone = None
        if turn:
            pieces = [(i, at) for i, at in shelves.pieces(PIECE_ROWS) if i in set(now)]
            gone = noted(over_pieces(spark, shelves, pieces, near_kept, f"shelf int, {shape}"))

        def walked(entry: tuple, _: int) -> pd.DataFrame:
            shelf, g = entry[:2]
            own = take(shelves.folder, shelf, g).sort_values("id", kind="stable")
            if gone is not None and has_shelf(gone, shelf):
                own = own[~own["id"].isin(take(gone, shelf, g)["id"])]
            if len(own):
                own = own[_walk(own["id"].to_numpy(), M.matrix(own["vec"]), above)]
            return own[["id"]].assign(g=g, shelf=shelf)[["shelf", "g", "id"]]

        notes = [*notes, noted(over_pieces(spark, shelves, [(i, 0) for i in now], walked, f"shelf int, {shape}"), f"{every}/turn={turn}")]
    return done.unionByName(spark.read.schema(shape).parquet(every).select("g", "id"))
