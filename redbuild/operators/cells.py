"""Metric cells: which stored vectors can lie within a distance of a query.

A bounded number of pivots is drawn from the stored side, and every stored vector belongs to the cell of its nearest
pivot.  A cell is left out for a query if one of two bounds says that all of it is too far: the ring between the cell's
least and greatest distance from its pivot (triangle inequality), and the plane halfway between the cell's pivot and the
query's own.  Both are bounds, so what is found in the remaining cells is exact.

Cosines are distances of unit vectors: |a - b|^2 = 2 - 2 cos(a, b).  A zero vector, whose cosine is 0 with everything,
gets a direction of its own, one for stored vectors and one for queries, sqrt(2) away from all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_PIVOTS = 2_048
PIVOT_BYTES = 8 << 20  # and they take no more than this in every task
TILE = 4_000_000  # distances to pivots held at once
SLACK = 4e-6  # error of a distance, as a share of the largest length
ROUNDING = 4e-9  # values are rounded to nine places


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def place(vectors: np.ndarray, metric: str, stored: bool) -> np.ndarray:
    """Coordinates in which the metric is the Euclidean distance of a stored vector and a query."""
    if metric == "l2":
        return vectors
    lengths = np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    unit = np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)
    zero = (lengths == 0).astype(np.float64)
    return np.hstack([unit, zero * stored, zero * (not stored)])


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (rows * rows).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(squares, 0.0))


def finite(vec: Column) -> Column:
    """Whether a vector has a distance from anything."""
    return F.forall(vec, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


@dataclass
class Cells:
    """Pivots, and for each cell the least and greatest distance from its pivot and the number of its vectors."""

    metric: str
    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray
    counts: np.ndarray

    @cached_property
    def between(self) -> np.ndarray:
        return distances(self.pivots, self.pivots)

    @cached_property
    def scale(self) -> float:
        """No stored vector is longer."""
        return float(np.sqrt((self.pivots * self.pivots).sum(axis=1)).max(initial=0.0) + self.high.max(initial=0.0))

    def tiles(self, vectors: pd.Series, stored: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, their distances to the pivots, their home cells), a few rows at a time."""
        placed = place(matrix(vectors), self.metric, stored)
        step = max(1, TILE // max(1, len(self.pivots)))
        for at in range(0, len(placed), step):
            rows = placed[at:at + step]
            away = distances(rows, self.pivots)
            yield rows, away, away.argmin(axis=1)

    def upper(self, away: np.ndarray, k: int) -> np.ndarray:
        """A distance within which each row surely has k stored vectors; infinite if there are fewer."""
        far = np.where(self.counts > 0, away + self.high, np.inf)
        order = np.argsort(far, axis=1, kind="stable")
        enough = np.cumsum(self.counts[order], axis=1) >= k
        at = np.take_along_axis(order, enough.argmax(axis=1)[:, None], axis=1)
        return np.where(enough.any(axis=1), np.take_along_axis(far, at, axis=1)[:, 0], np.inf)

    def within(self, rows: np.ndarray, away: np.ndarray, home: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """rows x cells: whether a cell may hold a vector within `reach` of a row.  The home cell always may."""
        own = np.arange(len(rows))
        ring = np.maximum(away - self.high, self.low - away)
        nearest = away[own, home][:, None]
        between = self.between[home]
        # Close pivots would blow up rounding errors; half the difference is a weaker bound that doesn't.
        wide = between > 1e-3 * self.scale
        plane = np.divide(away * away - nearest * nearest, 2 * between, out=(away - nearest) / 2, where=wide)
        slack = SLACK * (self.scale + np.sqrt((rows * rows).sum(axis=1)))
        hit = (np.maximum(ring, plane) <= (reach + slack)[:, None]) & (self.counts > 0)
        hit[own, home] = True
        return hit


def draw(points: DataFrame, metric: str, n: int, row_bytes: int) -> np.ndarray:
    """About 2 sqrt(n) different vectors, by hash of their id: a bounded number of bytes."""
    most = max(1, min(MOST_PIVOTS, PIVOT_BYTES // row_bytes, int(2 * n ** 0.5)))
    picked = points.filter(finite(F.col("vec"))).orderBy(F.xxhash64("id"), "id").limit(most).select("vec").toPandas()
    if not len(picked):
        return np.zeros((0, 0))
    return np.unique(place(matrix(picked["vec"]), metric, True), axis=0)


def home_of(space: Cells, vec: Column | str = "vec") -> Column:
    """Stored vec -> struct(cell, away): the nearest pivot and its distance."""

    @F.pandas_udf("cell int, away double")
    def home(vectors: pd.Series) -> pd.DataFrame:
        found = [
            pd.DataFrame({"cell": cell, "away": away[np.arange(len(away)), cell]})
            for _, away, cell in (space.tiles(vectors, True) if len(vectors) else ())
        ]
        empty = pd.DataFrame({"cell": [], "away": []})
        return (pd.concat(found) if found else empty).astype({"cell": "int32", "away": "float64"})

    return home(vec)


def cells_within(space: Cells, reach: Column) -> Column:
    """(vec, reach) -> array of the cells that may hold a stored vector within `reach`, the home cell among them."""

    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series, reaches: pd.Series) -> pd.Series:
        found, limits, at = [], reaches.to_numpy(dtype=np.float64), 0
        for rows, away, home in space.tiles(vectors, False) if len(vectors) else ():
            hit = space.within(rows, away, home, limits[at:at + len(rows)])
            found.extend(np.nonzero(row)[0].astype(np.int32) for row in hit)
            at += len(rows)
        return pd.Series(found, dtype=object)

    return cells("vec", reach)


def drawn(points: DataFrame, metric: str, n: int, row_bytes: int) -> Cells:
    """Cells of which only the pivots are known."""
    pivots = draw(points, metric, n, row_bytes)
    m = len(pivots)
    return Cells(metric, pivots, np.zeros(m), np.zeros(m), np.zeros(m, dtype=np.int64))


def measured(space: Cells, dealt: DataFrame) -> Cells:
    """The cells as dealt(cell, away) fills them: one row per pivot comes back."""
    facts = dealt.groupBy("cell").agg(F.min("away").alias("low"), F.max("away").alias("high"), F.count("*").alias("n")).toPandas()
    m = len(space.pivots)
    low, high, counts = np.full(m, np.inf), np.zeros(m), np.zeros(m, dtype=np.int64)
    low[facts["cell"]], high[facts["cell"]], counts[facts["cell"]] = facts["low"], facts["high"], facts["n"]
    return Cells(space.metric, space.pivots, low, high, counts)


def deal(points: DataFrame, metric: str, n: int, row_bytes: int) -> tuple[Cells, DataFrame]:
    """The cells of `points` (with id and vec) and the points with their `cell`, checkpointed.

    Vectors that have no distance from anything are left out.
    """
    bare = drawn(points, metric, n, row_bytes)
    if not len(bare.pivots):
        return bare, points.limit(0).withColumn("cell", F.lit(0)).checkpoint()
    dealt = points.filter(finite(F.col("vec"))).withColumn("h", home_of(bare)).select(
        *points.columns, "h.cell", "h.away"
    ).checkpoint()
    return measured(bare, dealt), dealt.drop("away")


def pair_share(visits: DataFrame, dealt: DataFrame, n_left: int) -> float:
    """Share of all pairs that is compared: visits(cell), one row per query and cell searched; dealt(cell)."""
    here = dealt.groupBy("cell").agg(F.count("*").alias("n"))
    asked = visits.groupBy("cell").agg(F.count("*").alias("v"))
    met = here.join(asked, "cell", "left").agg(F.sum(F.col("n") * F.col("v")).alias("met"), F.sum("n").alias("n")).first()
    return (met["met"] or 0) / max(1, n_left * (met["n"] or 0))
