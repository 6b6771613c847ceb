"""Vector functions on ARRAY<FLOAT> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-10
DIMENSIONS = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """v / (|v| + 1e-10), as doubles."""
    return F.transform(
        F.array(norm(v)), lambda n: F.transform(v, lambda x: x.cast("double") / (n + EPSILON))
    )[0]


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")),
        F.lit(0.0),
        lambda acc, d: acc + d * d,
    )


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def hashed_words(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Default embedding: word counts folded into `dimensions` buckets, unit length.

    Two texts with the same words get the same vector.  An empty text gets the
    zero vector.
    """
    words = F.filter(F.split(text, " "), lambda w: w != "")
    buckets = F.transform(
        words,
        lambda w: (F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("long") % dimensions),
    )
    counts = F.transform(
        F.array(buckets),
        lambda bs: F.transform(
            F.sequence(F.lit(0), F.lit(dimensions - 1)),
            lambda d: F.size(F.filter(bs, lambda b: b == d)),
        ),
    )[0]
    return unit(counts).cast("array<float>")
