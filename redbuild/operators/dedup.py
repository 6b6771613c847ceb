"""Similar signals of a failure: clusters, representatives, near-duplicate removal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from . import neighbours as N
from .density import density_labels

# --- fixed values ---------------------------------------------------------------
CLUSTER_RADIUS = 0.1
MIN_CLUSTER = 2
NOISE_COSINE = 0.85
WIDE = 256

Embedder = Callable[[DataFrame], DataFrame]


def hashing_embedder(texts: DataFrame) -> DataFrame:
    """Default embedder: (key, text) -> (key, embedding), all in the JVM."""
    return texts.select("key", V.hashed_words(F.col("text")).alias("embedding"))


def embed_signals(signals: DataFrame, embedder: Embedder = hashing_embedder, stored: DataFrame | None = None) -> DataFrame:
    """Adds `embedding`.  A fingerprint is embedded once, whatever the number of
    its occurrences: with the text of its first one.

    `stored` (fingerprint, embedding), one row each, are vectors of earlier runs:
    what is there does not go to the embedder again.
    """
    first = F.min_by(
        F.struct("error_line", "pre_content", "post_content"), F.struct("failure_id", "stage", "line_no")
    )
    texts = signals.groupBy("fingerprint").agg(first.alias("s")).select(
        F.col("fingerprint").alias("key"),
        X.dedup_text(F.col("s.error_line"), F.col("s.pre_content"), F.col("s.post_content")).alias("text"),
    )
    if stored is None:
        vectors = embedder(texts).withColumnRenamed("key", "fingerprint")
    else:
        known = stored.join(texts.select(F.col("key").alias("fingerprint")), "fingerprint", "left_semi").select("fingerprint", "embedding")
        fresh = texts.join(stored.select(F.col("fingerprint").alias("key")), "key", "left_anti")
        vectors = embedder(fresh).withColumnRenamed("key", "fingerprint").unionByName(known)
    return signals.join(vectors, "fingerprint", "left")


def collapse_copies(points: DataFrame) -> DataFrame:
    """(g, id, vec) -> (g, id, vec, copies): equal vectors become their first point.

    Combines before the shuffle, so copies that fill a third of the rows are cheap.
    """
    return points.groupBy("g", "vec").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select(
        "g", "id", "vec", "copies"
    )


def clusters(points: DataFrame, radius: float = CLUSTER_RADIUS, block_rows: int = N.BLOCK_ROWS) -> DataFrame:
    """(g, id, vec) -> (g, id, vec, copies, label, members) with unit vectors.

    Density clustering with single links: components of the graph of points
    within `radius`; fewer than two members is noise (members = 1).  One row
    per distinct vector.
    """
    distinct = collapse_copies(points.select("g", "id", V.unit(F.col("vec")).alias("vec")))
    N.ensure_checkpoints(points.sparkSession)
    distinct = N.rewritten(distinct)
    # Used twice, for the sizes too: every pair would be compared twice.
    labelled = distinct.join(N.rewritten(N.components(distinct, radius, block_rows)), ["g", "id"])
    sizes = labelled.groupBy("g", "label").agg(F.sum("copies").alias("members"))
    return labelled.join(sizes, ["g", "label"]).select("g", "id", "vec", "copies", "label", "members")


def density_clusters(
    points: DataFrame, least: int = MIN_CLUSTER, epsilon: float = CLUSTER_RADIUS, block_rows: int = N.BLOCK_ROWS, **limits: int
) -> DataFrame:
    """`clusters` at any density: stable parts of each group's single-link tree (density.py), of `least` points or more;
    those tighter than `epsilon` are joined to what is around them.

    Noise has its own id as label and members = 1, whatever its copies.
    """
    N.ensure_checkpoints(points.sparkSession)
    distinct = N.rewritten(collapse_copies(points.select("g", "id", V.unit(F.col("vec")).alias("vec"))))
    found = density_labels(distinct, least, epsilon, block_rows, **limits).checkpoint()
    sizes = found.filter("label IS NOT NULL").join(distinct.select("g", "id", "copies"), ["g", "id"]).groupBy("g", "label").agg(
        F.sum("copies").alias("members")
    )
    return distinct.join(found, ["g", "id"]).join(sizes, ["g", "label"], "left").select(
        "g", "id", "vec", "copies", F.coalesce("label", "id").alias("label"), F.coalesce("members", F.lit(1).cast("long")).alias("members")
    )


def medoids(clustered: DataFrame) -> DataFrame:
    """The point nearest to the mean of its cluster, first on ties: (g, label, id, members).

    The mean is one average per dimension, combined before the shuffle: as one
    aggregate each up to WIDE dimensions, as one row each beyond.
    """
    real = clustered.filter(F.col("members") >= MIN_CLUSTER)
    widths = clustered.agg(F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most")).first()
    if widths["least"] != widths["most"]:
        raise ValueError(f"vectors of {widths['least']} to {widths['most']} dimensions")
    dimensions = widths["most"] or 0
    if dimensions <= WIDE:
        total = F.sum("copies")
        means = real.groupBy("g", "label").agg(
            F.array(*[F.sum(F.get("vec", F.lit(i)) * F.col("copies")) / total for i in range(dimensions)]).alias("mean")
        )
    else:
        each = real.select("g", "label", "copies", F.posexplode("vec").alias("i", "x")).groupBy("g", "label", "i").agg(
            (F.sum(F.col("x") * F.col("copies")) / F.sum("copies")).alias("x")
        )
        means = each.groupBy("g", "label").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("mean")
        )
    distance = F.round(F.sqrt(V.squared_l2(F.col("vec"), F.col("mean"))), 9)
    return (
        real.join(means, ["g", "label"])
        .groupBy("g", "label")
        .agg(F.min_by("id", F.struct(distance, "id")).alias("id"), F.first("members").alias("members"))
    )


def keep_noise(clustered: DataFrame, above: float = NOISE_COSINE, block_rows: int = N.BLOCK_ROWS) -> DataFrame:
    noise = clustered.filter(F.col("members") < MIN_CLUSTER).select("g", "id", "vec")
    return N.greedy_keep(noise, above, block_rows)


def representatives(points: DataFrame, block_rows: int = N.BLOCK_ROWS, clustering: Callable[..., DataFrame] = clusters) -> DataFrame:
    """(g, id, vec) -> (g, id, kind) of what stays: medoids and kept noise.  `clustering` is clusters or density_clusters."""
    clustered = clustering(points, block_rows=block_rows).checkpoint()
    return (
        medoids(clustered).select("g", "id", F.lit("cluster").alias("kind"))
        .unionByName(keep_noise(clustered, block_rows=block_rows).select("g", "id", F.lit("noise").alias("kind")))
    )


def signal_order() -> Column:
    """Position of a signal in its failure, as one sortable value."""
    return F.concat_ws("\u0001", "stage", F.lpad(F.col("line_no").cast("string"), 19, "0"))


def deduplicate(embedded: DataFrame, block_rows: int = N.BLOCK_ROWS, clustering: Callable[..., DataFrame] = clusters) -> DataFrame:
    """Representative signals of each failure, with `kind`."""
    keyed = embedded.withColumn("id", signal_order())
    N.ensure_checkpoints(embedded.sparkSession)
    keyed = keyed.checkpoint()
    kept = representatives(
        keyed.select(F.col("failure_id").alias("g"), "id", F.col("embedding").alias("vec")), block_rows, clustering
    ).withColumnRenamed("g", "failure_id")
    return keyed.join(kept, ["failure_id", "id"]).drop("id")
