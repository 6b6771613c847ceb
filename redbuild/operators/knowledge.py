"""Known failure patterns: lookup by similarity and upsert by fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import neighbours as N

HIT_COSINE = 0.92  # fixed value
MUTABLE = ["rca_confidence", "remediation", "secondary_remediations"]


def lookup(queries: DataFrame, patterns: DataFrame, at_least: float = HIT_COSINE, **search) -> DataFrame:
    """(id, vec) against patterns (fingerprint, embedding, ...) ->
    (id, pattern_fingerprint, similarity_score) of the most similar one, if similar
    enough.  Similarities are clipped to [0, 1]."""
    stored = patterns.select(F.col("fingerprint").alias("id"), F.col("embedding").alias("vec"))
    return N.nearest(queries, stored, 1, "cosine", at_least=at_least, **search).select(
        "id", F.col("stored_id").alias("pattern_fingerprint"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value"))).alias("similarity_score"),
    )


def hits(signals: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return signals.join(found.select(F.col("id").alias(key)), key, "left_semi")


def misses(signals: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return signals.join(found.select(F.col("id").alias(key)), key, "left_anti")


def only_usable(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """Hits whose pattern is among the usable ones; the rest are misses."""
    known = patterns.select(F.col("fingerprint").alias("pattern_fingerprint"))
    return found.join(known, "pattern_fingerprint", "left_semi").select(*found.columns)


def cached_root_causes(signals: DataFrame, found: DataFrame, patterns: DataFrame) -> DataFrame:
    """Stored root causes of the hits, as rows of the failure they were found for.

    patterns are those that rca.usable() lets through; a hit on any other is none (see only_usable).
    """
    stored = patterns.drop("embedding").withColumnRenamed("fingerprint", "pattern_fingerprint")
    return (
        signals.select("failure_id", "fingerprint", *[c for c in ("stage", "line_no") if c in signals.columns])
        .join(found.withColumnRenamed("id", "fingerprint"), "fingerprint")
        .drop("fingerprint")
        .join(stored.drop("similarity_score", "failure_id", "stage", "line_no"), "pattern_fingerprint")
        .withColumnRenamed("pattern_fingerprint", "fingerprint")
    )


def upsert(patterns: DataFrame | None, arrivals: DataFrame, order: list[str]) -> DataFrame:
    """Table after inserting `arrivals` in `order`, one at a time.

    The first row of a fingerprint is inserted with its own recurrence count;
    each later one adds 1 and replaces confidence and remediations, nothing
    else.  Aggregates combine before the shuffle, so a recurring fingerprint is
    no hot key.  Rows without an embedding are not accepted.
    """
    arrivals = arrivals.filter(F.col("embedding").isNotNull())
    rank = F.struct(F.lit(1).alias("generation"), *[F.col(c) for c in order])
    rows = arrivals.withColumn("_at", rank)
    columns = [c for c in arrivals.columns if c not in order or c in (patterns.columns if patterns else [])]
    if patterns is not None:
        columns = patterns.columns
        types = dict(arrivals.dtypes)
        oldest = F.struct(
            F.lit(0).alias("generation"), *[F.lit(None).cast(types[c]).alias(c) for c in order]
        )
        rows = rows.select(*columns, "_at").unionByName(patterns.withColumn("_at", oldest))
    stable = [c for c in columns if c not in MUTABLE and c != "fingerprint"]
    mutable = [c for c in MUTABLE if c in columns]
    merged = rows.groupBy("fingerprint").agg(
        F.min_by(F.struct(*stable), "_at").alias("first"),
        F.max_by(F.struct(*mutable), "_at").alias("last"),
        F.count("*").alias("n"),
    )
    return merged.select(
        "fingerprint", "first.*", "last.*", "n"
    ).withColumn(
        "recurrence_count", (F.col("recurrence_count") + F.col("n") - 1).cast("int")
    ).select(*columns)
