"""Report tables of a failure: summary, rows, owners, recipients, counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: sections in report order, mail field of each owner ---------------
SECTIONS = ["DEVOPS_ENGINEERS", "DEVELOPERS", "TEST_ENGINEERS", "UNOWNED"]
MAIL_FIELDS = {"DEVOPS_ENGINEERS": "ci_email", "DEVELOPERS": "dev_email", "TEST_ENGINEERS": "test_email"}


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.80, "High").when(c >= 0.50, "Medium").otherwise("Low")


def recurrence_band(n: Column) -> Column:
    return F.when(n >= 5, "5+").when(n >= 2, "2+").when(n > 0, "1")


def percent(x: Column) -> Column:
    return (x * 100).cast("int")


def short_fingerprint(fp: Column) -> Column:
    return F.concat(F.substring(fp, 1, 16), F.lit("..."))


def section_rank(owner: Column) -> Column:
    return reduce(
        lambda acc, kv: acc.when(owner == kv[1], kv[0]), enumerate(SECTIONS, 1), F
    ).otherwise(len(SECTIONS) + 1)


def summary(root_causes: DataFrame) -> DataFrame:
    average = F.avg("rca_confidence")
    return root_causes.groupBy("failure_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("owner") == "DEVOPS_ENGINEERS").alias("devops"),
        F.count_if(F.col("owner") == "DEVELOPERS").alias("developers"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        average.alias("avg_confidence"),
        F.bround(average * 100, 0).cast("int").alias("avg_percent"),
        confidence_band(average).alias("avg_band"),
    )


def owner_counts(root_causes: DataFrame) -> DataFrame:
    return root_causes.groupBy("failure_id", "owner").agg(F.count("*").alias("rows"))


def _bucket(root_causes: DataFrame, order: str, buckets: int, prefix: int) -> Column:
    """Ranges of the order value, in its order; NULL is the first."""
    if dict(root_causes.dtypes)[order] == "string":
        return F.coalesce(F.substring(order, 1, prefix), F.lit(""))
    value = F.col(order).cast("double")
    low, high = root_causes.agg(F.min(value), F.max(value)).first()
    if low is None or low == high:
        return F.when(value.isNotNull(), 0).otherwise(-1)
    place = F.floor((value - low) / (high - low) * buckets).cast("int")
    return F.when(value.isNotNull(), F.least(place, F.lit(buckets - 1))).otherwise(-1)


def rows(root_causes: DataFrame, order: str | list[str] = "fingerprint", buckets: int = 1024, prefix: int = 4) -> DataFrame:
    """Report rows with `number` running through the sections of a failure, in
    the order of the given columns (the signals' order, where they have it).

    A failure may hold most rows, so they are numbered inside buckets (ranges
    of the first column's values) and shifted by the rows of the buckets
    before, one small row per bucket.
    """
    order = [order] if isinstance(order, str) else list(order)
    ranked = root_causes.withColumn("section", section_rank(F.col("owner"))).withColumn(
        "bucket", _bucket(root_causes, order[0], buckets, prefix)
    )
    key = ["failure_id", "section", "bucket"]
    inside = Window.partitionBy(*key).orderBy(*order)
    before = Window.partitionBy("failure_id").orderBy("section", "bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    sizes = ranked.groupBy(*key).agg(F.count("*").alias("n")).select(
        *key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")
    )
    numbered = ranked.withColumn("inside", F.row_number().over(inside)).join(sizes, key)
    return numbered.select(
        "failure_id", (F.col("shift") + F.col("inside")).alias("number"), "owner", "validated_category",
        "root_cause", "error_line", "severity", "rca_confidence",
        confidence_band(F.col("rca_confidence")).alias("confidence_band"),
        percent(F.col("rca_confidence")).alias("confidence_percent"),
        recurrence_band(F.col("recurrence_count")).alias("recurrence_band"),
        percent(F.col("similarity_score")).alias("match_percent"),
        short_fingerprint(F.col("fingerprint")).alias("fingerprint"),
        "analyzed_at", "evidence_url",
    )


def recipients(root_causes: DataFrame, mail: DataFrame, default_mail: str) -> DataFrame:
    """Distinct addresses of the owners of a failure, else the default.

    mail(failure_id, ci_email, dev_email, test_email); a failure without root
    causes gets the default too.
    """
    owners = root_causes.select("failure_id", "owner").distinct()
    address = reduce(lambda acc, kv: acc.when(F.col("owner") == kv[0], F.col(kv[1])), MAIL_FIELDS.items(), F)
    return (
        mail.join(owners, "failure_id", "left")
        .withColumn("address", F.nullif(address, F.lit("")))
        .groupBy("failure_id")
        .agg(F.array_sort(F.collect_set("address")).alias("found"))
        .select(
            "failure_id",
            F.when(F.size("found") > 0, F.col("found")).otherwise(F.array(F.lit(default_mail))).alias("recipients"),
        )
    )


def stage_counters(signals: DataFrame, deduplicated: DataFrame, hit_fingerprints: DataFrame, failures: DataFrame) -> DataFrame:
    """Per failure: signals found, kept (clusters, noise), cache hits, left to classify."""
    found = signals.groupBy("failure_id").agg(F.count("*").alias("signals"))
    known = hit_fingerprints.select("failure_id", "fingerprint", F.lit(True).alias("hit"))
    kept = deduplicated.join(known, ["failure_id", "fingerprint"], "left").groupBy("failure_id").agg(
        F.count("*").alias("kept"),
        F.count_if(F.col("kind") == "cluster").alias("clusters"),
        F.count_if(F.col("kind") == "noise").alias("noise_kept"),
        F.count_if(F.col("hit").isNotNull()).alias("cache_hits"),
    )
    counts = ["signals", "kept", "clusters", "noise_kept", "cache_hits"]
    return (
        failures.select("failure_id").distinct()
        .join(found, "failure_id", "left").join(kept, "failure_id", "left")
        .select("failure_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
        .withColumn("to_classify", F.col("kept") - F.col("cache_hits"))
        .withColumn("no_signals", F.col("kept") == 0)
    )
