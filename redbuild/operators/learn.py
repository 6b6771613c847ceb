"""Training data: labelled samples from templates, and feedback from classified signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import category_rules as C
from ..functions import text as X
from ..functions import training_rules as T
from .dedup import Embedder, hashing_embedder
from .neighbours import ensure_checkpoints


def _fill(text: Column, key: str, words: list[str], seed: Column) -> Column:
    """Replaces each occurrence of {key} by a word drawn from an md5 digest."""
    choices = F.array(*[F.lit(w) for w in words])

    def piece(part: Column, at: Column) -> Column:
        digits = F.substring(F.md5(F.concat_ws("/", seed, F.lit(key), at.cast("string")).cast("binary")), 1, 6)
        draw = F.conv(digits, 16, 10).cast("int") % len(words)
        return F.when(at == 0, part).otherwise(F.concat(F.get(choices, draw), part))

    return F.array_join(F.transform(F.split(text, r"\{" + key + r"\}"), piece), "")


def training_samples(
    spark: SparkSession, samples_per_template: int = T.SAMPLES_PER_TEMPLATE, seed: int = T.SEED
) -> DataFrame:
    """sample_id, category, stage, error_line, post_content, pre_content.

    Deterministic; the words are drawn by hash.
    """
    rows = [
        (number, category, T.STAGE_OF[category], error, post)
        for number, (category, (error, post)) in enumerate(
            (c, t) for c, templates in T.TEMPLATES.items() for t in templates
        )
    ]
    frame = spark.createDataFrame(
        rows, "template int, category string, stage string, error_line string, post_content string"
    ).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(samples_per_template - 1))))
    for field in ("error_line", "post_content"):
        draw = F.concat_ws("/", F.lit(str(seed)), F.lit(field), F.col("template").cast("string"), F.col("i").cast("string"))
        for key, words in T.WORDS.items():
            if any("{" + key + "}" in (r[3] if field == "error_line" else r[4]) for r in rows):
                frame = frame.withColumn(field, _fill(F.col(field), key, words, draw))
    return frame.select(
        (F.col("template") * samples_per_template + F.col("i")).cast("long").alias("sample_id"),
        "category", "stage", "error_line", "post_content", F.lit("").alias("pre_content"),
        F.lit(None).cast("string").alias("fingerprint"),
    )


def embed_samples(samples: DataFrame, embedder: Embedder = hashing_embedder) -> DataFrame:
    """Adds `embedding` from the training form of the text."""
    texts = samples.select(
        F.col("sample_id").alias("key"),
        X.training_text(F.col("error_line"), F.col("pre_content"), F.col("post_content")).alias("text"),
    )
    return samples.join(embedder(texts).withColumnRenamed("key", "sample_id"), "sample_id")


def samples_per_category(samples: DataFrame) -> DataFrame:
    return samples.groupBy("category").agg(F.count("*").alias("samples")).orderBy("category")


def learnable(classified: DataFrame, training: DataFrame) -> DataFrame:
    """First signal of each confident fingerprint that was not learned before."""
    confident = classified.filter((F.col("category") != C.UNKNOWN) & (F.col("confidence") > C.LEARN_ABOVE))
    rest = [c for c in confident.columns if c != "fingerprint"]
    order = [c for c in ("failure_id", "stage", "line_no") if c in rest]
    fresh = confident.groupBy("fingerprint").agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("s")
    ).select("fingerprint", "s.*")
    learned = training.filter(F.col("fingerprint").isNotNull()).select("fingerprint")
    return fresh.join(learned, "fingerprint", "left_anti")


def feedback_batch(pending: DataFrame, order: list[str], batch: int = C.FEEDBACK_BATCH) -> tuple[DataFrame, DataFrame]:
    """(rows to learn now, rows that stay pending): full batches only.

    Fewer than `batch` rows stay, the last ones in `order`, so only these are
    looked for; nothing is sorted as a whole.
    """
    ensure_checkpoints(pending.sparkSession)
    pending = pending.checkpoint()  # counted, cut and read
    left_over = pending.count() % batch
    stay = pending.orderBy(*[F.desc(c) for c in order]).limit(left_over)
    return pending.join(F.broadcast(stay.select("fingerprint")), "fingerprint", "left_anti"), stay


def as_samples(feedback: DataFrame, training: DataFrame) -> DataFrame:
    """Feedback rows in the form of training rows (ids from the fingerprint)."""
    return feedback.select(
        F.pmod(F.xxhash64("fingerprint"), F.lit(1 << 62)).alias("sample_id"), "category", "stage",
        "error_line", "post_content", "pre_content", "fingerprint",
    )
