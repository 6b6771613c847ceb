"""CI jobs and steps: status names, failed stages, stage logs, run selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------------
CONCLUSIONS = {
    "success": "SUCCESS",
    "failure": "FAILURE",
    "skipped": "NOT_BUILT",
    "cancelled": "ABORTED",
    "timed_out": "FAILURE",
    "action_required": "UNSTABLE",
}
NOT_FAILED = ["SUCCESS", "NOT_BUILT"]


def normalized_status(conclusion: Column) -> Column:
    known = reduce(
        lambda acc, kv: acc.when(F.lower(conclusion) == kv[0], kv[1]), CONCLUSIONS.items(), F
    ).otherwise("UNSTABLE")
    return F.when(conclusion.isNull() | (conclusion == ""), "NOT_BUILT").otherwise(known)


def failed_stages(jobs: DataFrame) -> DataFrame:
    """Jobs whose logs are worth reading; a job without a result counts as failed."""
    return jobs.filter(F.col("result").isNull() | ~F.col("result").isin(*NOT_FAILED))


def stage_logs(steps: DataFrame) -> DataFrame:
    """steps(run, stage, pos, log) -> (run, stage, content), logs in step order.

    One row per stage holds its whole text, as the sink wants it; use
    `stage_lines` where the text goes on into extraction.
    """
    ordered = F.array_sort(F.collect_list(F.struct("pos", "log")))
    return steps.groupBy("run", "stage").agg(
        F.array_join(F.transform(ordered, lambda s: s["log"]), "").alias("content")
    )


def stage_lines(steps: DataFrame, positions: int = 1024) -> DataFrame:
    """steps(run, stage, pos, log) -> lines(failure_id, stage, line_no, raw).

    Never builds the text of a stage: each step is cut into lines on its own
    and shifted by the lines before it.  Positions are taken in ranges, whose
    line counts are summed first, one small row per range, so the text is
    shuffled once, by range, and a large stage is many tasks' work.  Steps end
    with a line break (an open last line is its own line); steps at one
    position follow each other by their text, those without one come first.
    """
    from pyspark.sql import Window

    place = F.coalesce(F.floor(F.col("pos") / positions), F.lit(-(1 << 62)))
    cut = steps.withColumn("range", place).withColumn("parts", F.split(F.regexp_replace("log", r"\r\n?", "\n"), "\n")).withColumn(
        "parts",
        F.when(F.element_at("parts", -1) == "", F.slice("parts", F.lit(1), F.size("parts") - 1))
        .otherwise(F.col("parts")),
    )
    key = ["run", "stage", "range"]
    before = Window.partitionBy("run", "stage").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*key).agg(F.sum(F.size("parts")).alias("n")).select(
        *key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy(*key).orderBy("pos", "log").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.join(starts, key).withColumn(
        "start", F.col("start") + F.coalesce(F.sum(F.size("parts")).over(inside), F.lit(0))
    )
    return placed.select("run", "stage", "start", F.posexplode("parts").alias("i", "raw")).select(
        F.col("run").alias("failure_id"), "stage", (F.col("start") + F.col("i")).alias("line_no"), "raw"
    )


def one_log_per_job(steps: DataFrame, repeat_per_step: bool = False) -> DataFrame:
    """The log service returns the whole job log for every step; one copy is kept
    unless `repeat_per_step` asks for all of them."""
    if repeat_per_step:
        return steps
    first = F.min_by(F.struct("pos", "log"), "pos")
    return steps.groupBy("run", "stage").agg(first.alias("s")).select("run", "stage", "s.*")


def select_runs(runs: DataFrame, branch: str | None = None, commit: str | None = None, limit: int = 1) -> DataFrame:
    """Newest runs of a branch, then those whose commit starts with `commit`."""
    picked = runs if branch is None else runs.filter(F.col("branch") == branch)
    picked = picked.orderBy(F.desc("created_at"), F.desc("run")).limit(limit)
    return picked if commit is None else picked.filter(F.col("commit").startswith(commit))
