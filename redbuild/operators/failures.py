"""Failure records: intake, platform, duplicates, status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: states in order, and the legal moves ---------------------------
STATES = ["RECEIVED", "LOGS_COLLECTED", "CLASSIFIED", "ANALYZING", "RESOLVED", "FAILED"]
MOVES = {
    "RECEIVED": ["LOGS_COLLECTED", "FAILED"],
    "LOGS_COLLECTED": ["CLASSIFIED", "RESOLVED", "FAILED"],
    "CLASSIFIED": ["ANALYZING", "FAILED"],
    "ANALYZING": ["RESOLVED", "FAILED"],
    "RESOLVED": ["FAILED"],
    "FAILED": ["FAILED"],
}
# Step of the pipeline -> states it runs in.
GATES = {
    "collect": ["RECEIVED"],
    "classify": ["LOGS_COLLECTED"],
    "analyze": ["CLASSIFIED"],
    "notify_only": ["RESOLVED"],
}
INTAKE_KEYS = ["platform", "commit", "branch", "job_name", "build_number"]


def _given(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c).cast("string") != "")


def platform_of(payloads: DataFrame) -> DataFrame:
    """Adds platform, run_id (build_number where absent) and `reject_reason`
    (NULL for a usable payload)."""
    github = _given("owner") & _given("repo")
    run = F.when(_given("run_id") & (F.col("run_id") != 0), F.col("run_id")).otherwise(F.col("build_number"))
    no_run = run.isNull() | (run == 0)
    no_build = F.col("build_number").isNull() | (F.col("build_number") == 0)
    return payloads.withColumns({
        "platform": F.when(github, "github").otherwise("jenkins"),
        "reject_reason": F.when(github & no_run, "run_id missing")
        .when(~github & _given("job_name") & no_build, "build_number missing")
        .when(~github & ~_given("job_name"), "platform unknown"),
        "effective_run": run,
    })


def intake(payloads: DataFrame, now: Column | None = None, keep: list[str] = ()) -> DataFrame:
    """Usable payloads -> failure records with status RECEIVED; quarantine() has the others.

    The id is a digest of the payload's known fields, so a replayed batch gives equal ids.  `keep` names columns that
    came with the payload and are no part of it; the whole `document` is kept too, if it came.
    """
    body = F.struct(*[c for c in payloads.columns if c not in keep and c != "document"])
    return platform_of(payloads).filter("reject_reason IS NULL").select(
        *keep, *[c for c in payloads.columns if c == "document"],
        F.sha2(F.to_json(body), 256).alias("failure_id"), "platform", "commit", "branch",
        F.lit("RECEIVED").alias("status"), body.alias("payload"),
        (F.current_timestamp() if now is None else now).cast("timestamp_ntz").alias("created_at"),
    )


def quarantine(payloads: DataFrame, now: Column | None = None) -> DataFrame:
    """(payload_id, reject_reason, payload, created_at) of payloads that no platform takes."""
    body = F.struct(*payloads.columns)
    return platform_of(payloads).filter("reject_reason IS NOT NULL").select(
        F.sha2(F.to_json(body), 256).alias("payload_id"), "reject_reason", body.alias("payload"),
        (F.current_timestamp() if now is None else now).cast("timestamp_ntz").alias("created_at"),
    )


def identified() -> Column:
    """Whether all keys that tell a run are there.  NULL equals nothing, so other records repeat none."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in INTAKE_KEYS])


def drop_duplicates(records: DataFrame, first_by: str) -> DataFrame:
    """First record of each (platform, commit, branch, job, build), and all records that lack one of these.

    min_by instead of a window: copies are combined before the shuffle.
    """
    rest = [c for c in records.columns if c not in INTAKE_KEYS]
    first = (
        records.filter(identified()).groupBy(*INTAKE_KEYS).agg(F.min_by(F.struct(*rest), first_by).alias("r"))
        .select(*INTAKE_KEYS, "r.*").select(*records.columns)
    )
    return first.unionByName(records.filter(~identified()))


def find_duplicate(records: DataFrame, platform, commit, branch, job_name, build_number) -> DataFrame:
    """The recorded failure of the same run, if there is one."""
    return records.filter(
        (F.col("platform") == platform) & (F.col("commit") == commit) & (F.col("branch") == branch)
        & (F.col("payload.job_name") == job_name) & (F.col("payload.build_number").cast("string") == str(build_number))
    ).orderBy("created_at", "failure_id").limit(1)


def at_path(document: Column, path: Column | str) -> Column:
    """Text of what a VARIANT holds at a JSON path, NULL if there is nothing."""
    return F.try_variant_get(document, path if isinstance(path, Column) else F.lit(path), "string")


def values_at(records: DataFrame, paths: dict[str, str], document: str = "document") -> DataFrame:
    """A row per record and path: the other columns, `name` and `value`.  paths: name -> JSON path, as data."""
    named = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("path")) for n, p in paths.items()])
    return records.withColumn("at", F.explode(named)).select(
        *[c for c in records.columns if c != document], "at.name",
        at_path(F.col(document), F.col("at.path")).alias("value"),
    )


def matching(records: DataFrame, wanted: dict[str, str], document: str = "document") -> DataFrame:
    """Records whose document has these texts at these JSON paths."""
    return records.filter(reduce(lambda a, b: a & b, [at_path(F.col(document), p) == v for p, v in wanted.items()]))


def by_id(records: DataFrame, failure_id: str) -> DataFrame:
    return records.filter(F.col("failure_id") == failure_id).orderBy("created_at").limit(1)


def state_rank(status: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STATES]), status)


def current_status(events: DataFrame) -> DataFrame:
    """status_events(failure_id, status, ts) -> latest status per failure."""
    return events.groupBy("failure_id").agg(
        F.max_by("status", F.struct("ts", state_rank(F.col("status")))).alias("status"),
        F.max("ts").alias("ts"),
        F.count("*").alias("events"),
    )


def step_for(status: Column) -> Column:
    """Pipeline step that may run on a failure in this state, NULL for none."""
    return reduce(lambda acc, kv: acc.when(status.isin(*kv[1]), kv[0]), GATES.items(), F)


def is_legal(before: Column, after: Column) -> Column:
    allowed = reduce(
        lambda acc, kv: acc.when(before == kv[0], after.isin(*kv[1])), MOVES.items(), F
    )
    return F.when(before.isNull(), after == "RECEIVED").otherwise(F.coalesce(allowed, F.lit(False)))


def display_names(payloads: DataFrame) -> DataFrame:
    """Adds job (job or repository name) and build (build number or run id)."""
    return payloads.withColumns({
        "job": F.coalesce(F.nullif(F.col("job_name"), F.lit("")), F.col("repo")),
        "build": F.coalesce(F.nullif(F.col("build_number"), F.lit(0)), F.col("run_id")),
    })
