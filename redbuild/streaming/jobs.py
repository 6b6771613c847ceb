"""Structured Streaming forms of the pipeline: intake, status, analysis, knowledge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import extract as E
from ..operators import failures, learn
from ..plans.analyze import analyze
from ..sources import buckets, tables
from ..sources import schemas as S
from .gate import RELEASED


def intake_stream(payloads: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Payload stream -> failure records, repeated runs dropped within the delay.

    The payloads carry received_at, when they landed, so a replay decides as the first run did.  Records that lack a key
    of their run repeat none.
    """
    landed = F.col("received_at")
    records = failures.intake(payloads, landed, keep=["received_at"]).withWatermark("received_at", delay)
    keyed = records.withColumns({"job_name": F.col("payload.job_name"), "build_number": F.col("payload.build_number")})
    first = keyed.filter(failures.identified()).dropDuplicatesWithinWatermark(failures.INTAKE_KEYS)
    return first.unionByName(keyed.filter(~failures.identified())).drop("received_at", "job_name", "build_number")


def intake_job(root: str) -> Callable[[DataFrame, int], None]:
    """Payloads -> stored failure records, their first status, and the payloads that no platform takes.

    A record of a run that was stored before is dropped, however long ago that was: the keys of all runs are kept in
    buckets, and a micro-batch looks into those of its own keys only.  A replay looks at what was stored before it.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        landed = F.col("received_at")
        keyed = failures.intake(batch, landed, keep=["received_at"]).withColumns(
            {"job_name": F.col("payload.job_name"), "build_number": F.col("payload.build_number")}
        )
        once = failures.drop_duplicates(keyed.withColumn("_first", F.struct("received_at", "failure_id")), "_first").drop("_first")
        index = f"{root}/intake_keys"
        new = buckets.unseen(once.filter(failures.identified()), index, batch_id, S.INTAKE_KEYS, failures.INTAKE_KEYS)
        records = new.unionByName(once.filter(~failures.identified()))
        tables.write_batch(records, f"{root}/failures", batch_id)
        stored = spark.read.parquet(f"{root}/failures/batch_id={batch_id}")
        events = stored.select("failure_id", "status", F.col("received_at").alias("ts"))
        tables.write_batch(events, f"{root}/status_events/step=intake", batch_id)
        tables.write_batch(failures.quarantine(batch, landed), f"{root}/quarantine", batch_id)
        keys = stored.filter(failures.identified()).select(*failures.INTAKE_KEYS, "failure_id")
        buckets.append(keys, index, batch_id, S.INTAKE_KEYS, failures.INTAKE_KEYS)

    return work


def status_stream(events: DataFrame) -> DataFrame:
    """status_events stream -> each event with the state before it and whether
    the move was legal.  An illegal move leaves the state as it is."""
    moves = failures.MOVES

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "rank"], kind="stable")
        before, accepted = [], []
        for status in rows["status"]:
            legal = status == "RECEIVED" if current is None else status in moves.get(current, [])
            before.append(current)
            accepted.append(legal)
            current = status if legal else current
        if current is not None:
            state.update((current,))
        yield pd.DataFrame({
            "failure_id": key[0], "status": rows["status"].to_numpy(), "ts": rows["ts"].to_numpy(),
            "before": pd.Series(before, dtype="object"), "accepted": accepted,
        })

    return (
        events.withColumn("rank", failures.state_rank(F.col("status")))
        .groupBy("failure_id")
        .applyInPandasWithState(
            step, "failure_id string, status string, ts timestamp, before string, accepted boolean",
            "current string", "append", GroupStateTimeout.NoTimeout,
        )
    )


def per_batch(work: Callable[[DataFrame, int], None], stream: DataFrame, checkpoint: str):
    """Runs `work(batch, batch_id)` on every micro-batch until the input is used up."""
    query = (
        stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def signals_job(out: str, **options) -> Callable[[DataFrame, int], None]:
    """Lines of complete failures in a micro-batch -> stored signals."""

    def work(batch: DataFrame, batch_id: int) -> None:
        tables.write_batch(E.extract_signals(batch, **options), out, batch_id)

    return work


def knowledge_job(path: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """Root causes with embeddings -> pattern table, safe against replays."""

    def work(batch: DataFrame, batch_id: int) -> None:
        tables.upsert_patterns(batch, path, batch_id, order)

    return work


def analysis_job(root: str, training: DataFrame | None = None, status: bool = False, **options) -> Callable[[DataFrame, int], None]:
    """Lines in, all result tables out (under `root`), and the pattern table kept up.

    With `status`, the failures' states are stored as they are reached: those that stored root causes answer in full are
    RESOLVED at once, the others pass CLASSIFIED and ANALYZING.
    """

    def work(batch: DataFrame, batch_id: int, ready: DataFrame | None = None) -> None:
        spark = batch.sparkSession
        known = tables.read_patterns(spark, f"{root}/patterns", before=batch_id)
        vectors = None
        if tables.exists(spark, f"{root}/embeddings"):
            before = tables.read_batches(spark, f"{root}/embeddings").filter(F.col("batch_id") < batch_id)
            vectors = before.groupBy("fingerprint").agg(F.max_by("embedding", F.struct("batch_id", "failure_id")).alias("embedding"))
        results = analyze(batch, training=training, known_patterns=known, stored_vectors=vectors, **options)

        def store(*names: str) -> None:
            for name in names:
                tables.write_batch(results[name], f"{root}/{name}", batch_id)

        store("signals", "classified")
        tables.write_embeddings(results["signals"], f"{root}/embeddings", batch_id)
        all_ = batch.select("failure_id").distinct() if ready is None else ready
        if status:
            unknown = results["classified"].select("failure_id").distinct()
            mark(root, "classified", unknown, ["CLASSIFIED"], batch_id)
            mark(root, "analyzing", unknown, ["ANALYZING"], batch_id)
        store("root_causes", "rejected", "summary", "rows", "counters")
        fresh = results["root_causes"].join(results["classified"].select("failure_id", "fingerprint"), ["failure_id", "fingerprint"])
        own = results["signals"].select("failure_id", "fingerprint", "embedding")
        tables.upsert_patterns(
            tables.attach_embeddings(fresh, own).drop("similarity_score"),
            f"{root}/patterns", batch_id, ["failure_id"],
        )
        if status:
            mark(root, "resolved", all_, ["RESOLVED"], batch_id)

    return work


def mark(root: str, step: str, failures_: DataFrame, states: list[str], batch_id: int) -> None:
    """Stores that failures have reached the given states, as events of a step."""
    each = failures_.select("failure_id", F.explode(F.array(*[F.lit(s) for s in states])).alias("status"))
    tables.write_batch(each.withColumn("ts", F.current_timestamp()), f"{root}/status_events/step={step}", batch_id)


#: Steps whose events are stored by the job that also asks for the state.
OWN_STEPS = ["collect", "expired", "classified", "analyzing", "resolved"]


def at_step(root: str, failures_: DataFrame, step: str, batch_id: int) -> DataFrame:
    """Those of (failure_id) whose current state lets the step run.  What the
    job itself said in this batch or later doesn't count, so a replay decides
    as the first run did."""
    spark = failures_.sparkSession
    if not tables.exists(spark, f"{root}/status_events"):
        return failures_.limit(0)
    events = spark.read.parquet(f"{root}/status_events").filter(~F.col("step").isin(OWN_STEPS) | (F.col("batch_id") < batch_id))
    now = failures.current_status(events).filter(failures.step_for(F.col("status")) == step)
    return failures_.join(now.select("failure_id"), "failure_id", "left_semi")


def release_job(root: str, **options) -> Callable[[DataFrame, int], None]:
    """What gated_lines() lets go -> all result tables and states.

    The collect event of a failure that was received makes it LOGS_COLLECTED and has its lines analysed in this very
    micro-batch; one whose event did not come in time is FAILED.  Lines that come behind the event are kept apart.
    """
    analyse = analysis_job(root, status=True, **options)

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Written once: the stateful plan must not run again for each use.
        tables.write_batch(batch, f"{root}/released", batch_id)
        rows = spark.read.schema(RELEASED).parquet(f"{root}/released/batch_id={batch_id}")
        of = lambda kind: rows.filter(F.col("kind") == kind).select("failure_id").distinct()
        mark(root, "expired", of("expired"), ["FAILED"], batch_id)
        tables.write_batch(rows.filter("kind = 'late'").drop("kind"), f"{root}/late_lines", batch_id)
        ready = at_step(root, of("collected"), "collect", batch_id).checkpoint()
        mark(root, "collect", ready, ["LOGS_COLLECTED"], batch_id)
        if ready.isEmpty():
            return
        lines = rows.filter("kind = 'line'").drop("kind").join(ready, "failure_id", "left_semi")
        # The micro-batch itself ran without adaptive plans, as stateful plans must; what follows is batch work.
        spark.conf.set("spark.sql.adaptive.enabled", True)
        try:
            analyse(lines, batch_id, ready)
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", False)

    return work


def feedback_job(path: str, training: DataFrame) -> Callable[[DataFrame, int], None]:
    """Classified signals -> training feedback in full batches.  What does not
    fill one stays pending and is looked at again with the next micro-batch."""

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = tables.read_batches(spark, path).filter(F.col("batch_id") < batch_id) if tables.exists(spark, path) else None
        fresh = learn.learnable(batch, training)
        if stored is not None:
            learned = stored.filter("learned")
            last = stored.agg(F.max("batch_id").alias("m")).head()["m"]
            pending = stored.filter(~F.col("learned") & (F.col("batch_id") == last))
            fresh = fresh.select(*[c for c in pending.columns if c not in ("learned", "batch_id")])
            fresh = pending.drop("learned", "batch_id").unionByName(
                fresh.join(pending.select("fingerprint"), "fingerprint", "left_anti")
            ).join(learned.select("fingerprint"), "fingerprint", "left_anti")
        fresh = fresh.checkpoint()
        now, later = learn.feedback_batch(fresh, ["fingerprint"])
        tables.write_batch(
            now.withColumn("learned", F.lit(True)).unionByName(later.withColumn("learned", F.lit(False))),
            path, batch_id,
        )

    return work
