"""Views that give the shared test tables the shape of this package's inputs.

Each view reads its whole table.  The SQL twins are in plans/duck_sql.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COPIES = 3


def vectors(embeddings: DataFrame) -> DataFrame:
    """(g, id, vec, k, vec_id): each vector and two copies, moved a little or a lot."""
    moved = embeddings.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    # The last copy of every other vector is moved far enough to leave its cluster.
    size = F.col("k") * F.when((F.col("k") == 2) & (F.col("vec_id") % 2 == 0), 0.1).otherwise(0.01)
    vec = F.transform(
        "embedding",
        lambda x, j: x.cast("double") + size * (((F.col("vec_id") * 7 + j * 13 + F.col("k") * 5) % 11 - 5) / 5.0),
    )
    return moved.select(
        F.col("label").alias("g"), (F.col("vec_id") * COPIES + F.col("k")).alias("id"), vec.alias("vec"),
        "k", "vec_id",
    )


def steps(lineitem: DataFrame) -> DataFrame:
    """CI steps: (run, stage, pos, log)."""
    log = F.concat(
        F.lit("step "), F.col("l_partkey").cast("string"), F.lit("\n"), F.lit("supplier "),
        F.col("l_suppkey").cast("string"), F.lit("\n"),
    )
    pos = F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")
    return lineitem.select(
        F.col("l_orderkey").alias("run"), F.col("l_returnflag").alias("stage"), pos.alias("pos"), log.alias("log")
    )


def jobs(orders: DataFrame) -> DataFrame:
    """CI jobs with a conclusion as the hosted service words it."""
    conclusion = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "failure")
        .when(F.col("o_orderpriority") == "2-HIGH", "success")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "Timed_Out")
        .when(F.col("o_orderpriority") == "5-LOW", F.when(F.col("o_orderstatus") == "P", "neutral").otherwise("cancelled"))
    )
    return orders.select(F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("stage"), conclusion.alias("conclusion"))


def payloads(orders: DataFrame) -> DataFrame:
    """Failure payloads of both services, some of them incomplete."""
    key = F.col("o_orderkey")
    hub = key % 2 == 0
    return orders.select(
        key.alias("intake_no"),
        F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string")).alias("commit"),
        F.col("o_orderstatus").alias("branch"),
        F.when(~hub & (key % 7 != 0), F.concat(F.lit("job-"), F.col("o_orderpriority"))).alias("job_name"),
        F.when(key % 5 != 0, F.col("o_custkey") % 4).alias("build_number"),
        F.when(hub, F.lit("team")).alias("owner"),
        F.when(hub, F.concat(F.lit("repo-"), F.substring("o_orderpriority", 1, 1))).alias("repo"),
        F.when(hub & (key % 3 == 0), key).alias("run_id"),
    )


def payload_texts(events: DataFrame) -> DataFrame:
    """Payloads as landed, with fields that no schema knows; some of them broken off."""
    whole = F.concat(
        F.lit('{"job_name":"job-'), F.col("event_type"), F.lit('","build_number":'), F.col("user_id").cast("string"),
        F.lit(',"branch":null,"extra":'), F.col("props"), F.lit(',"tags":["a","'), F.col("event_type"), F.lit('"]}'),
    )
    return events.select("event_id", F.when(F.col("event_id") % 13 == 5, F.left(whole, F.lit(20))).otherwise(whole).alias("value"))


def status_events(orders: DataFrame) -> DataFrame:
    states = F.array(*[F.lit(s) for s in ("RECEIVED", "LOGS_COLLECTED", "CLASSIFIED", "ANALYZING", "RESOLVED", "FAILED")])
    return orders.select(
        F.concat(F.lit("run-"), F.col("o_custkey").cast("string")).alias("failure_id"),
        F.element_at(states, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("status"),
        F.col("o_orderdate").alias("ts"),
    )


def pattern_arrivals(events: DataFrame) -> DataFrame:
    """Root causes as they arrive: one per event, recurring by user."""
    return events.select(
        F.concat(F.lit("fp"), F.col("user_id").cast("string")).alias("fingerprint"),
        F.col("event_type").alias("root_cause"),
        F.when(F.col("value") > 20, "HIGH").otherwise("LOW").alias("severity"),
        F.lit(0).alias("recurrence_count"),
        F.array(F.col("value"), (F.col("event_id") % 7).cast("double")).alias("embedding"),
        F.col("value").alias("rca_confidence"), F.col("props").alias("remediation"),
        F.lit(None).cast("string").alias("secondary_remediations"),
        "event_id",
    )


def stored_patterns(customer: DataFrame) -> DataFrame:
    return customer.select(
        F.concat(F.lit("fp"), F.col("c_custkey").cast("string")).alias("fingerprint"),
        F.col("c_mktsegment").alias("root_cause"), F.lit("MEDIUM").alias("severity"),
        F.lit(4).alias("recurrence_count"), F.array(F.col("c_acctbal"), (F.col("c_custkey") % 7).cast("double")).alias("embedding"),
        F.col("c_acctbal").alias("rca_confidence"), F.col("c_name").alias("remediation"),
        F.lit(None).cast("string").alias("secondary_remediations"),
    )


def remediation_json(lineitem: DataFrame) -> DataFrame:
    """Remediations as stored text: all actions, some of them broken."""
    kind = (F.col("l_orderkey") * 3 + F.col("l_linenumber")) % 12
    n = F.col("l_linenumber").cast("string")
    text = (
        F.when(kind == 0, F.concat(F.lit('{"action":"FIX_DEV","strategy":"CLEAN_REBUILD","target":"pom.xml","suggested_patch":"p","patch_confidence":0.5,"retry_count":'), n, F.lit("}")))
        .when(kind == 1, F.lit('{"action":"FIX_DEV","strategy":"FIX_CODE_QUALITY","target":"x"}'))
        .when(kind == 2, F.lit('{"action":"FIX_DEV","strategy":"GENERATE_CODE_PATCH","target":"a.c","suggested_patch":"p","patch_confidence":1.5}'))
        .when(kind == 3, F.lit('{"action":"FIX_TEST","strategy":"SKIP_TEST_TEMPORARILY","target":"t"}'))
        .when(kind == 4, F.concat(F.lit('{"action":"FIX_TEST","strategy":"MARK_FLAKY_RETRY","target":"t","retry_count":'), n, F.lit("}")))
        .when(kind == 5, F.lit('{"action":"FIX_TEST","strategy":"FIX_ASSERTION","target":"t","retry_count":3}'))
        .when(kind == 6, F.lit('{"action":"FIX_CI_INFRA","strategy":"RESTART_RESOURCE","target":"pod","estimated_recovery_time_seconds":-1}'))
        .when(kind == 7, F.lit('{"action":"FIX_CI_INFRA","strategy":"UPDATE_SECRET","target":"key","requires_human_approval":true}'))
        .when(kind == 8, F.lit('{"reason":"needs a look"}'))
        .when(kind == 9, F.lit('{"action":"MANUAL_INVESTIGATION","priority":"URGENT"}'))
        .when(kind == 10, F.lit('{"action":"REBOOT","reason":"x"}'))
        .otherwise(F.lit('{"action":"FIX_CI_INFRA","strategy":"RESTART_RESOURCE"}'))
    )
    return lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("stored"),
        F.when(F.col("l_suppkey") % 17 != 0, F.col("l_discount") * 5).alias("rca_confidence"),
        F.when(F.col("l_partkey") % 19 != 0, F.concat(F.lit("part "), F.col("l_partkey").cast("string"))).alias("root_cause"),
        F.when(F.col("l_orderkey") % 23 != 0, F.lit("error")).alias("error_line"),
        (F.col("l_partkey") % 9 - 1).cast("int").alias("recurrence_count"),
        F.when(F.col("l_partkey") % 3 == 0, F.col("l_quantity") / 40.0).alias("similarity_score"),
        F.when(F.col("l_orderkey") % 4 == 0, F.lit('[{"action":"FIX_TEST","strategy":"FIX_ASSERTION"}]'))
        .when(F.col("l_orderkey") % 4 == 1, F.lit('[{"reason":"look again"}]')).alias("secondary"),
        F.when(F.col("l_returnflag") == "A", "HIGH").when(F.col("l_returnflag") == "N", "WORST").alias("severity"),
    )


def root_causes(orders: DataFrame) -> DataFrame:
    owner = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "DEVOPS_ENGINEERS")
        .when(F.col("o_orderpriority") == "2-HIGH", "DEVELOPERS")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "TEST_ENGINEERS")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "DEVELOPERS").otherwise("UNOWNED")
    )
    key = F.col("o_orderkey")
    return orders.select(
        F.col("o_custkey").alias("failure_id"), owner.alias("owner"),
        F.col("o_orderstatus").alias("validated_category"),
        F.concat(F.lit("cause "), key.cast("string")).alias("root_cause"),
        F.concat(F.lit("error "), key.cast("string")).alias("error_line"),
        F.when(F.col("o_orderstatus") == "F", "CRITICAL").otherwise("LOW").alias("severity"),
        ((key % 21) / 20.0).alias("rca_confidence"), (key % 7).cast("int").alias("recurrence_count"),
        F.when(key % 3 == 0, (key % 9) / 8.0).alias("similarity_score"),
        F.sha2(key.cast("string"), 256).alias("fingerprint"), key.alias("sequence"),
        F.lit("2024-01-01T00:00:00Z").alias("analyzed_at"), F.lit(None).cast("string").alias("evidence_url"),
    )


def mail_of(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    at = lambda who, every: F.when(key % every == 0, F.concat(F.lit(f"{who}-"), key.cast("string"), F.lit("@x")))
    return customer.select(
        key.alias("failure_id"), at("ci", 2).alias("ci_email"), at("dev", 3).alias("dev_email"),
        at("test", 5).alias("test_email"),
    )
