"""Log lines derived from an `events` table: a test bed that grows with it.

Every event becomes four lines of one file; 400 events make one failure with
four stages.  Line numbers are arithmetic, so no sort is needed to build them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAGES = ["build", "unit_test", "deploy", "lint"]
EVENTS_PER_FAILURE = 400
EVENTS_PER_STAGE = 100
LINES_PER_EVENT = 4
SLOTS = 97

# {n}, {k} and {u} stand for numbers of the event.
SIGNAL_BLOCKS = [
    ["[2024-01-02T03:04:05.678Z] running suite {u}", "{n} tests failed", "junit: test execution failed", "see report {k}"],
    ["compiling module{u}", "12:00:01 Build FAILED in module{u}", "undefined reference to `f{k}'", "make: *** [Makefile:{k}] Error 1"],
    ["login to registry", "unauthorized: token {n}", "http 401 auth rejected", "retrying"],
    ["allocating {n} kB", "Out of memory: kill process {u}", "no space left on device", "cleanup"],
    ["connect 10.0.0.{u}:80{k}", "connection refused: 10.0.0.{u}:80{k}", "network error", "socket timeout"],
    ["script stage {k}", "script returned exit code {k}", "post actions", "done {n}"],
    ["npm install", "npm ERR! 404 module{u}", "package not found", "see log /tmp/npm-{n}.log"],
    ["docker pull", "failed to pull image app:{k}", "manifest unknown", "docker error"],
    ["auth step", "authentication failed for user{u}", "credentials not found", "abandon"],
    ["kubectl apply", "[critical] pod app-{u} is in CrashLoopBackOff", "back-off restarting failed container", "wait"],
    ["flaky check {k}", "deadline exceeded after {n} ms", "expected {k} actual {u}", "next"],
    ["copy files", "permission denied: /var/lib/ci/{u}/out.bin", "access rights missing", "skip"],
    ["assert phase", "Assertion failed: {k} != {u}", "pytest summary", "{k} failed"],
    ["{\"level\":\"info\",\"msg\":\"step {k}\"}", "{\"level\":\"error\",\"msg\":\"connection reset by peer {u}\"}", "{\"message\":\"ok {n}\",\"error\":\"\"}", "plain {k}"],
    ["{\"msg\":\"\",\"error\":\"disk full on node{u}\",\"n\":{n}}", "{\"n\":{n},\"log\":\"pull access denied\"}", "{\"msg\":{n}}", "{\"msg\":0,\"text\":\"idle {k}\"}"],
    ["Traceback (most recent call last):", "ValueError: bad value {n}", "rerun {k}", "café {u}"],
    ["Exception in thread \"main\" java.lang.Error{k}", "  at org.app.Main.run(Main.java:{k})", "Caused by: java.io.IOException", "shutdown {u}"],
    ["FAILURE: Build failed with an exception.", "* What went wrong:", "> Could not resolve dependency lib{u}:{k}", "* Try again"],
    ["panic: runtime index {k}", "goroutine {u} [running]:", "main.go:{k}", "exit"],
    ["thread 'w{u}' panicked at 'index {k} out of range', src/lib.rs", "note: run with backtrace", "halt", "end {n}"],
    ["Unhandled exception:", "#1 Loader.open (package:app/load.dart:{k})", "#2 main (package:app/main.dart:{u})", "quit"],
    ["Fatal error: Uncaught value {k}", "Stack trace:", "#0 /srv/app.php({u})", "rollback"],
    ["Error: Cannot find module 'm{u}'", "    at load (app.js:{k}:5)", "require stack", "stop"],
    ["Downloading from central: https://repo.example/{u}.jar", "Downloaded from central: https://repo.example/{u}.jar", "Progress ({k}/120)", "[Pipeline] }"],
    ["[Pipeline] {", "[InfluxDB Plugin] INFO: sent {n}", "[InfluxDB Plugin] Ignoring Exception {k}", "[Pipeline] // stage"],
]
PLAIN_BLOCKS = [
    ["[2024-03-04 05:06:07,123] fetch {n}", "ok {k}", "", "cached error.c for {u}"],
    ["step {k} done in {n} ms", "status 0", "exit code 0", "uploaded /srv/out/{u}/a.tar"],
    ["compiled src/m{u}.c", "  linked lib{k}.so  ", "2024-05-06T07:08:09Z tick", "naïve step"],
]


def templates() -> list[list[str]]:
    """Slot -> four lines; signal-bearing slots come first, the rest is plain."""
    plain = [PLAIN_BLOCKS[i % len(PLAIN_BLOCKS)] for i in range(SLOTS - len(SIGNAL_BLOCKS))]
    return SIGNAL_BLOCKS + plain


def spread(rows: DataFrame) -> DataFrame:
    """A file too small to be split is dealt out to all cores; others stay as read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def log_lines(events: DataFrame) -> DataFrame:
    """lines(failure_id, stage, line_no, raw) of an events table."""
    events = spread(events.select("event_id", "user_id", "value", "props"))
    event = F.col("event_id")
    slots = F.array(*[F.array(*[F.lit(x) for x in four]) for four in templates()])
    number = F.floor(F.col("value") * 100).cast("string")
    rows = events.select(
        F.concat(F.lit("run-"), F.floor(event / EVENTS_PER_FAILURE).cast("string")).alias("failure_id"),
        F.element_at(
            F.array(*[F.lit(s) for s in STAGES]),
            (F.floor(event / EVENTS_PER_STAGE) % len(STAGES) + 1).cast("int"),
        ).alias("stage"),
        ((event % EVENTS_PER_STAGE) * LINES_PER_EVENT).alias("base"),
        number.alias("n"),
        F.get_json_object("props", "$.k").alias("k"),
        F.col("user_id").cast("string").alias("u"),
        F.posexplode(
            F.element_at(slots, ((event * 7919 + F.col("user_id") * 31) % SLOTS + 1).cast("int"))
        ).alias("pos", "template"),
    )
    raw = F.col("template")
    for name in ("n", "k", "u"):
        raw = F.replace(raw, F.lit("{" + name + "}"), F.col(name))
    return rows.select(
        "failure_id", "stage", (F.col("base") + F.col("pos")).alias("line_no"), raw.alias("raw")
    )


def log_lines_sql() -> str:
    """The same lines as a SELECT for a plain SQL engine."""

    def text(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    slots = ", ".join("[" + ", ".join(text(x) for x in four) + "]" for four in templates())
    stages = ", ".join(text(s) for s in STAGES)
    return f"""
        SELECT failure_id, stage, base + pos AS line_no,
               replace(replace(replace(list_extract(four, pos + 1), '{{n}}', n), '{{k}}', k), '{{u}}', u) AS raw
        FROM (
            SELECT 'run-' || CAST(event_id // {EVENTS_PER_FAILURE} AS VARCHAR) AS failure_id,
                   list_extract([{stages}], CAST((event_id // {EVENTS_PER_STAGE}) % {len(STAGES)} + 1 AS INT)) AS stage,
                   (event_id % {EVENTS_PER_STAGE}) * {LINES_PER_EVENT} AS base,
                   CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR) AS n,
                   props::JSON->>'$.k' AS k,
                   CAST(user_id AS VARCHAR) AS u,
                   list_extract([{slots}], CAST((event_id * 7919 + user_id * 31) % {SLOTS} + 1 AS INT)) AS four,
                   unnest(range({LINES_PER_EVENT})) AS pos
            FROM events
        )"""
