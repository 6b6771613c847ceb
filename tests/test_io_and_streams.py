import json
import tempfile

import pytest
from pyspark.sql import functions as F

from redbuild.operators import dedup, extract, failures
from redbuild.sources import buckets, documents, log_files, logs, tables
from redbuild.sources import schemas as S
from redbuild.streaming import jobs
from redbuild.streaming.gate import gated_lines


def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def test_log_files_become_numbered_lines(spark):
    root = folder()
    import os

    wanted = {}
    for failure in ("f1", "f 2"):
        os.makedirs(f"{root}/{failure}")
        for stage in ("build", "unit.test"):
            rows = [f"{failure} {stage} line {i}" for i in range(500)]
            open(f"{root}/{failure}/{stage}.log", "w").write("\n".join(rows) + "\n")
            wanted[failure, stage] = rows
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = {}
        for r in logs.read_stage_logs(spark, root).collect():
            got.setdefault((r["failure_id"], r["stage"]), {})[r["line_no"]] = r["raw"]
        one = logs.read_log_folder(spark, f"{root}/f1", "x").filter("stage = 'build'").orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == wanted
    assert [r["raw"] for r in one] == wanted["f1", "build"] and one[0]["failure_id"] == "x"


def test_stage_logs_become_files_and_lines_again(spark):
    import os
    from pathlib import Path

    root = folder()
    long = spark.range(200_000).select(
        F.lit("f1").alias("failure_id"), F.lit("Build all").alias("stage"), F.col("id").alias("line_no"),
        F.concat(F.lit("é line "), F.col("id").cast("string")).alias("raw"),
    )
    short = spark.createDataFrame(
        [("f 2", f"s{i}", n, None if n == 1 else f"{i} {n}") for i in range(30) for n in range(3)] + [("f 2", "s0", 2, "0 1b")], S.LINES
    )
    lines = long.unionByName(short).orderBy(F.rand(3))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        written = log_files.write_log_files(lines, root, 4)
        assert written.count() == 31 and written.agg(F.sum("lines")).head()[0] == 200_091
        def content():
            return {str(p): p.read_bytes() for p in Path(root).glob("*/*.log")}

        before = content()
        assert before[f"{root}/f 2/s0.log"] == b"0 0\n\n0 1b\n0 2\n" and len(before) == 31
        (stage,) = os.listdir(f"{root}/f1")
        assert before[f"{root}/f1/{stage}"].decode().splitlines() == [f"é line {i}" for i in range(200_000)]
        back = logs.read_stage_logs(spark, root).filter("failure_id = 'f1'")
        assert back.join(long, ["failure_id", "line_no", "raw"], "left_semi").count() == back.count() == 200_000
        # A replay puts the same bytes, also one that was cut off between or within the phases.
        log_files.write_log_files(lines, root, 4)
        log_files.stage_files(lines, root, 4)
        os.makedirs(f"{root}/_staged/4/files", exist_ok=True)
        Path(f"{root}/_staged/4/files/lost.part").write_text("of an attempt that was lost")
        log_files.commit_files(spark, root, 4)
        log_files.commit_files(spark, root, 4)
        assert content() == before and not os.path.exists(f"{root}/_staged/4/files")
        os.remove(f"{root}/f 2/s0.log")
        with pytest.raises(Exception, match="neither"):
            log_files.commit_files(spark, root, 4)
        with pytest.raises(Exception, match="no file for failure"):
            log_files.write_log_files(spark.createDataFrame([("../x", "s", 0, "a")], S.LINES), root, 5)
        assert log_files.write_log_files(short.limit(0), root, 6).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_payload_documents_keep_unknown_fields(spark):
    root = folder()
    import os

    os.makedirs(f"{root}/in")
    whole = {"commit": "c", "job_name": "j", "build_number": 7, "extra": {"who": "x", "n": [1, 2]}}
    open(f"{root}/in/a.json", "w").write(json.dumps(whole) + "\n\n{broken\n")
    jobs.per_batch(jobs.intake_job(f"{root}/out"), documents.stream_payloads(spark, f"{root}/in"), f"{root}/c")
    stored = tables.read_batches(spark, f"{root}/out/failures")
    assert failures.matching(stored, {"$.extra.who": "x", "$.build_number": "7"}).count() == 1
    assert failures.matching(stored, {"$.extra.who": "y"}).count() == 0
    got = failures.values_at(stored.select("failure_id", "document"), {"a": "$.extra.n[1]", "b": "$.no"}).collect()
    assert {r["name"]: r["value"] for r in got} == {"a": "2", "b": None}
    (held,) = tables.read_batches(spark, f"{root}/out/quarantine").select(F.expr("payload.document::string")).collect()
    assert held[0] == "{broken"


def test_byte_ranges_give_every_line_once():
    import io
    import random

    from redbuild.sources import log_ranges

    draw = random.Random(5)
    for _ in range(300):
        data = b"".join(draw.choice([b"\n", b"\r", b"\r\n", b"a", b"bc", "é".encode()]) for _ in range(draw.randrange(60)))
        size, log_ranges.CHUNK = draw.randrange(1, 9), draw.randrange(1, 7)
        want = data.splitlines()
        starts = range(0, len(data), size)
        got = [list(log_ranges.lines_in(io.BytesIO(data), s, min(len(data), s + size))) for s in starts]
        assert [line for part in got for line in part] == want
        assert [log_ranges.count_starts(io.BytesIO(data), s, min(len(data), s + size)) for s in starts] == [len(p) for p in got]
    log_ranges.CHUNK = 4 << 20


def test_many_small_files_and_a_large_one(spark):
    import os

    root = folder()
    for i in range(60):
        os.makedirs(f"{root}/f{i % 3}", exist_ok=True)
        open(f"{root}/f{i % 3}/s{i}.log", "w").write("".join(f"{i} {n}\n" for n in range(i % 5)))
    open(f"{root}/f0/a+b c.log", "wb").write(b"\xef\xbb\xbf" + b"".join(b"line %d\r\n" % n for n in range(300_000)) + b"\xff end")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100kb")
    try:
        lines = logs.read_stage_logs(spark, root)
        assert "Broadcast" not in lines._jdf.queryExecution().executedPlan().toString()
        large = lines.filter("stage = 'a+b c'").checkpoint()
        assert large.count() == 300_001 and large.filter("raw <> 'line ' || line_no").collect() == [("f0", "a+b c", 300_000, "\ufffd end")]
        small = sorted((r["stage"], r["line_no"], r["raw"]) for r in lines.filter("stage like 's%'").collect())
        assert small == sorted((f"s{i}", n, f"{i} {n}") for i in range(60) for n in range(i % 5))
        text = spark.read.text(f"{root}/f0/*.log").filter("value like 'line%'")
        assert text.join(large, text["value"] == large["raw"], "left_semi").count() == 300_000

        def work(files, batch_id):
            tables.write_batch(logs.stage_lines(files), f"{root}/_out", batch_id)

        for _ in range(2):  # what was read isn't read again
            logs.stream_stage_logs(spark, root).writeStream.foreachBatch(work).option(
                "checkpointLocation", f"{root}/_c"
            ).trigger(availableNow=True).start().awaitTermination()
        streamed = tables.read_batches(spark, f"{root}/_out").drop("batch_id")
        assert streamed.count() == lines.count() and streamed.exceptAll(lines).isEmpty()
        none = spark.createDataFrame([], "path string, length long")
        assert logs.stage_lines(none).collect() == []
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ci_documents(spark):
    root = folder()
    run = {"run_id": 9, "jobs": [{"id": 1, "name": "Build", "conclusion": "failure", "status": "completed",
                                 "steps": [{"number": 1, "name": "a", "conclusion": "success", "status": "completed", "log": "x\n"}]},
                                {"id": 2, "name": "Lint", "conclusion": None, "status": "completed", "steps": []}]}
    open(f"{root}/a.json", "w").write(json.dumps(run) + "\n")
    found = documents.hub_jobs(documents.read_hub_runs(spark, root))
    assert [(r["id"], r["result"]) for r in found.orderBy("id").collect()] == [("1", "FAILURE"), ("2", "NOT_BUILT")]
    (step,) = documents.hub_steps(found).collect()
    assert (step["stage"], step["pos"], step["log"]) == ("Build", 0, "x\n")


def test_writing_a_batch_twice_adds_nothing(spark):
    path = folder() + "/t"
    rows = spark.createDataFrame([("f", "p")], "failure_id string, fingerprint string")
    for batch in (0, 1, 1):
        tables.write_batch(rows, path, batch)
    assert tables.read_batches(spark, path).count() == 2


def pattern(spark, rows):
    return spark.createDataFrame(
        [{"fingerprint": p, "rca_confidence": c, "severity": s, "recurrence_count": 0, "embedding": [1.0], "failure_id": f} for f, p, c, s in rows],
        S.PATTERNS + ", failure_id string",
    )


def test_pattern_upsert_is_safe_against_replays(spark):
    path = folder() + "/patterns"
    for batch in (0, 1, 1, 1):
        tables.upsert_patterns(pattern(spark, [("f", "p", 0.5 + batch / 10, "HIGH" if batch == 0 else "LOW")]), path, batch, ["failure_id"])
    (r,) = tables.read_patterns(spark, path).collect()
    assert (r["recurrence_count"], r["rca_confidence"], r["severity"]) == (1, 0.6, "HIGH")


def test_streamed_signals_equal_the_batch(spark):
    root = folder()
    raws = ["ok", "unauthorized", "Traceback (most recent call last):", "ValueError: x", "done"] * 30
    frame = spark.createDataFrame(
        [(f"f{i}", "s", n, raw) for i in range(3) for n, raw in enumerate(raws)], S.LINES
    )
    for i in range(3):
        frame.filter(f"failure_id = 'f{i}'").coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(S.LINES).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    jobs.per_batch(jobs.signals_job(f"{root}/out"), stream, f"{root}/checkpoint")
    got = tables.read_batches(spark, f"{root}/out")
    assert got.select("batch_id").distinct().count() >= 2
    want = extract.extract_signals(frame)
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect())


def test_status_stream_rejects_illegal_moves(spark):
    root = folder()
    events = [("f", "RECEIVED", 1), ("f", "CLASSIFIED", 2), ("f", "LOGS_COLLECTED", 3), ("f", "RESOLVED", 4), ("g", "RESOLVED", 1)]
    frame = spark.createDataFrame(events, "failure_id string, status string, t int").select(
        "failure_id", "status", F.timestamp_seconds("t").alias("ts")
    )
    frame.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(S.STATUS_EVENTS).parquet(f"{root}/in")
    query = (
        jobs.status_stream(stream).writeStream.format("memory").queryName("moves").outputMode("append")
        .option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {(r["failure_id"], r["status"]): (r["before"], r["accepted"]) for r in spark.table("moves").collect()}
    assert got == {
        ("f", "RECEIVED"): (None, True), ("f", "CLASSIFIED"): ("RECEIVED", False), ("f", "LOGS_COLLECTED"): ("RECEIVED", True),
        ("f", "RESOLVED"): ("LOGS_COLLECTED", True), ("g", "RESOLVED"): (None, False),
    }


def test_intake_stream_drops_repeated_payloads(spark):
    root = folder()
    body = {"commit": "c", "branch": "b", "job_name": "j", "build_number": 1}
    hosted = {"commit": "c", "branch": "b", "owner": "o", "repo": "r", "run_id": 5}
    import os

    os.makedirs(f"{root}/in")
    open(f"{root}/in/a.json", "w").write("\n".join(json.dumps(x) for x in (body, body, {**body, "build_number": 2}, hosted, {**hosted, "run_id": 6})) + "\n")
    stream = jobs.intake_stream(documents.stream_payloads(spark, f"{root}/in"))
    query = (
        stream.writeStream.format("memory").queryName("intake").outputMode("append")
        .option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.table("intake").collect()
    assert sorted(r["payload"]["build_number"] for r in rows if r["platform"] == "jenkins") == [1, 2]
    assert sorted(r["payload"]["run_id"] for r in rows if r["platform"] == "github") == [5, 6]


def test_intake_job_keeps_what_no_platform_takes(spark):
    root = folder()
    import os

    os.makedirs(f"{root}/in")
    open(f"{root}/in/a.json", "w").write("\n".join(json.dumps(x) for x in ({"commit": "c"}, {"commit": "c", "job_name": "j", "build_number": 1})) + "\n")
    for _ in range(2):  # a second run finds nothing new
        jobs.per_batch(jobs.intake_job(f"{root}/out"), documents.stream_payloads(spark, f"{root}/in"), f"{root}/c")
    (held,) = tables.read_batches(spark, f"{root}/out/quarantine").collect()
    assert held["reject_reason"] == "platform unknown" and held["payload"]["commit"] == "c"
    assert tables.read_batches(spark, f"{root}/out/failures").count() == tables.read_batches(spark, f"{root}/out/status_events").count() == 1


def log_frame(spark):
    raws = ["ok", "connection refused: 10.0.0.1:80", "retry", "done"] * 3 + ["fatal: undefined reference to `f'", "x"]
    return spark.createDataFrame([(f"f{i}", "s", n, raw) for i in range(2) for n, raw in enumerate(raws)], S.LINES)


def test_known_patterns_answer_and_unusable_ones_do_not(spark):
    from redbuild.plans.analyze import analyze

    first = analyze(log_frame(spark))
    causes, vectors = first["root_causes"], first["representatives"].select("failure_id", "fingerprint", "embedding")
    known = tables.attach_embeddings(causes, vectors).groupBy("fingerprint").agg(F.first(F.struct(*[c for c in causes.columns if c != "fingerprint"], "embedding")).alias("s")).select("fingerprint", "s.*")
    second = analyze(log_frame(spark), known_patterns=known.drop("failure_id", "stage", "line_no", "similarity_score"))
    assert second["classified"].count() == 0
    cached = second["root_causes"]
    assert cached.count() == causes.count() and cached.filter("similarity_score > 0.99").count() == cached.count()
    broken = known.withColumn("rca_confidence", F.lit(None).cast("double"))
    third = analyze(log_frame(spark), known_patterns=broken.drop("failure_id", "stage", "line_no", "similarity_score"))
    assert third["classified"].count() == first["classified"].count()
    assert third["root_causes"].filter("similarity_score IS NOT NULL").count() == 0


def test_analysis_job_stores_everything_and_survives_a_replay(spark):
    root = folder()
    work = jobs.analysis_job(root)
    for batch in (0, 1, 1):
        work(log_frame(spark), batch)
    for name in ("signals", "classified", "root_causes", "rejected", "summary", "rows", "counters"):
        assert tables.exists(spark, f"{root}/{name}"), name
    patterns = tables.read_patterns(spark, f"{root}/patterns").collect()
    causes = tables.read_batches(spark, f"{root}/root_causes")
    seen = {r["fingerprint"]: r["n"] for r in causes.groupBy("fingerprint").agg(F.count("*").alias("n")).collect()}
    assert {p["fingerprint"] for p in patterns} == set(seen)
    counters = tables.read_batches(spark, f"{root}/counters")
    assert counters.filter("batch_id = 1").agg(F.sum("cache_hits")).head()[0] > 0


def test_feedback_stays_pending_until_a_batch_is_full(spark):
    path = folder() + "/feedback"
    rows = lambda ids: spark.createDataFrame(
        [("f", "s", i, f"fp{i:03}", "DEV_FAILURE", 0.95, "e", "", "") for i in ids],
        "failure_id string, stage string, line_no long, fingerprint string, category string, confidence double, error_line string, pre_content string, post_content string",
    )
    work = jobs.feedback_job(path, spark.createDataFrame([], "fingerprint string"))
    work(rows(range(15)), 0)
    work(rows(range(10, 30)), 1)
    work(rows(range(10, 30)), 1)
    stored = tables.read_batches(spark, path)
    assert stored.filter("batch_id = 0 AND learned").count() == 0
    now = stored.filter("batch_id = 1")
    assert now.filter("learned").count() == 20 and now.filter("NOT learned").count() == 10
    assert now.select("fingerprint").distinct().count() == 30


def landed(frame, seconds):
    return frame.withColumn("received_at", F.timestamp_seconds(F.lit(seconds))).coalesce(1).write.mode("append")


def gate_run(spark, root, work, delay="1 hour"):
    lines = spark.readStream.schema(S.LINES + ", received_at timestamp").parquet(f"{root}/in")
    collected = spark.readStream.schema("failure_id string, received_at timestamp").parquet(f"{root}/collected")
    jobs.per_batch(work, gated_lines(lines, collected, 10_000, parts=3, delay=delay), f"{root}/c")


def test_the_collect_event_starts_the_analysis(spark):
    root = folder()
    whole = log_frame(spark)
    again = whole.filter("failure_id = 'f0'").withColumn("failure_id", F.lit("f2"))
    one = lambda f: spark.createDataFrame([(f,)], "failure_id string")
    jobs.mark(root, "intake", spark.createDataFrame([("f0",), ("f1",), ("f2",)], "failure_id string"), ["RECEIVED"], 0)
    work = jobs.release_job(root)
    batches = []

    def twice(batch, batch_id):  # every micro-batch is replayed
        batches.append(batch_id)
        work(batch, batch_id)
        work(batch, batch_id)

    landed(whole, 1).parquet(f"{root}/in")
    landed(one("nobody").filter("false"), 1).parquet(f"{root}/collected")
    gate_run(spark, root, twice)
    assert not tables.exists(spark, f"{root}/signals")
    # Long after the last line.
    landed(one("f0"), 2).parquet(f"{root}/collected")
    gate_run(spark, root, twice)
    found = tables.read_batches(spark, f"{root}/signals")
    want = extract.distinct_signals(extract.extract_signals(whole.filter("failure_id = 'f0'")))
    columns = ["failure_id", "stage", "line_no", "fingerprint", "pre_content", "post_content"]
    assert sorted(found.select(columns).collect()) == sorted(want.select(columns).collect()) and want.count() >= 1
    # The same errors again: stored root causes answer in full.  A line behind its failure's event is late.
    late = spark.createDataFrame([("f0", "s", 99, "unauthorized")], S.LINES)
    landed(again.unionByName(late), 3).parquet(f"{root}/in")
    landed(one("f2"), 3).parquet(f"{root}/collected")
    gate_run(spark, root, twice)
    events = {}
    for r in spark.read.parquet(f"{root}/status_events").collect():
        events.setdefault(r["failure_id"], []).append(r["status"])
    assert {f: sorted(s) for f, s in events.items()} == {
        "f0": sorted(["RECEIVED", "LOGS_COLLECTED", "CLASSIFIED", "ANALYZING", "RESOLVED"]), "f1": ["RECEIVED"],
        "f2": sorted(["RECEIVED", "LOGS_COLLECTED", "RESOLVED"]),
    }
    now = {r["failure_id"]: r["status"] for r in failures.current_status(spark.read.parquet(f"{root}/status_events")).collect()}
    assert now == {"f0": "RESOLVED", "f1": "RECEIVED", "f2": "RESOLVED"}
    assert [r["line_no"] for r in tables.read_batches(spark, f"{root}/late_lines").collect()] == [99]
    assert tables.read_batches(spark, f"{root}/root_causes").filter("failure_id = 'f2' AND similarity_score > 0.99").count() == want.count()
    assert len(set(batches)) == len(batches) >= 3


def test_a_failure_whose_logs_never_come_has_failed(spark):
    root = folder()
    jobs.mark(root, "intake", spark.createDataFrame([("f1",), ("f9",)], "failure_id string"), ["RECEIVED"], 0)
    line = lambda f: spark.createDataFrame([(f, "s", 0, "unauthorized")], S.LINES)
    landed(line("f1"), 1).parquet(f"{root}/in")
    landed(spark.createDataFrame([], "failure_id string"), 1).parquet(f"{root}/collected")
    gate_run(spark, root, jobs.release_job(root), "0 seconds")
    landed(line("f9"), 100_000).parquet(f"{root}/in")
    gate_run(spark, root, jobs.release_job(root), "0 seconds")
    now = {r["failure_id"]: r["status"] for r in failures.current_status(spark.read.parquet(f"{root}/status_events")).collect()}
    assert now["f1"] == "FAILED" and now["f9"] == "RECEIVED"


def test_a_run_that_comes_again_days_later_is_dropped(spark):
    root = folder()
    work = jobs.intake_job(root)

    def payloads(days, builds):
        rows = [("c", "b", "j", n) for n in builds]
        frame = spark.createDataFrame(rows, "commit string, branch string, job_name string, build_number long")
        empty = {c: F.lit(None).cast("string") for c in ("owner", "repo")} | {"run_id": F.lit(None).cast("long")}
        return frame.withColumns(empty).withColumn("received_at", F.timestamp_seconds(F.lit(86_400 * days)))

    work(payloads(0, [1, 1, 2, None]), 0)
    for _ in range(2):  # replayed
        work(payloads(2, [2, 3, 3, None]), 1)
    work(payloads(9, [1, 3, 4]), 2)
    kept = tables.read_batches(spark, f"{root}/failures")
    got = sorted((r["batch_id"], r["payload"]["build_number"] or 0) for r in kept.collect())
    assert got == [(0, 1), (0, 2), (1, 3), (2, 4)]
    assert spark.read.parquet(f"{root}/status_events").count() == 4
    work(payloads(9, [1]), 2)  # a replay with fewer rows leaves none behind
    assert tables.read_batches(spark, f"{root}/failures").filter("batch_id = 2").count() == 0


def test_only_touched_buckets_are_rewritten(spark):
    import os

    path = folder() + "/patterns"
    files = lambda: {f"{d}/{n}": os.stat(f"{d}/{n}").st_mtime_ns for d, _, names in os.walk(f"{path}/data") for n in names if n.endswith(".parquet")}
    tables.upsert_patterns(pattern(spark, [("f", f"p{i}", 0.5, "LOW") for i in range(300)]), path, 0, ["failure_id"])
    first = files()
    assert len(first) > 40
    reader = tables.read_patterns(spark, path)
    tables.upsert_patterns(pattern(spark, [("g", "p7", 0.9, "HIGH"), ("g", "new", 0.1, "LOW")]), path, 1, ["failure_id"])
    second = files()
    assert all(second[f] == t for f, t in first.items()) and len(second) - len(first) in (1, 2)
    assert reader.count() == 300  # what a reader has begun stays whole
    now = {r["fingerprint"]: (r["recurrence_count"], r["rca_confidence"]) for r in tables.read_patterns(spark, path).collect()}
    assert len(now) == 301 and now["p7"] == (1, 0.9) and now["p8"] == (0, 0.5)
    tables.upsert_patterns(pattern(spark, [("h", "p7", 0.2, "LOW")]), path, 2, ["failure_id"])
    assert buckets.commits(spark, path) == [1, 2]
    assert tables.read_patterns(spark, path, before=2).filter("fingerprint = 'p7'").head()["recurrence_count"] == 1
    assert tables.read_patterns(spark, path).filter("fingerprint = 'p7'").head()["recurrence_count"] == 2


def test_appended_buckets_are_joined_when_there_are_many(spark):
    path = folder() + "/keys"
    for i in range(5):
        buckets.append(spark.createDataFrame([(i, "a"), (i + 100, "b")], "k long, v string"), path, i, "k long, v string", ["k"], buckets=1, runs=3)
    assert [len(f) for f in buckets.newest(spark, path)["folders"].values()] == [2]
    assert sorted(r["k"] for r in buckets.read(spark, path, "k long, v string").collect()) == [0, 1, 2, 3, 4, 100, 101, 102, 103, 104]
    rows = spark.createDataFrame([(3,), (7,), (None,)], "k long")
    assert {r["k"] for r in buckets.unseen(rows, path, 9, "k long, v string", ["k"]).collect()} == {7, None}
    assert {r["k"] for r in buckets.unseen(rows, path, 3, "k long, v string", ["k"]).collect()} == {3, 7, None}


def test_a_second_run_embeds_unseen_fingerprints_only(spark):
    root, asked = folder(), []

    def embedder(texts):
        asked.append(sorted(r["key"] for r in texts.select("key").collect()))
        return dedup.hashing_embedder(texts)

    work = jobs.analysis_job(root, embedder=embedder)
    more = spark.createDataFrame([("f0", "t", 0, "fatal: something else entirely")], S.LINES)
    work(log_frame(spark), 0)
    for _ in range(2):
        work(log_frame(spark).unionByName(more), 1)
    assert len(asked[0]) >= 1 and len(asked[1]) == 1 and asked[1] == asked[2] and not set(asked[0]) & set(asked[1])
