import random
import re

import pytest
from pyspark.sql import functions as F

from redbuild.functions import category_rules as C
from redbuild.operators import ci_runs, classify, failures, knowledge, learn, needles, rca, report
from redbuild.sources import schemas as S


def test_catalogue_size_and_check():
    assert {c: len(p) for c, p in C.CATEGORY_PATTERNS.items()} == {"DEV_FAILURE": 54, "TEST_FAILURE": 9, "CI_INFRA_FAILURE": 127}
    with pytest.raises(ValueError):
        classify.check_catalogue({"NO_SUCH": ["x"]})


def test_confidence_and_fusion(spark):
    rows = [(5, 1, 0.70), (10, 2, 0.89), (2, 1, 2 / 9), (3, 1, 3 / 9), (0, 0, 0.0), (3, 3, 1 / 9 + 0.16)]
    frame = spark.createDataFrame(rows, "s int, n int, want double")
    for r in frame.select(classify.confidence(F.col("s"), F.col("n")).alias("c"), "want").collect():
        assert abs(r["c"] - r["want"]) < 1e-9
    dev, infra, unknown = "DEV_FAILURE", "CI_INFRA_FAILURE", "UNKNOWN"
    cases = [
        (dev, 0.70, None, None, dev, 0.455), (dev, 0.70, dev, 1.0, dev, 0.805), (dev, 0.70, infra, 1.0, unknown, 0.0),
        (dev, 0.89, None, None, dev, 0.5785), (dev, 2 / 9, None, None, unknown, 0.0), (dev, 1 / 3, dev, 1.0, dev, 0.566667),
        (unknown, 0.0, dev, 1.0, unknown, 0.0), (unknown, 0.0, None, None, unknown, 0.0),
    ]
    frame = spark.createDataFrame(
        cases, "regex_category string, regex_confidence double, semantic_category string, semantic_confidence double, want string, conf double"
    )
    for r in classify.fuse(frame).collect():
        assert (r["category"], round(r["confidence"], 6)) == (r["want"], r["conf"])


def test_neighbour_tie_goes_to_the_first_met(spark):
    queries = spark.createDataFrame([("q", [0.0, 0.0])], "id string, vec array<double>")
    training = spark.createDataFrame(
        [(1, "A", [0.0, 0.0]), (2, "B", [1.0, 0.0]), (3, "B", [0.0, 1.0])], "sample_id long, category string, embedding array<double>"
    )
    (best,) = classify.neighbour_best(classify.neighbour_votes(queries, training)).collect()
    assert (best["semantic_category"], best["semantic_confidence"]) == ("A", 0.5)


def test_training_samples(spark):
    samples = learn.training_samples(spark).cache()
    counts = {r["category"]: r["samples"] for r in learn.samples_per_category(samples).collect()}
    assert counts == {"DEV_FAILURE": 208, "TEST_FAILURE": 64, "CI_INFRA_FAILURE": 352}
    assert samples.select("sample_id").distinct().count() == 624
    assert samples.filter(F.concat("error_line", "post_content").rlike(r"\{[a-z_0-9]+\}")).count() == 0
    assert samples.select("error_line").distinct().count() > 200


def test_upsert_counts_recurrences_and_keeps_the_first(spark):
    rows = [(1, "p", 0.6, "HIGH"), (2, "p", 0.7, "LOW"), (3, "p", 0.9, "LOW")]
    arrivals = spark.createDataFrame(rows, "seq int, fingerprint string, rca_confidence double, severity string").select(
        "seq", "fingerprint", "rca_confidence", "severity", F.lit(0).alias("recurrence_count"), F.array(F.lit(1.0)).alias("embedding")
    )
    once = knowledge.upsert(None, arrivals, ["seq"])
    (r,) = once.collect()
    assert (r["recurrence_count"], r["rca_confidence"], r["severity"]) == (2, 0.9, "HIGH")
    (r,) = knowledge.upsert(once, arrivals.filter("seq = 1"), ["seq"]).collect()
    assert (r["recurrence_count"], r["rca_confidence"], r["severity"]) == (3, 0.6, "HIGH")


def test_feedback_takes_full_batches(spark):
    pending = spark.range(45).select(F.format_string("%03d", "id").alias("fingerprint"))
    now, later = learn.feedback_batch(pending, ["fingerprint"])
    assert now.count() == 40 and later.count() == 5
    assert now.agg(F.max("fingerprint")).head()[0] == "039"


def remediation(spark, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    return frame.select("t", rca.decode_remediation(F.col("t")).alias("remediation")).withColumns(
        {"rca_confidence": F.lit(0.9), "severity": F.lit("LOW")}
    )


def test_remediation_rules(spark):
    cases = {
        '{"action":"FIX_DEV","strategy":"CLEAN_REBUILD","target":"x","suggested_patch":"p","patch_confidence":0.4}': [],
        '{"action":"FIX_TEST","strategy":"SKIP_TEST_TEMPORARILY","target":"x"}': [],
        '{"action":"FIX_TEST","strategy":"MARK_FLAKY_RETRY","target":"x","retry_count":9}': ["retry_count"],
        '{"action":"FIX_DEV","strategy":"FIX_CODE_QUALITY","target":"x"}': ["strategy"],
        '{"action":"FIX_DEV","strategy":"UPDATE_ENV_MOCK","target":"x"}': [],
        "{}": ["reason"],
    }
    got = {r["t"]: r for r in rca.validate(remediation(spark, list(cases))).collect()}
    assert {t: r["errors"] for t, r in got.items()} == cases
    first, second = list(cases)[:2]
    assert got[first]["remediation"]["suggested_patch"] is None and got[first]["remediation"]["patch_confidence"] is None
    assert got[second]["remediation"]["skip_reason"] == rca.DEFAULT_SKIP_REASON
    undecodable = remediation(spark, ['{"action":"REBOOT"}', "not json"]).select("remediation").collect()
    assert all(r["remediation"] is None for r in undecodable)
    for r in rca.validate(remediation(spark, ['{"action":"REBOOT"}', "not json"])).collect():
        assert r["errors"] == ["remediation"] and not r["valid"]
    none = remediation(spark, [first]).withColumn("rca_confidence", F.lit(None).cast("double"))
    assert rca.validate(none).head()["errors"] == ["rca_confidence"]
    whole = remediation(spark, [first]).withColumns({
        "root_cause": F.lit(None).cast("string"), "error_line": F.lit(None).cast("string"), "recurrence_count": F.lit(-1),
        "similarity_score": F.lit(1.5), "secondary_remediations": rca.decode_remediations(F.lit('[{"action":"FIX_DEV"}]')),
    })
    assert rca.validate(whole).head()["errors"] == ["root_cause", "error_line", "recurrence_count", "similarity_score", "secondary_remediations"]
    low = remediation(spark, [first]).withColumn("rca_confidence", F.lit(0.2))
    assert rca.validate(low).head()["errors"] == ["manual_expected"]
    lists = spark.createDataFrame([('[{"reason":"a"}]',), ('[{"action":"X"}]',)], "t string")
    assert [r[0] is None for r in lists.select(rca.decode_remediations(F.col("t"))).collect()] == [False, True]


def test_root_causes_follow_the_classifier(spark):
    rows = [("f", "s", "fp", "DEV_FAILURE", 0.8, "DEVELOPERS", "boom" * 200, "", None), ("f", "s", "fq", "UNKNOWN", 0.0, "UNOWNED", "x", "p", "q")]
    classified = spark.createDataFrame(
        rows, "failure_id string, stage string, fingerprint string, category string, confidence double, owner_team string, error_line string, pre_content string, post_content string"
    )
    got = {r["fingerprint"]: r for r in rca.root_causes(classified).collect()}
    assert all(r["valid"] for r in got.values())
    assert got["fp"]["remediation"]["strategy"] == "CLEAN_REBUILD" and got["fq"]["remediation"]["action"] == "MANUAL_INVESTIGATION"
    assert got["fp"]["owner"] == "DEVELOPERS" and got["fp"]["error_line"] == "boom" * 200
    request = {r["fingerprint"]: r for r in rca.requests(classified).collect()}["fp"]
    assert len(request["error_line"]) == 400 and request["before"] == "(none)" and request["after"] == "(none)"


def test_ci_status_and_stage_lines(spark):
    names = ["success", "failure", "timed_out", "skipped", None, "cancelled", "action_required", "other"]
    frame = spark.createDataFrame([(n,) for n in names], "c string").select("c", ci_runs.normalized_status(F.col("c")).alias("result"))
    got = {r["c"]: r["result"] for r in frame.collect()}
    assert [got[n] for n in names] == ["SUCCESS", "FAILURE", "FAILURE", "NOT_BUILT", "NOT_BUILT", "ABORTED", "UNSTABLE", "UNSTABLE"]
    assert {r["c"] for r in ci_runs.failed_stages(frame).collect()} == {"failure", "timed_out", "cancelled", "action_required", "other"}
    steps = spark.createDataFrame([("r", "s", 2, "c\n"), ("r", "s", 1, "a\r\nb\n")], "run string, stage string, pos int, log string")
    assert ci_runs.stage_logs(steps).head()["content"] == "a\r\nb\nc\n"
    lines = ci_runs.stage_lines(steps).orderBy("line_no").collect()
    assert [(r["line_no"], r["raw"]) for r in lines] == [(0, "a"), (1, "b"), (2, "c")]
    same = spark.createDataFrame([("r", "s", 7, "x\n"), ("r", "s", 7, "x\n"), ("r", "s", 7, "w\n"), ("r", "s", 9000, "z\n"), ("r", "s", None, "n\n")], "run string, stage string, pos int, log string")
    assert [(r["line_no"], r["raw"]) for r in ci_runs.stage_lines(same, 10).orderBy("line_no").collect()] == list(enumerate("nwxxz"))
    assert ci_runs.one_log_per_job(steps).count() == 1 and ci_runs.one_log_per_job(steps, True).count() == 2


def test_platform_and_intake(spark):
    rows = [("c", "b", None, None, "o", "r", 5), ("c", "b", None, 3, "o", "r", None), ("c", "b", "j", 3, None, None, None),
            ("c", "b", "j", None, None, None, None), ("c", "b", None, None, None, None, None)]
    payloads = spark.createDataFrame(
        [(*r, None) for r in rows], S.PAYLOAD
    )
    got = failures.platform_of(payloads).collect()
    assert [(r["platform"], r["effective_run"], r["reject_reason"]) for r in got] == [
        ("github", 5, None), ("github", 3, None), ("jenkins", 3, None), ("jenkins", None, "build_number missing"), ("jenkins", None, "platform unknown")]
    records = failures.intake(payloads).collect()
    assert len({r["failure_id"] for r in records}) == 3 and {r["status"] for r in records} == {"RECEIVED"}
    held = failures.quarantine(payloads).collect()
    assert sorted(r["reject_reason"] for r in held) == ["build_number missing", "platform unknown"]
    found = failures.find_duplicate(failures.intake(payloads), "jenkins", "c", "b", "j", 3).collect()
    assert [r["payload"]["build_number"] for r in found] == [3]


def test_report_bands_and_rounding(spark):
    frame = spark.createDataFrame(
        [("f", "DEVELOPERS", "LOW", 0.125, "a"), ("f", "TEST_ENGINEERS", "CRITICAL", 0.125, "b"), ("f", "DEVOPS_ENGINEERS", "LOW", 0.125, "c")],
        "failure_id string, owner string, severity string, rca_confidence double, fingerprint string",
    ).withColumns({"validated_category": F.lit("x"), "root_cause": F.lit("r"), "error_line": F.lit("e"), "recurrence_count": F.lit(3),
                   "similarity_score": F.lit(None).cast("double"), "analyzed_at": F.lit("t"), "evidence_url": F.lit(None).cast("string")})
    (s,) = report.summary(frame).collect()
    assert (s["total"], s["devops"], s["developers"], s["critical"], s["avg_percent"], s["avg_band"]) == (3, 1, 1, 1, 12, "Low")
    rows = report.rows(frame).orderBy("number").collect()
    assert [r["owner"] for r in rows] == ["DEVOPS_ENGINEERS", "DEVELOPERS", "TEST_ENGINEERS"]
    assert [r["number"] for r in rows] == [1, 2, 3] and rows[0]["confidence_percent"] == 12
    many = spark.range(3000).select(F.lit("f").alias("failure_id"), F.lit("DEVELOPERS").alias("owner"), F.lit("LOW").alias("severity"), F.lit(0.5).alias("rca_confidence"),
                                    F.sha2(F.col("id").cast("string"), 256).alias("fingerprint"), F.when(F.col("id") > 0, F.col("id") * 3).alias("sequence")).withColumns(
        {c: F.lit("x") for c in ("validated_category", "root_cause", "error_line", "analyzed_at", "evidence_url")}
    ).withColumns({"recurrence_count": F.lit(0), "similarity_score": F.lit(0.5)})
    got = report.rows(many, order="sequence", buckets=7).select("number", "fingerprint").collect()
    want = {r["fingerprint"][:16]: r["sequence"] for r in many.collect()}
    assert [want[r["fingerprint"][:16]] for r in sorted(got)] == [None, *range(3, 9000, 3)]
    mail = spark.createDataFrame([("f", "ci@x", "", None), ("g", "a", "b", "c")], "failure_id string, ci_email string, dev_email string, test_email string")
    got = {r["failure_id"]: r["recipients"] for r in report.recipients(frame, mail, "d@x").collect()}
    assert got == {"f": ["ci@x"], "g": ["d@x"]}


def test_null_keys_are_no_duplicates(spark):
    keys = ["github", "c", "b", None, 5]
    rows = [(*keys, 1), (*keys, 2), ("jenkins", "c", "b", "j", 1, 3), ("jenkins", "c", "b", "j", 1, 4), ("jenkins", "c", "b", "j", None, 5)]
    frame = spark.createDataFrame(rows, "platform string, commit string, branch string, job_name string, build_number long, nr int")
    assert sorted(r["nr"] for r in failures.drop_duplicates(frame, "nr").collect()) == [1, 2, 3, 5]


def test_each_remediation_is_parsed_once(spark):
    frame = spark.createDataFrame([('{"reason":"a"}', 0.9, "LOW")], "stored string, rca_confidence double, severity string")
    checked = rca.validate(rca.decoded(frame, remediation="stored"))
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1, plan
    assert checked.head()["valid"]


SCORED = "failure_id string, stage string, line_no long, fingerprint string, error_line string, pre_content string, post_content string"


def test_a_catalogue_of_any_size_takes_one_pass(spark):
    signals = spark.createDataFrame([("f", "s", 0, "fp", "disk full code7", "", "net down"), ("f", "s", 1, "g", None, None, "x")], SCORED)
    words = ["disk", "full", "net", "down", "nothing"] + [f"code{i}" for i in range(9_995)]
    catalogue = spark.createDataFrame([("DEV_FAILURE" if i % 2 else "CI_INFRA_FAILURE", f"{i:05}", w) for i, w in enumerate(words)], "category string, pattern_id string, regex string")
    scored = classify.score_with_table(signals, catalogue)
    assert scored._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") <= 1
    got = {(r["fingerprint"], r["category"]): (r["score"], r["matches"]) for r in scored.collect()}
    # code7 is the thirteenth word.
    assert got == {("fp", "CI_INFRA_FAILURE"): (5 + 2 + 5, 3), ("fp", "DEV_FAILURE"): (5 + 2, 2)}
    assert classify.score_with_table(signals, catalogue.limit(0)).count() == 0


def test_patterns_are_those_of_java(spark):
    signals = spark.createDataFrame([("f", "s", 0, "fp", "Err ABC seen", "", "")], SCORED)
    regexes = [r"(?<kind>err)\s", r"\p{Alpha}+ abc", r"\Qabc\E s", r"(?x) se en", r"[a-z&&[^x]]bc"]
    scored = classify.explain_scores(classify.category_scores(signals, {"DEV_FAILURE": regexes})).collect()
    assert [(r["score"], r["matches"]) for r in scored] == [(25, 5)]


def test_needles_are_in_every_match():
    cases = {
        r"(?:foo|ba)r+x": ["ba", "foo"], r"a+bc": ["abc"], r"ab{2,3}cd": ["bcd"], r"colou?r is": ["colo"], r"x[abc]hello": ["hello"],
        r"(abc)?def": ["def"], r"foo|bar": ["bar", "foo"], r"ab*cd": ["cd"], r"aa\.bb": ["aa.bb"], r"(a|b)c": None, r"(?x) ab c": None,
        r"[]ab]cde": None, r"\Qa.b\E": None, r"x{0}abc|d": None, r"\bword\b$": ["word"], r"(": None, r"ab[": None, "": None,
    }
    assert {p: needles.needles(p) for p in cases} == cases
    rng = random.Random(3)
    parts = ["ab", "c", "d+", "e?", "(?:fg|hi)", "[xy]", "(jk)*", "l{2}", ".", "\\s", "mn|op"]
    for _ in range(3_000):
        pattern = "".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))
        own = needles.needles(pattern)
        for _ in range(5):
            text = "".join(rng.choice(["ab", "c", "d", "e", "fg", "hi", "x", "jk", "ll", " ", "mn", "op", "AB"]) for _ in range(8))
            found = re.search(pattern, text, re.I)
            assert not (found and own) or any(n in found[0].lower() for n in own), (pattern, own, text)
