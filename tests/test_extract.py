import random

import pytest

import scan_model
from redbuild.functions import signal_rules as R
from redbuild.operators import extract
from redbuild.operators.extract import INDENT, distinct_signals, extract_signals

SAMPLES = {
    "plain": ["compiling a.c", "", "  step 3 ok  ", "[2024-01-02T03:04:05.678Z] fetching", "café step"],
    "noise": ["Downloading from central: x", "Progress (3/9)", "[Pipeline] {", "[InfluxDB Plugin] INFO: data"],
    "single": [
        "3 tests failed", "build FAILED now", "unauthorized", "out of memory", "script exit code 3",
        "connection refused: 10.0.0.1:80", '{"level":"e","msg":"connection reset by peer"}', "a panic happened",
        '{"msg":"","error":"disk full","n":1}', '{"msg":0,"log":"crashed"}', '{"message":"ok","error":"fatal"}',
    ],
    "trigger": [
        "Traceback (most recent call last):", 'Exception in thread "main" x', "thread 'a' panicked at 'boom', x.rs",
        "panic: boom", "TypeError: x", "RuntimeError: y", "Fatal error: z", "Unhandled exception:",
        "FAILURE: Build failed with an exception.",
    ],
    "cont": [
        "ValueError: x", '  File "a.py", line 1', "  at a.B.c(B.java:1)", "Caused by: y", "note: run", "goroutine 1 [running]:",
        "main.go:3", "  at f (a.js:1:2)", "#1 A.b (p:c)", "Stack trace:", "* What went wrong:", "> Task x failed",
        "Execution failed for task x", "* Try again",
    ],
}


def random_file(rng, n, weights):
    return [rng.choice(SAMPLES[rng.choices(list(SAMPLES), weights)[0]]) for _ in range(n)]


def as_lines(spark, files):
    rows = [
        (f, s, i, raw) for (f, s), raws in files.items() for i, raw in enumerate(raws)
    ]
    return spark.createDataFrame(rows, "failure_id string, stage string, line_no long, raw string")


@pytest.mark.parametrize("chunk_lines,fan_in,levels", [(1, 2, 3), (1, 512, 2), (7, 3, 1), (7, 2, 0), (5, 4, 2), (4096, 512, 2)])
def test_scan_equals_the_model_on_random_files(spark, chunk_lines, fan_in, levels):
    rng = random.Random(7)
    mixes = [(90, 5, 3, 1, 1), (50, 10, 20, 10, 10), (10, 5, 5, 20, 60), (0, 0, 100, 0, 0), (5, 0, 0, 5, 90), (0, 0, 0, 2, 98)]
    files = {
        (f"f{k // 3}", f"s{k % 3}"): random_file(rng, rng.randint(1, 200), mixes[k % len(mixes)])
        for k in range(72)
    }
    expected = {}
    for (failure, stage), raws in files.items():
        for event in scan_model.scan(raws):
            expected[failure, stage, event["line_no"]] = event
    got = {
        (r["failure_id"], r["stage"], r["line_no"]): r.asDict()
        for r in extract_signals(as_lines(spark, files), chunk_lines=chunk_lines, fan_in=fan_in, levels=levels).collect()
    }
    assert len(expected) > 150
    assert got.keys() == expected.keys()
    for key, event in expected.items():
        for field, value in event.items():
            assert got[key][field] == value, (key, field)


def one(spark, raws, **kw):
    rows = extract_signals(as_lines(spark, {("f", "s"): raws}), **kw).orderBy("line_no").collect()
    return [r.asDict() for r in rows]


BLOCKS = [
    (["Traceback (most recent call last):", '  File "a.py", line 1, in f', "ValueError: x"],
     "traceback (most recent call last):", "", '  File "a.py"'),
    (["Traceback (most recent call last):", "ValueError: x", "next"],
     "valueerror: x", "traceback (most recent call last):", "next"),
    (['Exception in thread "main" x', "  at a.B.c(B.java:1)", "Caused by: y", "done"],
     'exception in thread "main" x', "at a.b.c(b.java:1)\ncaused by: y", "done"),
    (["FAILURE: Build failed with an exception.", "* What went wrong:", "> Task x failed", "done"],
     "task x failed", "failure: build failed with an exception.", "done"),
    (["Unhandled exception:", "Bad state"], "unhandled exception:", "", "Bad state"),
]


def test_golden_blocks(spark):
    files = {("f", str(k)): block[0] for k, block in enumerate(BLOCKS)}
    events = {e["stage"]: e for e in extract_signals(as_lines(spark, files)).collect()}
    for k, (_, error_line, inside, post) in enumerate(BLOCKS):
        event = events[str(k)]
        assert event["error_line"] == error_line
        assert event["pre_content"].lstrip("\n") == inside
        assert event["post_content"].startswith(post)
        assert event["signal_type"] == "ERROR"


def test_indent_mode_keeps_a_whole_traceback(spark):
    raws = ["Traceback (most recent call last):", '  File "a.py", line 1, in f', "    x()", "ValueError: x", "next"]
    (event,) = one(spark, raws, mode=INDENT)
    assert event["error_line"] == "valueerror: x"
    assert event["post_content"] == "next\n"


def test_suppression_single_and_block(spark):
    raws = ["ok"] * 30
    for at in (0, 5, 21, 22):
        raws[at] = f"unauthorized {at}"
    assert [e["line_no"] for e in one(spark, raws)] == [0, 22]
    raws = ["ok"] * 30
    raws[0] = "Error: x"
    for at in (20, 21, 22):
        raws[at] = f"unauthorized {at}"
    assert [e["line_no"] for e in one(spark, raws)] == [0, 22]
    assert [e["line_no"] for e in one(spark, raws, post_context=2)] == [0, 20]


def test_first_of_a_fingerprint_is_kept_across_stages(spark):
    files = {("f", "b"): ["unauthorized 1"], ("f", "a"): ["ok", "unauthorized 2"], ("g", "z"): ["unauthorized 3"]}
    rows = distinct_signals(extract_signals(as_lines(spark, files))).collect()
    assert sorted((r["failure_id"], r["stage"], r["line_no"]) for r in rows) == [("f", "a", 1), ("g", "z", 0)]


def test_no_task_needs_a_whole_file(spark):
    """What is dealt out by the file alone is one row for fan_in chunks, or for fan_in such rows."""
    lines = as_lines(spark, {("f", "s"): ["unauthorized"] * 400})
    plan = extract_signals(lines, chunk_lines=2, fan_in=4)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapIn" not in plan and "Python" not in plan
    rows = extract._functions(_ran(lines), 2, 20)
    assert rows.count() == 200
    nodes = extract._composed(extract._parents(rows, 8, 20), 8, 2, 20)
    assert nodes.count() == 50 and extract._composed(extract._parents(nodes, 32, 20), 32, 8, 20).count() == 13


def _ran(lines):
    ends = extract._run_ends(extract._marked(extract.line_facts(lines), 2), 2)
    return extract._candidates(ends, 2, 20)


def test_lines_are_judged_once(spark):
    """The plan of the signals reads the lines for their text only; their regexes have run before, once."""
    lines = as_lines(spark, {("f", "s"): ["unauthorized", "ok"] * 40})
    plan = extract_signals(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert R.SIGNAL_TYPES["SECURITY"][1] not in plan
