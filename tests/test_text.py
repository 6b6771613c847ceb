import random

from pyspark.sql import functions as F

import scan_model
from redbuild.functions import signal_rules as R
from redbuild.functions import text as X


def apply(spark, fn, values):
    rows = [(i, v) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "i int, v string").select("i", fn(F.col("v")).alias("o"))
    return [r["o"] for r in frame.orderBy("i").collect()]


def check(spark, fn, pairs):
    assert apply(spark, fn, [p[0] for p in pairs]) == [p[1] for p in pairs]


def test_clean_line(spark):
    check(spark, X.clean_line, [
        ("[2024-01-02T03:04:05.678Z] ERROR: Build FAILED", "error: build failed"),
        ("2024-01-02 03:04:05,123 build 12:00:01 done  ", "build  done"),
        ("03:04 not stripped", "03:04 not stripped"),
        ('{"msg":"","error":"Disk Full"}', "disk full"),
        ('{"msg":0,"message":false,"err":[],"text":null,"log":7}', "7"),
        ('{"msg":true}', "true"), ('{"a":1}', '{"a":1}'), ("{broken", "{broken"),
    ])


def test_normalized_error_line_and_fingerprint(spark):
    check(spark, X.normalize_error_line, [
        ("make: *** [makefile:42] error 1", "make makefile <NUM> error <NUM>"),
        ("fatal error: src/hal.h: no such file or directory", "fatal error src<PATH> no such file or directory"),
        ("error at c:\\work\\a.c line 7 #deadbeef", "error at <PATH> line <NUM> <ID>"),
        ("\x1b[31mbuild failed\x1b[0m in 12.5s", "build failed in <NUM> <NUM>s"),
        ("See #12 and/or https://ci/x", "see <NUM> and<PATH> https <PATH>"),
        ("", ""),
    ])
    check(spark, X.fingerprint, [
        ("make: *** [makefile:42] error 1", "24a5b2f4d9f7f3d6aadb9a76edcd83598dc4e3f49d9e4939f82136dba85c11ad"),
        ("connection refused: 10.0.0.1:8080", "274ab868869ad2dfaa00a18395cdde379954dc1542807e17873ae671ae132ef6"),
        ("", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"),
    ])


def test_text_for_embedding(spark):
    check(spark, X.normalize_for_embedding, [
        ("Error: compile failed at line 42 in /home/ci/app/main.py", "<error_type>: compile failed at line <num> in main.py"),
        ("12:30:11.512 test 3 failed: expected 404 got 0xDEADBEEF", "<time> test <num> failed: expected 404 got <addr>"),
        ("Stack trace: commit deadbeef99 took 12.5 s, 20480 bytes", "<exception_marker>: commit <hash> took <float> s, <bignum> bytes"),
        ("C:\\work\\app\\lib\\home.dart:112:67: Error", "home.dart:1<time>: error"),
        ("a/b and /usr/lib/x", "a/b and <path>"),
    ])


def test_signal_types(spark):
    lines = [
        ("3 tests failed", None, "TEST_FAILURE"), ("build failed with exit code 2", None, "BUILD_FAILURE"),
        ("script exit code 0", None, None), ("script exit code 10", None, "EXIT_CODE"),
        ("see error.c for details", None, None), ("error: build failed", "node_error", "BUILD_FAILURE"),
        ("fatal error: x.h: no such file", "php_fatal", "ERROR"), ("write enospc", None, None),
    ]
    texts = [x[0] for x in lines]
    assert apply(spark, X.block_trigger, texts) == [x[1] for x in lines]
    assert apply(spark, X.signal_type, texts) == [x[2] for x in lines]


def test_cheap_tests_never_lose_a_line(spark):
    """The word lists only skip lines that no pattern matches."""
    rng = random.Random(5)
    words = R.SIGNAL_WORDS + R.CONTINUATION_WORDS + [
        "failed", "tests", "build", "not", "connect", "resolve", "host", "timed", "err!", "code", "3", "0", "at f(a:1:2)",
        "image", "pull", "to", "on", "device", "left", "no", "full", "quota", "exceeded", "of", ":", "try", "went", "what",
        "thread 'a' panicked at", "unhandled exception:", "parse error: x", "service", "name", "or", "handshake", "aborted",
    ]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(3000)]
    expected = [scan_model.kind_of(x)[1] is not None for x in lines]
    assert apply(spark, X.may_signal, lines) == expected
    assert 500 < sum(expected) < 2900
    continues = [any(p.search(x) for p in scan_model.CONTINUES.values()) for x in lines]
    assert apply(spark, X.may_continue, lines) == continues


def test_small_functions(spark):
    check(spark, X.sanitize_stage, [("  Unit Test/2 ", "unit_test_2"), ("a.b-c_d", "a.b-c_d")])
    row = spark.range(1).select(
        X.dedup_text(F.lit("e"), F.lit("x" * 5 + "y" * 100), F.lit("")).alias("a"),
        X.training_text(F.lit("e"), F.lit("x" * 5 + "y" * 100), F.lit("")).alias("b"),
    ).head()
    assert row["a"] == "e " + "y" * 100 and row["b"] == "e " + "x" * 5 + "y" * 95


def test_each_pattern_has_its_words(spark):
    assert {k: len(v) for k, v in R.SIGNAL_TYPES.items()} == {k: len(v) for k, v in R.SIGNAL_TYPE_WORDS.items()}
    assert list(R.BLOCK_TRIGGERS) == list(R.BLOCK_TRIGGER_WORDS)
    assert {w for ws in R.SIGNAL_TYPE_WORDS.values() for own in ws for w in own if not any(s in w for s in R.SIGNAL_WORDS)} == {
        "assert", "test", "build", "access", "auth", "permission", "http"
    }
    rng = random.Random(6)
    words = [w for ws in R.SIGNAL_TYPE_WORDS.values() for own in ws for w in own] + [w for ws in R.BLOCK_TRIGGER_WORDS.values() for w in ws] + [
        "failed", "assertion failed", "tests failed", "access denied", "not resolve artifact", "cannot find symbol", "err!", "no matching", "found",
        "to pull", "pull", "authentication failed", "handshake error", "left on device", "quota exceeded", "refused", "not connect", "host",
        "to", "service not", "name or", "exceeded", "code 3", "= 7", "(most recent call last):", "in thread", "a.b.exception: x", "thread 'a'",
        "at", "unhandled exception:", "build failed with an exception", "parse error: x", "typeerror: x", "a:error: y", "timed", "of",
    ]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    kinds = apply(spark, X.kinds, lines)
    assert [(k["block_type"], "ERROR" if k["block_type"] else k["signal_type"]) for k in kinds] == [scan_model.kind_of(x) for x in lines]


def test_fingerprint_text_is_that_of_all_rewrites(spark):
    rng = random.Random(7)
    parts = [
        "\x1b[0m", "[2024-01-02t03:04:05.678z]", "c:\\a b", ":\x1b[1m\\x", "/a/b c", "12", "#a1f", "#", "<x>", "é", "\u00a0", "\t", "\n", "  ", "a_b", "-",
        "!?", "K", "\u2028", "[", "]", ":", "\\", "E",
    ]
    lines = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(3000)] + [None]

    def step_by_step(line):
        out = F.lower(F.coalesce(line, F.lit("")))
        for pattern, replacement in R.FINGERPRINT_REWRITES:
            out = F.regexp_replace(out, pattern, replacement)
        return X.strip(out)

    assert apply(spark, X.normalize_error_line, lines) == apply(spark, step_by_step, lines)
    plan = spark.range(1).select(X.normalize_error_line(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(") == len(R.FINGERPRINT_REWRITES) - 1
