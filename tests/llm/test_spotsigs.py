import hashlib
import re

from pyspark.sql import functions as F

from redbuild.llm import spotsigs as S


def plain_spots(text):
    """Anchor and its next two content words among the next eight words, as strings."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) if w]
    stop = set(S.ANCHORS)
    chain = lambda at, anchor: " ".join([anchor, *[w for w in words[at:at + 8] if w not in stop][:2]])
    return {chain(i + 1, w) for i, w in enumerate(words) if w in stop} | ({chain(0, "^")} if words else set())


def test_spots_equal_a_plain_loop(spark, make):
    texts = ["The cat of the house sat on a mat and slept", "no anchors here", "", None, "the the the", "de la Maison est grande", "is  \n it"]
    rows = make(texts).select("doc_id", S.spots(F.col("text")).alias("s")).collect()
    every = sorted({s for t in texts for s in plain_spots(t)})
    codes = {r["t"]: r["h"] for r in spark.createDataFrame([(s,) for s in every], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    for r in rows:
        assert r["s"] == sorted(codes[s] for s in plain_spots(texts[r["doc_id"]]))


def test_texts_without_anchors_are_seen_whole(make):
    one, two = (" ".join(f"{c}{i}" for i in range(100)) for c in "ab")
    texts = ["same start " + one, "same start " + two, "same start " + one[:len(one) // 2] + two[len(two) // 2:], '"The, cat (of) house', "the cat of house"]
    rows = {r["doc_id"]: set(r["s"]) for r in make(texts).select("doc_id", S.spots(F.col("text")).alias("s")).collect()}
    like = lambda a, b: len(rows[a] & rows[b]) / len(rows[a] | rows[b])
    assert like(0, 1) < 0.1 and 0.2 < like(0, 2) < 0.6
    assert len(rows[3]) == len(rows[4]) == 3 and rows[3] == rows[4]


def test_edited_texts_and_likeness(make):
    texts = [f"{'😀' if i % 3 == 0 else ''}the word{i} of a house and tree{i} " * (i % 4 + 1) for i in range(37)] + [None, "", "x"]
    ids = [i * 7 % 101 for i in range(len(texts))]
    rows = {r["doc_id"]: r for r in S.edited_texts(make(list(zip(ids, texts)))).collect()}
    order = sorted(ids, reverse=True)
    by = dict(zip(ids, texts))
    for at, i in enumerate(order):
        text, after = by[i] or "", by[order[(at + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        assert (rows[i]["n_chars"], rows[i]["edited"], rows[i]["next_text"]) == (len(text), edited, after)
        a, b = plain_spots(text), plain_spots(after)
        assert len(rows[i]["own"]) == len(a) and len(set(rows[i]["own"]) & set(rows[i]["next_own"])) == len(a & b)
        assert len(rows[i]["edited_own"]) == len(plain_spots(edited))


def test_near_pairs_equal_brute_force(make):
    base = [f"the w{i} x{i} of y{i} z{i} and" for i in range(40)]
    texts = [" ".join(base), " ".join(base[:-2]), " ".join(base[:-4] + ["a b c"]), " ".join(base[5:]), "other text", " ".join(base), "", None, " ".join(base[:30])]
    prints = S.fingerprinted(make(texts))
    got = {(r["a"], r["b"]): r["likeness"] for r in S.near_pairs(prints, 0.8).collect()}
    sets = {}
    for i, t in enumerate(texts):
        sets.setdefault(frozenset(plain_spots(t)), i)
    want = {}
    for x, i in sets.items():
        for y, j in sets.items():
            if i < j and x and y and len(x & y) / len(x | y) >= 0.8:
                want[i, j] = len(x & y) / len(x | y)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and want
    assert {r["doc_id"]: r["representative"] for r in S.members(prints).collect()}[5] == 0


def test_odd_input(odd, empty):
    rows = S.edited_texts(odd)
    assert rows.count() == odd.count()
    assert S.edited_texts(empty).count() == 0 and S.near_pairs(S.fingerprinted(empty)).count() == 0
    assert S.near_pairs(S.fingerprinted(odd)).count() == 0
    one = S.edited_texts(odd.filter("doc_id = 8")).head()
    assert one["next_text"] == one["text"]


def test_main_path_has_no_python(spark, small):
    from redbuild.llm.registered import QUERIES

    frame = QUERIES["op5_spotsigs"](spark, small)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = frame.collect()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    same = {}
    for r in rows:
        assert same.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    assert hashlib.sha256(b"").hexdigest() != rows[0]["edited_sha256"]
