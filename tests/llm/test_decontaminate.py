import hashlib
import random

import pytest

from redbuild.llm import decontaminate as D


def plain(text, items, window):
    words = [w.decode() for w in D_words(text)]
    hit, found = [False] * len(words), set()
    for name, item in items:
        iw = [w.decode() for w in D_words(item)]
        size = min(window, len(iw))
        grams = {tuple(iw[i:i + size]) for i in range(len(iw) - size + 1)} if size else set()
        for i in range(len(words) - size + 1 if size else 0):
            if tuple(words[i:i + size]) in grams:
                found.add(name)
                hit[i:i + size] = [True] * size
    return len(words), sum(hit), sorted(found)


def D_words(text):
    import re

    lowered = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)]


def case(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcé")
    items = [(str(i), " ".join(word() for _ in range(rng.randint(0, 14)))) for i in range(12)]
    texts = []
    for _ in range(40):
        parts = [" ".join(word().upper() for _ in range(rng.randint(0, 12))) + "! "]
        parts += [rng.choice(items)[1] + ", z " for _ in range(rng.randint(0, 3))]
        texts.append("".join(parts))
    return texts, items


@pytest.mark.parametrize("block_words", [200_000, 20])
def test_hits_equal_brute_force(spark, make, block_words):
    for seed in (1, 2):
        texts, items = case(seed)
        bench = spark.createDataFrame([(int(n), t) for n, t in items], "item_id long, text string")
        got = D.hit_runs(make(texts), bench, window=6, block_words=block_words).collect()
        assert len(got) == len(texts)
        for r in got:
            n, hit, found = plain(texts[r["doc_id"]], items, 6)
            assert (r["n_words"], sum(b - a for a, b in zip(r["starts"], r["ends"])), sorted(r["items"])) == (n, hit, found)


def test_spans_go_and_mostly_copied_documents_too(spark, make):
    item = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = make([f"Before it. {item.upper()} and {'more words ' * 20}", item, "clean words only", None, ""])
    got = {r["doc_id"]: r for r in D.decontaminate(docs, bench).collect()}
    assert set(got) == {0, 2, 3, 4}
    assert got[0]["text"].startswith("Before it.  and more") and got[0]["n_chars"] == len(got[0]["text"])
    assert got[2]["text"] == "clean words only" and got[3]["text"] is None


def test_blocks_do_not_change_what_is_cut(spark, make):
    first, second = " ".join(f"w{i}" for i in range(1, 13)), " ".join(f"w{i}" for i in range(8, 20))
    other = " ".join(f"v{i}" for i in range(25))
    bench = spark.createDataFrame([(1, first), (2, second), (3, other)], "item_id long, text string")
    overlap = "a b " * 20 + " ".join(f"w{i}" for i in range(1, 20)) + " the end"
    mostly = " ".join(f"v{i}" for i in range(20)) + " x " * 18 + first  # 32 of 50 words, in two blocks
    texts = [overlap, overlap, mostly, None, "", *case(1)[0]]
    got = [D.decontaminate(make(texts), bench, block_words=n).collect() for n in (20, 200_000)]
    assert len(D.item_blocks(bench, 20)) == 3
    assert sorted(map(str, got[0])) == sorted(map(str, got[1]))
    kept = {r["doc_id"]: r["text"] for r in got[0]}
    assert kept[0] == kept[1] == "a b " * 20 + " the end" and 2 not in kept and kept[3] is None


@pytest.mark.parametrize("block_words", [200_000, 1])
def test_equal_rows_and_items_without_id(spark, make, block_words):
    bench = spark.createDataFrame([(1, "a b c"), (2, "b c d"), (None, "x y z")], "item_id long, text string")
    docs = make([(1, "a b c d"), (1, "a b c d"), (None, "x y z w"), (None, "x y z w"), (3, None), (3, None)])
    got = sorted((r["doc_id"] or 0, r["n_words"], list(zip(r["starts"], r["ends"])), r["items"]) for r in D.hit_runs(docs, bench, 3, block_words).collect())
    assert got == [(0, 4, [(0, 3)], [])] * 2 + [(1, 4, [(0, 4)], ["1", "2"])] * 2 + [(3, 0, [], [])] * 2
    assert sum(r["text"] == " w" for r in D.decontaminate(docs, bench, 3, 1.0, block_words).collect()) == 2


def test_odd_input(spark, odd, empty):
    bench = spark.createDataFrame([(1, "same text of a row"), (None, "x"), (2, None), (3, ""), (1, "the end")], "item_id long, text string")
    got = D.hit_runs(odd, bench)
    assert got.count() == odd.count()
    assert {tuple(r["items"]) for r in got.filter("doc_id = 7").collect()} == {("1",)}
    assert got.filter("doc_id = 1").head()["n_words"] == 0
    for block_words in (200_000, 8):
        assert D.decontaminate(odd, bench, block_words=block_words).columns == odd.columns
    assert D.hit_runs(odd, bench.limit(0)).filter("size(items) > 0").count() == 0
    assert D.hit_runs(empty, bench).count() == 0 and D.decontaminate(empty, bench).count() == 0


def test_query_columns(spark, small):
    from redbuild.llm.registered import QUERIES

    rows = QUERIES["op3_decontamination"](spark, small).collect()
    bench = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        n, hit, found = plain(texts[r["doc_id"]], bench, 10)
        digest = hashlib.sha256(",".join(found).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(found), digest, hit > 0)
