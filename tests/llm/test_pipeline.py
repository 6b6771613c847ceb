from collections import Counter, defaultdict

import corpus_pipeline
from redbuild.llm import decontaminate
from test_mixing import plain_targets
from test_simhash import plain_kept


def test_stages_against_plain_versions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    bench = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    (_, quality), (_, near), (_, clean), (_, mixture), (_, shards) = corpus_pipeline.STAGES

    good = quality(spark, docs, small)
    assert good.columns == docs.columns
    kept = {r["doc_id"]: r for r in good.collect()}
    fine = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in fine) / len(fine) > 0.98
    assert all(kept[i] == before[i] for i in kept)

    single = {r["doc_id"]: r for r in near(spark, good, small).collect()}
    assert {(i, r["text"]) for i, r in single.items()} == plain_kept([(i, r["text"]) for i, r in kept.items()])

    free = clean(spark, near(spark, good, small), small)
    automaton = decontaminate.Automaton([(n, decontaminate.words(t)) for n, t in bench], 10)
    rows = {r["doc_id"]: r for r in free.collect()}
    for i, r in single.items():
        runs, _ = automaton.scan(decontaminate.words(r["text"]))
        hit = sum(b - a for a, b in runs)
        n = len(decontaminate.words(r["text"]))
        assert (i in rows) == (hit <= 0.5 * n)
        if i in rows:
            assert (rows[i]["text"] == r["text"]) == (hit == 0)
            assert len(decontaminate.words(rows[i]["text"])) == n - hit

    mixed = mixture(spark, free, small)
    taken = Counter(r["doc_id"] for r in mixed.collect())
    assert max(taken.values()) <= 2 and mixed.columns == docs.columns
    size = {i: len((r["text"] or "").split()) for i, r in rows.items()}
    sizes, got = defaultdict(int), defaultdict(int)
    for i, r in rows.items():
        sizes[r["source"]] += size[i]
        got[r["source"]] += size[i] * taken[i]
    goal = plain_targets(dict(sizes), (3, 1, 2), 1.5, 2.0)
    assert all(abs(got[s] - goal[s]) <= max(size.values()) / 2 + 1 for s in goal)

    placed = shards(spark, mixed, small).collect()
    assert Counter(r["doc_id"] for r in placed) == taken
    counts = Counter(r["shard"] for r in placed)
    assert max(counts.values()) - min(counts[s] for s in range(40)) <= 1


def test_odd_input(spark, odd, empty, small):
    for frame in (odd, empty):
        docs = frame
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, small)
            assert name == "shards" or docs.columns == frame.columns
        docs.collect()


def test_registered(spark):
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
