import random

import numpy as np

from redbuild.llm import suffixes as S


def test_suffix_array_equals_sorting():
    rng = random.Random(7)
    for _ in range(1500):
        s = [rng.randint(1, rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(0, 40))]
        assert S.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def plain(texts, length):
    """(doc_id, text) in order -> (n_bytes, removed, runs, kept)."""
    seen, out = set(), {}
    for i, text in texts:
        data = (text or "").encode()
        covered = bytearray(len(data))
        for a in range(len(data) - length + 1):
            window = data[a:a + length]
            if window in seen:
                covered[a:a + length] = b"\1" * length
            seen.add(window)
        runs = sum(covered[k] and not (k and covered[k - 1]) for k in range(len(data)))
        out[i] = (len(data), sum(covered), runs, bytes(x for x, c in zip(data, covered) if not c))
    return out


def cases(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randint(8, 40)) for _ in range(6)]
    texts = [None, "", "x" * 700, "ab" * 400, "short"]
    for _ in range(60):
        texts.append(" ".join(rng.choice([prose(rng.randint(1, 30)), rng.choice(passages), rng.choice(passages)[3:60], "-" * rng.randint(1, 150)])
                              for _ in range(rng.randint(1, 6))))
    texts += texts[5:15] + ["x" * 1_500 + prose(20)]
    ids = rng.sample(range(1000), len(texts))
    return list(zip(ids, texts))


def removed(frame, length=100):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in S.without_repeats(frame, length).collect()}


def test_removal_equals_brute_force(make):
    for seed, length in ((1, 100), (2, 60)):
        rows = cases(seed)
        assert removed(make(rows), length) == plain(sorted(rows), length)


def test_large_groups_and_short_segments_give_the_same(make, monkeypatch):
    rows = cases(3)
    want = plain(sorted(rows), 100)
    monkeypatch.setattr(S, "GROUP", 300)  # all but small groups: window by window
    monkeypatch.setattr(S, "SEGMENT", 1_000)
    monkeypatch.setattr(S, "BLOCK", 500)
    # Workers import the module anew, so the steps are run here on one partition.
    import pyarrow as pa

    def batch(**columns):
        return iter([pa.RecordBatch.from_pydict(columns)])

    docs = sorted(rows)
    scanned = pa.Table.from_batches(S._scanner(100)(batch(_doc=[i for i, _ in docs], text=[t for _, t in docs]))).combine_chunks()
    order = [(c, "ascending") for c in ("kind", "key", "hash", "doc", "at")]
    met = pa.Table.from_batches(S._met(100)(iter(scanned.sort_by(order).to_batches(max_chunksize=37))))
    parts, by = [], dict(docs)
    spans = [(r["doc"], r["key"], r["at"]) for r in met.to_pylist() if r["kind"] == 1]
    for r in met.to_pylist():
        if r["kind"] == 2:
            start = r["at"] >> 16
            parts.append({"key": r["key"], "doc": r["doc"], "start": start, "part": by[r["doc"]].encode()[start:start + (r["at"] >> 1 & 0x7FFF) + 99]})
    table = pa.Table.from_pylist(parts).sort_by([("key", "ascending"), ("doc", "ascending"), ("start", "ascending")])
    looked = pa.Table.from_batches(S._sorter(100)(iter(table.to_batches(max_chunksize=11))))
    windows = looked.filter(pa.compute.equal(looked["kind"], 3))
    assert windows.num_rows
    told = pa.Table.from_batches(S._met(100)(iter(windows.sort_by(order).to_batches(max_chunksize=50))))
    spans += [(r["doc"], r["key"], r["at"]) for t in (looked, told) for r in t.to_pylist() if r["kind"] == 1]
    for i, text in docs:
        covered = np.zeros(len((text or "").encode()), dtype=bool)
        for doc, a, b in spans:
            if doc == i:
                covered[a:b] = True
        assert covered.sum() == want[i][1], i


def test_odd_input(odd, empty):
    rows = S.without_repeats(odd).collect()
    assert len(rows) == odd.count()
    assert {r["n_bytes"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    (long,) = [r for r in rows if r["doc_id"] == 5]
    assert long["n_removed"] > 299_000 and S.without_repeats(empty).count() == 0
