import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from redbuild.llm import records

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_encoder_equals_the_library():
    library = Tokenizer.from_file(PATH)
    rng = random.Random(2)
    parts = ["the", "Thon,", "a\n", "\n\n", " ", "  ", "\t", "don't", "'s", "é", "中文", "😀", "12", "x1", "--", "<|endoftext|>", " ", " ", "a\n b"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + ["", " ", "one two"]
    got = records.Encoder(PATH)(texts)
    for text, ids in zip(texts, got):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_other_tokenizers_see_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    text = "Some words, and more  of them"
    assert records.Encoder(path)([text])[0].tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_frames_round_trip_and_tell_damage():
    for ids in ([], [1, 2, 65_535], [70_000, 1]):
        payload = records.packed(np.array(ids, dtype="<u4"))
        data = records.frame(payload)
        assert records.unpacked(records.read_frame(io.BytesIO(data))).tolist() == ids
        for at in range(len(data)):
            broken = bytearray(data)
            broken[at] ^= 1
            with pytest.raises((ValueError, OverflowError, MemoryError)):
                records.read_frame(io.BytesIO(bytes(broken)))
        with pytest.raises(ValueError):
            records.read_frame(io.BytesIO(data[:-1]))
    assert records.read_frame(io.BytesIO(b"")) is None


def back(spark, docs):
    folder, index = records.write_records(docs, PATH)
    return folder, index, records.read_records(folder, records.shards(index))


def test_records_come_back_in_order(spark, make):
    ids = random.Random(3).sample(range(-500, 5000), 400)
    docs = make([(i, f"text {i} " * (i % 7)) for i in ids])
    folder, index, read = back(spark, docs)
    library, start = Tokenizer.from_file(PATH), 0
    got = {r["doc_id"]: (r["start"], bytes(r["ids"])) for r in read.collect()}
    for i in sorted(ids):
        want = np.array([*library.encode(f"text {i} " * (i % 7), add_special_tokens=False).ids, 2], dtype="<u4")
        assert got[i] == (start, want.tobytes())
        start += len(want)
    row = index.filter("seq = 3").head()
    (ids_,) = records.read_some(folder, row["file"], [3])
    assert zlib.crc32(ids_.tobytes()) == zlib.crc32(got[row["doc_id"]][1])
    arrays = read.select("doc_id", records.id_array(F.col("ids")).alias("a")).filter(F.col("doc_id") == row["doc_id"]).head()
    assert arrays["a"] == ids_.tolist()


def test_odd_input(spark, odd, empty):
    _, _, read = back(spark, odd)
    rows = read.collect()
    assert len(rows) == odd.count()
    assert sorted(len(r["ids"]) // 4 for r in rows if r["doc_id"] in (1, 2)) == [1, 1]
    ordered = sorted(rows, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered][:2] == [None, None]
    assert all(a["start"] + len(a["ids"]) // 4 == b["start"] for a, b in zip(ordered, ordered[1:]))
    assert back(spark, empty)[2].count() == 0


def test_a_worker_holds_a_bounded_part_of_its_texts(monkeypatch):
    monkeypatch.setattr(records, "AT_ONCE", 100)
    monkeypatch.setattr(records, "CACHED_BYTES", 500)
    encode, library = records.Encoder(PATH), Tokenizer.from_file(PATH)
    sizes, whole = [], encode._whole
    monkeypatch.setattr(encode, "_whole", lambda texts: sizes.append(sum(map(len, texts))) or whole(texts))
    texts = [" ".join(f"word{i * 7 + k}" for k in range(6)) for i in range(60)] + ["", "two  spaces"]
    got = list(encode.parts(texts))
    assert [ids.tolist() for ids in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert max(sizes) <= 200 and encode.held <= 500 + 2_000


def test_frequent_spans_outlive_a_full_cache(monkeypatch):
    monkeypatch.setattr(records, "CACHED", 40)
    library, encode, learned = Tokenizer.from_file(PATH), records.Encoder(PATH), []
    learn = encode._learn
    monkeypatch.setattr(encode, "_learn", lambda spans: (learned.extend(spans), learn(spans)))
    for i in range(30):
        texts = ["the end of the line", " ".join(["a", "\tb", "é中", *(f"w{i}x{j}" for j in range(9))])]
        for text, ids in zip(texts, encode(texts)):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert learned.count("the") == learned.count("\tb") == 1
    assert len(encode.known) + len(encode.older) <= 60


def test_a_span_is_looked_up_once_for_all_texts():
    class Counting(dict):
        asked = 0

        def get(self, *key):
            Counting.asked += 1
            return super().get(*key)

        def __getitem__(self, key):
            Counting.asked += 1
            return super().__getitem__(key)

    library, encode = Tokenizer.from_file(PATH), records.Encoder(PATH)
    encode.known = Counting()
    texts = ["once more the same é中 words, " + "the same words, " * 200 + f"and {i}" for i in range(50)] + ["a \tb", "\tb the", "the \tb", "", "the"]
    for text, ids in zip(texts, encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert Counting.asked <= 3 * 70


def test_texts_of_several_batches_are_encoded_together(monkeypatch, tmp_path):
    library, calls, call = Tokenizer.from_file(PATH), [], records.Encoder.__call__
    monkeypatch.setattr(records.Encoder, "__call__", lambda self, texts: (calls.append(len(texts)), call(self, texts))[1])
    texts = [None, "", *(f"text {i} of\tmany " * (i % 3) + "end" for i in range(1_300))]
    columns = [pa.array([i // 700 for i in range(len(texts))], pa.int32()), pa.array([None, *range(1, len(texts))], pa.int64()), pa.array(texts)]
    batches = pa.RecordBatch.from_arrays(columns, ["block", "doc_id", "text"])
    write = records._writer(str(tmp_path), PATH, 2)
    rows = [r for b in write(batches.slice(i, 10) for i in range(0, len(texts), 10)) for r in b.to_pylist()]
    assert sum(calls) == len(texts) and len(calls) <= 2
    assert [r["doc_id"] for r in rows] == [None, *range(1, len(texts))] and [r["block"] for r in rows] == columns[0].to_pylist()
    for block in (0, 1):
        name, of = f"shard-{block:06d}.records", range(700 * block, min(700 * block + 700, len(texts)))
        got = records.read_some(str(tmp_path), name, list(range(len(of))))
        assert [ids.tolist() for ids in got] == [[*library.encode(texts[i] or "", add_special_tokens=False).ids, 2] for i in of]
