"""Token ids as length-delimited binary records with a separate offset index.

A shard file holds one frame per sequence, all numbers little-endian:

    uint64 length | uint32 masked checksum of those 8 bytes | payload | uint32 masked checksum of the payload

The payload is a byte with the width of an id, 2 or 4, and the ids as unsigned numbers of that width, 2 wherever all
ids of the sequence allow it.  A checksum is the CRC-32 of the bytes, rotated right by 15 bits
and raised by a constant, so that a checksum of data that holds checksums stays sound.  The index beside each shard
has two int64 per frame, its offset and its doc_id (the least number for null), so any record can be read on its own
and in any order.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounds_of, checkpointed, fresh_folder, range_of, slices, small_batches

MASK = 0xA282EAD8
NO_ID = -(1 << 63)
CACHED = 1_600_000  # spans of text that a worker remembers the ids of, half of them since the last change
CACHED_BYTES = 64 << 20  # and their characters and ids take no more
AT_ONCE = 4 << 20  # characters of texts that are encoded together
HEAD = struct.Struct("<QI")
INDEX = "block int, seq long, doc_id long, start_in_block long, n_tokens long, file string, position long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def read_frame(file) -> bytes | None:
    """The next payload, None at the end; raises on a damaged frame."""
    head = file.read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size:
        raise ValueError("a record is cut off")
    length, crc = HEAD.unpack(head)
    if masked(head[:8]) != crc:
        raise ValueError("a record's length is damaged")
    payload = file.read(length)
    end = file.read(4)
    if len(payload) < length or len(end) < 4 or masked(payload) != struct.unpack("<I", end)[0]:
        raise ValueError("a record is damaged")
    return payload


def packed(ids: np.ndarray) -> bytes:
    """The payload of a sequence."""
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def unpacked(payload: bytes) -> np.ndarray:
    """The ids, as unsigned 32-bit numbers."""
    return np.frombuffer(payload, dtype=f"<u{payload[0]}", offset=1).astype("<u4")


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Encoder:
    """Ids of whole texts, equal to those of the library, which sees each distinct span between spaces once.

    A byte-level pre-tokenizer starts a new piece at any space that another character than white space follows, so the
    ids of a text are those of its spans, each with the space before it.  Texts with other spaces go to the library
    whole, and so do all texts if the tokenizer is of another kind.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        kind = self.tokenizer.pre_tokenizer
        self.by_span = isinstance(kind, ByteLevel) and not kind.add_prefix_space and self.tokenizer.normalizer is None
        size = self.tokenizer.get_vocab_size()
        # A token's string has one character per byte, an added token's is the text itself.
        self.lengths = np.zeros(size, dtype=np.int64)
        added = self.tokenizer.get_added_tokens_decoder()
        for token, i in self.tokenizer.get_vocab().items():
            self.lengths[i] = len(added[i].content.encode()) if i in added else len(token)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # known before the last change; what is met again moves back
        self.held = 0  # bytes of what is known
        self.blank: set[str] = set()  # spans known to begin with white space
        if any(t.lstrip or t.rstrip for t in added.values()):
            self.by_span = False

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, spans: list[str]) -> None:
        for at in range(0, len(spans), 20_000):
            some = spans[at:at + 20_000]
            text = " " + " ".join(some)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.cumsum(self.lengths[ids])
            sizes = list(map(len, some if text.isascii() else map(str.encode, some)))
            cuts = (np.searchsorted(ends, np.cumsum(np.array(sizes) + 1)) + 1).tolist()
            data, first = ids.tobytes(), 0
            for span, last in zip(some, cuts):
                self.known[span] = data[4 * first:4 * last]
                first = last
            self.held += len(text) + 4 * len(ids)
            if re.search(r" \s", text):
                self.blank.update(s for s in some if s[:1].isspace())

    def _recall(self, spans: list[str]) -> list[str]:
        """Makes the spans known that were so before; the rest."""
        older, rest = self.older, []
        for s in spans:
            ids = older.pop(s, None)
            if ids is None:
                rest.append(s)
            else:
                self.known[s] = ids
                self.held += len(s) + 1 + len(ids)
        return rest

    def _ids_of(self, spans: list[str]) -> list[bytes]:
        """The ids of distinct spans, each with the space before it."""
        if len(self.known) > CACHED // 2 or self.held > CACHED_BYTES // 2:
            self.older, self.known, self.held = self.known, {}, 0
            self.blank &= self.older.keys()
        found = list(map(self.known.get, spans))
        unknown = [k for k, ids in enumerate(found) if ids is None]
        if unknown and (fresh := self._recall([spans[k] for k in unknown])):
            self._learn(fresh)
        for k in unknown:
            found[k] = self.known[spans[k]]
        return found

    def parts(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text in turn; about AT_ONCE characters are in work."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text) + 16  # many empty texts are work, too
            if size >= AT_ONCE:
                yield from self(held)
                held, size = [], 0
        yield from self(held)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_span:
            return self._whole(texts)
        plain = [" " in t and "  " not in t and t[0] != " " and t[-1] != " " for t in texts]
        rest = [i for i, p in enumerate(plain) if not p]
        out: list = [None] * len(texts)
        if len(rest) < len(texts):
            rest += self._by_span([i for i, p in enumerate(plain) if p], texts, out)
        for i, ids in zip(rest, self._whole([texts[i] for i in rest]) if rest else []):
            out[i] = ids
        return out

    def _by_span(self, which: list[int], texts: list[str], out: list) -> list[int]:
        """Puts the ids of these texts into out; those that have to go to the library whole."""
        heads, _, tails = zip(*(texts[i].partition(" ") for i in which))
        split = pc.split_pattern(pa.array(tails, pa.large_string()), " ")
        coded = split.values.dictionary_encode()
        spans = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        # Each span is looked up once, however often the texts have it; Arrow lays out the ids of all.
        ids = pa.array(self._ids_of(spans), pa.large_binary()).take(coded.indices)
        _, ends, data = ids.buffers()
        cuts = np.frombuffer(ends, dtype="<i8")[split.offsets.to_numpy()].tolist()
        for i, head, first, last in zip(which, self._whole(list(heads)), cuts, cuts[1:]):
            out[i] = np.concatenate([head, np.frombuffer(data, dtype="<u4", count=(last - first) // 4, offset=first)])
        if self.blank.isdisjoint(spans):
            return []
        blank = np.array([s in self.blank for s in spans])[coded.indices.to_numpy()]
        return [which[k] for k in np.flatnonzero(np.logical_or.reduceat(blank, split.offsets.to_numpy()[:-1]))]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process, on the one core of its task: threads of the library would each keep memory of their own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _writer(folder: str, tokenizer: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        fs, root = _filesystem(folder)
        current, file, state = None, None, {}

        def close():
            if file is not None:
                file.close()
                with fs.open_output_stream(state["tmp"] + ".index") as index:
                    index.write(np.array(state["offsets"], dtype="<i8").tobytes())
                # Written under a name of this attempt, then renamed: a repeated task puts the same bytes there.
                fs.move(state["tmp"] + ".index", state["path"] + ".index")
                fs.move(state["tmp"], state["path"])

        # Texts meet in the encoder across batches; their keys wait for them.
        keys, texts = itertools.tee(row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("block", "doc_id", "text"))))
        rows = []
        for (block, doc, _), ids in zip(keys, encode.parts(t or "" for _, _, t in texts)):
            if block != current:
                close()
                current, name = block, f"shard-{block:06d}.records"
                state = {"path": f"{root}/{name}", "tmp": f"{root}/.{name}.{uuid.uuid4().hex}", "name": name, "at": 0, "seq": 0, "start": 0, "offsets": []}
                file = fs.open_output_stream(state["tmp"])
            record = frame(packed(np.append(ids, np.uint32(end_id))))
            file.write(record)
            rows.append((block, state["seq"], doc, state["start"], len(ids) + 1, state["name"], state["at"]))
            state["offsets"].append((state["at"], NO_ID if doc is None else doc))
            state["at"] += len(record)
            state["seq"] += 1
            state["start"] += len(ids) + 1
            if len(rows) == 512:
                yield _rows(rows)
                rows = []
        close()
        yield _rows(rows)

    return write


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    names = ["block", "seq", "doc_id", "start_in_block", "n_tokens", "file", "position"]
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def write_records(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, blocks: int | None = None) -> tuple[str, DataFrame]:
    """Encodes every text and writes the shard files; gives their folder and the index as a table.

    Shard files follow each other in ascending doc_id (null first, equal ids by the text's hash), and so do the
    records in them; the index has doc_id, block, seq (the record's place in its shard), start_in_block, n_tokens, file
    and position.  A null text is empty; an empty text gives the end id alone.  Equal rows give a record each.  An empty
    table gives no files.  Only doc_id and text are used.
    """
    spark = docs.sparkSession
    folder = folder or fresh_folder(spark, "records")
    fs, root = _filesystem(folder)
    fs.create_dir(root)
    blocks = blocks or 3 * slices(spark)
    bounds = bounds_of(docs.filter("doc_id IS NOT NULL"), "doc_id", blocks)
    block = F.coalesce(range_of(F.col("doc_id"), bounds), F.lit(0)).cast("int")
    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("block", block)
    small_batches(spark)
    parts = dealt.repartitionById(len(bounds) + 1, "block").sortWithinPartitions("block", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    index = checkpointed(parts.mapInArrow(_writer(folder, tokenizer, end_id), INDEX))
    return folder, index


def shards(index: DataFrame) -> DataFrame:
    """(block, file, before): each shard file and the ids in all files before it; one row per file, few."""
    totals = index.groupBy("block", "file").agg(F.sum("n_tokens").alias("n")).collect()
    rows, total = [], 0
    for row in sorted(totals):
        rows.append((row["block"], row["file"], total))
        total += row["n"]
    return index.sparkSession.createDataFrame(rows, "block int, file string, before long")


def _offsets(fs, path: str) -> np.ndarray:
    """The index of a shard file: a row of offset and doc_id for each record."""
    with fs.open_input_file(path + ".index") as f:
        return np.frombuffer(f.read(), dtype="<i8").reshape(-1, 2)


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        for batch in batches:
            for block, name, start in zip(*(batch.column(c).to_pylist() for c in ("block", "file", "before"))):
                ids = [None if i == NO_ID else i for i in _offsets(fs, f"{root}/{name}")[:, 1].tolist()]
                with fs.open_input_stream(f"{root}/{name}", buffer_size=1 << 20) as file:
                    frames = iter(lambda: read_frame(file), None)
                    seq = 0
                    while some := list(itertools.islice(frames, 256)):
                        some = [unpacked(p).tobytes() for p in some]
                        starts = start + np.cumsum([0, *(len(p) // 4 for p in some)])
                        columns = [[block] * len(some), range(seq, seq + len(some)), ids[seq:seq + len(some)], starts[:-1].tolist(), some]
                        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["block", "seq", "doc_id", "start", "ids"])
                        seq, start = seq + len(some), int(starts[-1])
                    if seq != len(ids):
                        raise ValueError(f"{name} has {seq} records, its index {len(ids)}")

    return read


def read_records(folder: str, files: DataFrame) -> DataFrame:
    """(block, seq, doc_id, start, ids) of all records of the given shards(), every checksum tested; ids are unsigned
    little-endian 32-bit numbers, start is the number of ids before the record, over all files.  A task reads whole shard files, record by record."""
    dealt = files.repartition(slices(files.sparkSession), "block")
    return dealt.mapInArrow(_reader(folder), "block int, seq long, doc_id long, start long, ids binary")


def read_some(folder: str, file: str, wanted: list[int]) -> list[np.ndarray]:
    """Ids of the given records of a shard file, in the order asked for: seeks by its offset index."""
    fs, root = _filesystem(folder)
    offsets = _offsets(fs, f"{root}/{file}")[:, 0]
    with fs.open_input_file(f"{root}/{file}") as f:
        out = []
        for i in wanted:
            f.seek(int(offsets[i]))
            out.append(unpacked(read_frame(f)))
        return out


def id_array(ids: Column) -> Column:
    """The ids of a record as an array, for readers that stay in Spark."""
    text = F.hex(ids)
    at = F.sequence(F.lit(1), F.length(text) - 7, F.lit(8))
    byte = lambda i, k: F.substring(text, i + 2 * k, F.lit(2))
    return F.transform(at, lambda i: F.conv(F.concat(*[byte(i, k) for k in (3, 2, 1, 0)]), 16, 10).cast("long"))
