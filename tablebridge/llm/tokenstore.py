"""Token-id files: concatenated ids with Elias-Fano coded document boundaries.

File (little-endian): 8 bytes magic, ten unsigned 64-bit header fields (format version, bytes an id, documents,
ids, null keys, first key, and the lengths in bytes of the ids, the boundary code and the key code, then the
universe of the keys), the ids, the two codes. A code of m non-decreasing values below u keeps l = floor(log2(u / m))
low bits of each value packed, the high parts in unary as a bit string of at most 3 m bits, and the position of every
256th one (64 bits) for select.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablebridge.operators.scan import running

from .textids import TextIds
from .common import fresh, materialise, text_slices

MAGIC = b"TBRIDGE1"
HEAD = struct.Struct("<8s10q")
EVERY = 256
#: Keys of one file lie within this; where they don't, another file begins, of which a range of keys needs five at most.
FAR = 1 << 62
READ_DOCS = 4096


class EliasFano:
    """Non-decreasing integers 0 <= v <= top in about 2 + log2(top / m) bits each, with constant-time access."""

    def __init__(self, m: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.m, self.low_bits, self.low, self.high, self.samples = m, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray, top: int) -> EliasFano:
        v = np.asarray(values, np.int64)
        m = len(v)
        if m and (v[0] < 0 or v[-1] > top or (np.diff(v) < 0).any()):
            raise ValueError("values must not decrease and must lie in 0..top")
        low_bits = max(0, ((top + 1) // max(m, 1)).bit_length() - 1)
        at = (v >> low_bits) + np.arange(m)
        bits = np.zeros(int(at[-1]) + 1 if m else 0, np.uint8)
        bits[at] = 1
        low = ((v[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8).ravel()
        return cls(m, low_bits, np.packbits(low, bitorder="little"), np.packbits(bits, bitorder="little"), at[::EVERY].astype("<u8"))

    def _low(self, i: int) -> int:
        a = i * self.low_bits
        word = int.from_bytes(self.low[a >> 3 : (a + self.low_bits + 7) >> 3].tobytes(), "little")
        return word >> (a & 7) & (1 << self.low_bits) - 1

    def select(self, i: int) -> int:
        """Position of the i-th one of the high bits: from its sample on by counts of whole bytes."""
        at = int(self.samples[i // EVERY])
        left = i % EVERY
        byte = at >> 3
        rest = int(self.high[byte]) >> (at & 7) << (at & 7)
        while left >= (n := rest.bit_count()):
            left -= n
            byte += 1
            rest = int(self.high[byte])
        for _ in range(left):
            rest &= rest - 1
        return 8 * byte + (rest & -rest).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.m:
            raise IndexError(i)
        return (self.select(i) - i) << self.low_bits | self._low(i)

    def __len__(self) -> int:
        return self.m

    def stretch(self, a: int, b: int) -> np.ndarray:
        """Values a to b - 1: select from the samples around them, so that only their part of the code is unpacked."""
        if a >= b:
            return np.empty(0, np.int64)
        start = int(self.samples[a // EVERY]) >> 3
        stop = int(self.samples[-(-b // EVERY)]) // 8 + 1 if -(-b // EVERY) < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[start:stop], bitorder="little"))
        skipped = int(self.high[start] & ((1 << (int(self.samples[a // EVERY]) & 7)) - 1)).bit_count() + a % EVERY
        high = ones[skipped : skipped + b - a] + 8 * start - np.arange(a, b)
        p = a * self.low_bits
        bits = np.unpackbits(self.low[p >> 3 : (b * self.low_bits + 7) >> 3], bitorder="little")[p & 7 :]
        low = bits[: (b - a) * self.low_bits].reshape(b - a, self.low_bits).astype(np.int64)
        return high << self.low_bits | (low << np.arange(self.low_bits)).sum(1)

    def to_bytes(self) -> bytes:
        return struct.pack("<5q", self.m, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        m, low_bits, a, b, c = struct.unpack_from("<5q", raw)
        at = 40
        return cls(m, low_bits, np.frombuffer(raw, np.uint8, a, at), np.frombuffer(raw, np.uint8, b, at + a), np.frombuffer(raw, "<u8", c, at + a + b))


def pack_shard(keys: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One file's bytes; keys ascend, nulls first."""
    nulls = sum(k is None for k in keys)
    known = np.array([k for k in keys if k is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    spread = int(known[-1]) - first if len(known) else 0
    if spread >= FAR:
        raise ValueError("keys of one file are too far apart")
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    ends = EliasFano.build(np.cumsum(np.array([0, *lengths], np.int64)), int(sum(lengths))).to_bytes()
    codes = EliasFano.build(known - first, spread).to_bytes()
    body = ids.astype(f"<u{width}").tobytes()
    return HEAD.pack(MAGIC, 2, width, len(keys), len(ids), nulls, first, len(body), len(ends), len(codes), spread) + body + ends + codes


def near_keys(keys: list[int | None], first: int | None) -> Iterator[tuple[int, int, int | None]]:
    """Stretches (from, to, first key) of ascending keys, nulls first, that lie within FAR of their first key; the first goes on from ``first``."""
    start = 0
    for i, k in enumerate(keys):
        if k is None:
            continue
        if first is not None and k - first >= FAR:
            yield start, i, first
            start, first = i, k
        elif first is None:
            first = k
    yield start, len(keys), first


def published(store: fs.FileSystem, temp: str, path: str) -> None:
    """Give a whole file its name; where moves don't replace (hdfs), the one that an earlier run of the task left, with the same bytes, goes first."""
    if store.get_file_info(path).type != fs.FileType.NotFound:
        store.delete_file(path)
    store.move(temp, path)


class Shard:
    """A file's content: ``shard[i]`` gives the key and ids of its i-th document by one select."""

    def __init__(self, raw: bytes) -> None:
        magic, version, width, self.n, self.size, self.nulls, self.first, a, b, c, _ = HEAD.unpack_from(raw)
        if magic != MAGIC or version != 2 or len(raw) != HEAD.size + a + b + c:
            raise ValueError("not a whole token-id file")
        at = HEAD.size
        self.ids = np.frombuffer(raw, f"<u{width}", a // width, at)
        self.ends = EliasFano.from_bytes(raw[at + a : at + a + b])
        self.keys = EliasFano.from_bytes(raw[at + a + b :])

    def key(self, i: int) -> int | None:
        return None if i < self.nulls else self.first + self.keys[i - self.nulls]

    def __getitem__(self, i: int) -> tuple[int | None, np.ndarray]:
        return self.key(i), self.ids[self.ends[i] : self.ends[i + 1]]


def qualified(spark: SparkSession, path: str) -> str:
    """A folder as a URI: without a scheme it lies where Spark would put it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file:///") else uri


@lru_cache(2)
def library_encoder(path: str) -> TextIds:
    """Ids of the tokenizers library for whole texts; vocabularies that keep white space get whole texts, not words."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    spec = json.loads(t.to_str())
    if not (spec["model"].get("end_of_word_suffix") == "</w>" and "Lowercase" in repr(t.normalizer) and "invert" in json.dumps(spec["pre_tokenizer"])):
        raise ValueError("not a vocabulary of lower-cased words with word ends")
    ends = np.zeros(t.get_vocab_size() + 1, bool)
    for token, i in t.get_vocab(with_added_tokens=False).items():
        ends[i] = token.endswith("</w>")

    def odd(texts: list[str]) -> tuple[np.ndarray, list[int]]:
        ids = [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in ids for i in x], np.uint32), [len(x) for x in ids]

    def plain(words: list[str]) -> tuple[np.ndarray, list[int]]:
        """Many words at a time; each has one word-end token, which tells them apart again."""
        ids = np.array(t.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        at = np.flatnonzero(ends[ids]) + 1
        return (ids, np.diff(at, prepend=0).tolist()) if len(at) == len(words) and at[-1] == len(ids) else odd(words)

    return TextIds(plain, odd)


def write_tokens(docs: DataFrame, path: str, out: str, end_id: int = 1, shard_ids: int = 8_000_000, partitions: int | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write ids of every whole text, each with ``end_id``, to files under ``out`` in ascending key order.

    Range-partitioned by key (then by a hash of the text, so that a repeated key spreads), sorted within partitions;
    each task writes its files under a temporary name and moves them, and a task that runs again writes the same
    bytes to the same names. A file ends at ``shard_ids`` ids, or where keys lie too far apart to be coded together (FAR), so keys may be any 64-bit numbers. Returns the durable manifest ``part, seq, file, n_docs, n_ids, base`` where base counts the ids
    of all files before. Null texts are empty documents of the end id alone; null keys come first; an empty table gives an
    empty manifest. ``out`` is a URI or path that all machines see (local, hdfs, s3, gs), one without a scheme is on Spark's default file system.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = qualified(spark, out)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.repartitionByRange(n, "k", F.xxhash64("t")).sortWithinPartitions("k", F.xxhash64("t"), "t")
    schema = "part int, seq int, file string, n_docs long, n_ids long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(out)
        keys, lengths, pieces, held, seq, first = [], [], [], 0, 0, None

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(pieces)
            name = f"ids-{part:05d}-{seq:05d}.bin"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(tmp := f"{root}/.{name}.{uuid.uuid4().hex}") as f:
                f.write(pack_shard(keys, lengths, ids))
            published(store, tmp, f"{root}/{name}")
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": [name], "n_docs": [len(keys)], "n_ids": [len(ids)]})

        for b in batches:
            for some in text_slices(b, "t"):
                ids, ends = library_encoder(path).encode(some.column("t"), end_id)
                ends, known = np.asarray(ends), some.column("k").to_pylist()
                for lo, hi, begin in near_keys(known, first):
                    if keys and (held >= shard_ids or begin != first and first is not None):
                        yield flush()
                        keys, lengths, pieces, held, seq = [], [], [], 0, seq + 1
                    first = begin
                    keys += known[lo:hi]
                    lengths += np.diff(ends[lo : hi + 1]).tolist()
                    pieces.append(ids[ends[lo] : ends[hi]])
                    held += int(ends[hi] - ends[lo])
                if held >= shard_ids:
                    yield flush()
                    keys, lengths, pieces, held, seq, first = [], [], [], 0, seq + 1, None
        if keys:
            yield flush()

    files = materialise(rows.mapInArrow(run, schema), "idfiles")
    summed = running(files, [], ["part", "seq"], {"upto": ("sum", F.col("n_ids"))}, lambda df: materialise(df, "idfiles"))
    return summed.withColumn("base", F.col("upto") - F.col("n_ids")).drop("upto")


def read_tokens(manifest: DataFrame, out: str, ids: bool = False) -> DataFrame:
    """Read the files of a manifest: ``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) of each document, one task a few files.

    Keys and offsets come by select, READ_DOCS documents at a time, without a table of a file's offsets. Repeated rows and keys are
    documents of their own, an empty document (null or empty text) is its end id, a long text may fill a file; an empty manifest
    gives an empty table. Only the manifest's columns ``file`` and ``base`` are used.
    """
    spark = manifest.sparkSession
    out = qualified(spark, out)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(out)
        for b in batches:
            for name, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as f:
                    s = Shard(f.read())
                for lo in range(0, s.n, READ_DOCS):
                    hi = min(s.n, lo + READ_DOCS)
                    ends = s.ends.stretch(lo, hi + 1)
                    nulls = min(hi, max(lo, s.nulls)) - lo
                    keys = [None] * nulls + (s.keys.stretch(lo + nulls - s.nulls, hi - s.nulls) + s.first).tolist()
                    crc = [zlib.crc32(s.ids[x:y].astype("<u4").tobytes()) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                    cols = {"doc_id": pa.array(keys, pa.int64()), "start": pa.array(ends[:-1] + base), "n_tokens": pa.array(np.diff(ends)), "ids_crc32": pa.array(crc, pa.int64())}
                    if ids:
                        cols["ids"] = pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(s.ids[ends[0] : ends[-1]].astype(np.int32)))
                    yield pa.RecordBatch.from_pydict(cols)

    return manifest.select("file", "base").repartition(n, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def round_trip(docs: DataFrame, path: str, **kw: int) -> DataFrame:
    """Write all texts to a fresh folder in the shared one and read them back."""
    out = fresh(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, path, out, **kw), out)
