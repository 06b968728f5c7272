"""Token-id shards with a minimal perfect hash index (operator 9).

Each shard holds a range of documents in ascending doc_id order and is four files in a shared folder, named by the attempt that wrote them (``NAME`` is the shard's number and a random part):

* ``ids-NAME.bin``   raw little-endian ids (uint16 where the vocabulary fits, else uint32), every document followed by the end id
* ``keys-NAME.bin``  int64 triples (doc_id, 1 if doc_id is null, ordinal among rows of one doc_id), in payload order
* ``mph-NAME.bin``   the minimal perfect hash: for each level a bit array and its ranks
* ``slot-NAME.bin``  per slot of the hash: offset (uint64, in ids), length (uint64), fingerprint (uint64)

``manifest.json``, written once by the driver when all tasks are done, names the shards that count, in order, with their sizes and the type of the ids; files of attempts that failed are deleted then. No file
is moved onto another, so the store needs nothing of a file system but whole new files.

The hash is a cascade of bit arrays: a key's bit at a level is set if no other remaining key falls there; the rest go on to the
next level. The rank of its bit is the key's slot. A stored fingerprint tells a foreign key from a stored one.

Defined cases: null text counts as empty (the end id alone); a null doc_id comes first; rows that share a doc_id follow each other by text, repeated rows each with ids of their own; an empty
table writes nothing and reads nothing; a text of any length is encoded whole, in stretches; columns besides doc_id and text aren't read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

GAMMA = 2.0
KEY = np.dtype([("doc_id", "<i8"), ("is_null", "<i8"), ("ordinal", "<i8")])
SLOT = np.dtype([("offset", "<u8"), ("length", "<u8"), ("fingerprint", "<u8")])
MANIFEST = "shard int, name string, dtype string, n_docs long, n_ids long"


def key_hash(keys: np.ndarray) -> np.ndarray:
    """64 bits of a key; distinct doc_ids never collide, as the mix is a bijection."""
    base = common.mix64(keys["doc_id"])
    extra = (keys["is_null"] + 2 * keys["ordinal"]).astype(np.uint64)
    return np.where(extra > 0, common.mix64(base + extra * np.uint64(0x9E3779B97F4A7C15)), base)


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit key hashes; ``slots(hashes)`` is constant time per key."""

    def __init__(self, sizes: list[int], words: np.ndarray, ranks: np.ndarray):
        self.sizes, self.words, self.ranks = sizes, words, ranks
        self.starts = np.concatenate([[0], np.cumsum([s // 64 for s in sizes])]).astype(np.int64)

    @staticmethod
    def _place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return (common.mix64(hashes + np.uint64((level * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        left, sizes, parts = hashes, [], []
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("keys must be distinct")
        while len(left):
            size = (int(GAMMA * len(left)) // 64 + 1) * 64
            at = cls._place(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[at]]
        words = np.concatenate(parts) if parts else np.zeros(0, "<u8")
        return cls(sizes, words, np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))]).astype("<i8"))

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level has it (a foreign key may still get a slot: compare fingerprints)."""
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for level, size in enumerate(self.sizes):
            at = self._place(hashes[open_], level, size)
            word, bit = self.starts[level] + at // 64, (at % 64).astype(np.uint64)
            have = (self.words[word] >> bit) & np.uint64(1) == 1
            w, b = word[have], bit[have]
            out[open_[have]] = self.ranks[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << b) - np.uint64(1))).astype(np.int64)
            open_ = open_[~have]
        return out

    def to_bytes(self) -> bytes:
        return np.array([len(self.sizes), *self.sizes], "<i8").tobytes() + self.words.tobytes() + self.ranks.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        sizes = np.frombuffer(raw, "<i8", n, 8).tolist()
        k, at = sum(sizes) // 64, 8 * (n + 1)
        return cls(sizes, np.frombuffer(raw, "<u8", k, at), np.frombuffer(raw, "<i8", k + 1, at + 8 * k))


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _put(files: fs.FileSystem, path: str, chunks: Iterator[bytes]) -> None:
    with files.open_output_stream(path, buffer_size=1 << 20) as out:
        for x in chunks:
            out.write(x)


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0, partitions: int | None = None) -> list:
    """Encode every text and write the shards; returns their manifest rows (shard, name, dtype, n_docs, n_ids), one per non-empty shard.

    Null text: empty. Null doc_id: comes first. Rows that share a doc_id follow each other by text. The manifest has a row per
    shard, so what the driver gets is bounded by the number of partitions.
    """
    path = tokenizer or tokens.default_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    # a doc_id with very many rows is cut by the beginnings of its texts, which order them as the texts do
    rows = rows.repartitionByRange(partitions or common.partitions_for(rows, 64), F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 32)).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encoder = TaskContext.get().partitionId(), tokens.encoder(path)
        files, top = _open(folder)
        files.create_dir(top, recursive=True)
        own = f"{shard:05d}-{uuid.uuid4().hex[:12]}"
        keys: list[np.ndarray] = []
        lengths: list[int] = []

        def payload() -> Iterator[bytes]:
            for batch in batches:
                for piece in common.slices(batch, "text", 4 << 20):
                    ids = piece.column(0)
                    k = np.zeros(len(ids), KEY)
                    k["doc_id"], k["is_null"] = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
                    keys.append(k)
                    flat, ends = encoder.encode(*reversed(common.utf8(piece.column(1))), end_id)
                    lengths.extend(np.diff(ends).tolist())
                    yield flat.tobytes()

        _put(files, f"{top}/ids-{own}.bin", payload())
        if not lengths:
            files.delete_file(f"{top}/ids-{own}.bin")
            return
        k, n = np.concatenate(keys), np.array(lengths, np.uint64)
        new = np.ones(len(k), bool)
        new[1:] = (k["doc_id"][1:] != k["doc_id"][:-1]) | (k["is_null"][1:] != k["is_null"][:-1])
        at = np.arange(len(k))
        k["ordinal"] = at - np.maximum.accumulate(np.where(new, at, 0))
        h = key_hash(k)
        index = PerfectHash.build(h)
        slot = np.zeros(len(k), SLOT)
        s = index.slots(h)
        slot["offset"][s], slot["length"][s], slot["fingerprint"][s] = np.cumsum(n) - n, n, common.mix64(~h)
        for name, raw in (("keys", k.tobytes()), ("mph", index.to_bytes()), ("slot", slot.tobytes())):
            _put(files, f"{top}/{name}-{own}.bin", iter([raw]))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "name": [own], "dtype": [encoder.dtype.str], "n_docs": pa.array([len(k)], pa.int64()), "n_ids": pa.array([int(n.sum())], pa.int64())})

    manifest = sorted(rows.mapInArrow(write, MANIFEST).collect(), key=lambda r: r.shard)
    if manifest:
        files, top = _open(folder)
        _put(files, f"{top}/manifest.json", iter([json.dumps([r.asDict() for r in manifest]).encode()]))
        kept = {f"{kind}-{r.name}.bin" for r in manifest for kind in ("ids", "keys", "mph", "slot")}
        for info in files.get_file_info(fs.FileSelector(top)):
            if info.base_name.endswith(".bin") and info.base_name not in kept:
                files.delete_file(info.path)
    return manifest


def manifest_of(folder: str) -> list:
    """The manifest rows of a store that was written before."""
    files, top = _open(folder)
    with files.open_input_stream(f"{top}/manifest.json") as f:
        return [Row(**r) for r in json.loads(f.read())]


class Shard:
    """Keyed access to one shard: ``find(keys)`` gives (found, offset, length); ``ids(offset, length)`` reads that document alone."""

    def __init__(self, folder: str, name: str, dtype: str):
        self.files, self.top = _open(folder)
        self.name, self.dtype = name, np.dtype(dtype)
        self.index = PerfectHash.from_bytes(self._raw(f"mph-{name}.bin"))
        self.slot = np.frombuffer(self._raw(f"slot-{name}.bin"), SLOT)
        self.payload = self.files.open_input_file(f"{self.top}/ids-{name}.bin")

    def _raw(self, name: str) -> bytes:
        with self.files.open_input_stream(f"{self.top}/{name}") as f:
            return f.read()

    def keys(self) -> np.ndarray:
        return np.frombuffer(self._raw(f"keys-{self.name}.bin"), KEY)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = key_hash(keys)
        at = self.index.slots(h)
        slot = self.slot[np.maximum(at, 0)] if len(self.slot) else np.zeros(len(keys), SLOT)
        return (at >= 0) & (slot["fingerprint"] == common.mix64(~h)), slot["offset"].astype(np.int64), slot["length"].astype(np.int64)

    def ids(self, offset: int, length: int) -> np.ndarray:
        size = self.dtype.itemsize
        return np.frombuffer(self.payload.read_at(length * size, offset * size), self.dtype)


def read_back(spark: SparkSession, folder: str, manifest: list) -> DataFrame:
    """Every document of the shards, found by its key: doc_id, start (ids before it), n_tokens, ids_crc32."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    before, rows = 0, []
    for r in manifest:
        rows.append((r.name, r.dtype, before))
        before += r.n_ids
    if not rows:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, dtype, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store = Shard(folder, name, dtype)
                every = store.keys()
                for i in range(0, len(every), 4096):
                    keys = every[i : i + 4096]
                    found, offset, length = store.find(keys)
                    if not found.all():
                        raise ValueError(f"shard {name}: a key of the shard isn't in its index")
                    crc = [zlib.crc32(store.ids(o, n).astype("<u4").tobytes()) for o, n in zip(offset.tolist(), length.tolist(), strict=True)]
                    ids = pa.array(keys["doc_id"], pa.int64(), mask=keys["is_null"] != 0)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(start + offset), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.createDataFrame(rows, "name string, dtype string, start long").repartition(len(rows)).mapInArrow(read, schema)


def token_store(spark: SparkSession, docs: DataFrame, folder: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` as shards (in the shared folder unless named) and read every document back through the index."""
    folder = folder or common.fresh_path(spark, "token-store")
    return read_back(spark, folder, write_shards(docs, folder, tokenizer))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
