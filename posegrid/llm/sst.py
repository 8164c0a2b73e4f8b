"""Sorted-string-table shards of token ids, keyed by document id.

File: zstd-compressed data blocks, block index, Bloom filter, footer. A block holds entries in key order, each as
varints (bytes shared with the key before, other key bytes, value bytes), key suffix and value. The sparse index
has the first key and the place of each block. A key is the id as 8 big-endian bytes with the sign bit flipped, so
bytes sort as integers; a null id has the empty key and sorts first. Values are little-endian unsigned ids of 2 or 4
bytes, as the vocabulary's size needs.

Rows may repeat an id: they lie side by side, in order of their text. A null text counts as empty and holds the end
id alone. Extra columns are not read. An empty table gives no file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed, new_path, settle, text_slices
from .deal import parts_of, range_bounds, range_of
from .tokens import encoder

MAGIC = b"PGSSTBL1"
_FOOTER = struct.Struct("<QQQQQQI8s")  # index at, bytes; filter at, bytes; entries, tokens; width; magic
_PLACE = struct.Struct("<QI")
BLOCK_BYTES, SHARD_BYTES, FILTER_BITS, FILTER_HASHES = 1 << 16, 64 << 20, 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else ((doc_id + (1 << 63)) & (1 << 64) - 1).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _spots(keys: np.ndarray, bits: int) -> np.ndarray:
    """FILTER_HASHES places of each key by double hashing."""
    a, b = mixed(keys.copy()), mixed(keys + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return (a[:, None] + np.arange(FILTER_HASHES, dtype=np.uint64) * b[:, None]) % np.uint64(bits)


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class ShardWriter:
    """Writes one shard; ``add`` takes keys in ascending order."""

    def __init__(self, stream, width: int):
        self.stream, self.width, self.pack = stream, width, zstandard.ZstdCompressor(level=1)
        self.block, self.before, self.first = bytearray(), b"", b""
        self.index, self.keys, self.at, self.tokens = [], [], 0, 0

    def add(self, doc_id: int | None, value: bytes) -> None:
        key = key_of(doc_id)
        if not self.block:
            self.before, self.first = b"", key
        shared = next((i for i, (x, y) in enumerate(zip(key, self.before)) if x != y), min(len(key), len(self.before)))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.before = key
        self.keys.append(int.from_bytes(key, "big"))
        self.tokens += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _put(self, data: bytes) -> tuple[int, int]:
        self.stream.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def _end_block(self) -> None:
        if self.block:
            self.index.append((self.first, *self._put(self.pack.compress(bytes(self.block)))))
            self.block = bytearray()

    def finish(self) -> None:
        self._end_block()
        index = self._put(b"".join(_varint(len(k)) + k + _PLACE.pack(at, n) for k, at, n in self.index))
        bits = np.zeros(max(64, FILTER_BITS * len(self.keys)) + 7 >> 3, np.uint8)
        spots = _spots(np.asarray(self.keys, np.uint64), 8 * len(bits)).ravel()
        np.bitwise_or.at(bits, (spots >> np.uint64(3)).astype(np.int64), np.uint8(1) << (spots & np.uint64(7)).astype(np.uint8))
        bloom = self._put(bits.tobytes())
        self._put(_FOOTER.pack(*index, *bloom, len(self.keys), self.tokens, self.width, MAGIC))
        self.stream.close()


class ShardReader:
    """Reads one shard through its footer: a scan in key order, or a lookup of one key."""

    def __init__(self, uri: str):
        system, path = _file_system(uri)
        self.file = system.open_input_file(path)
        end = self.file.size()
        head = _FOOTER.unpack(self._at(end - _FOOTER.size, _FOOTER.size))
        if head[-1] != MAGIC:
            raise ValueError(f"{uri} is no shard")
        index_at, index_n, self.bloom_at, self.bloom_n, self.entries, self.tokens, self.width, _ = head
        index, at, self.first, self.places = self._at(index_at, index_n), 0, [], []
        while at < len(index):
            n, at = _number(index, at)
            self.first.append(index[at : at + n])
            self.places.append(_PLACE.unpack_from(index, at + n))
            at += n + _PLACE.size
        self.unpack = zstandard.ZstdDecompressor()

    def _at(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        data, at, key = self.unpack.decompress(self._at(*self.places[i])), 0, b""
        while at < len(data):
            shared, at = _number(data, at)
            own, at = _number(data, at)
            n, at = _number(data, at)
            key = key[:shared] + data[at : at + own]
            yield key, data[at + own : at + own + n]
            at += own + n

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for i in range(len(self.places)):
            for key, value in self._block(i):
                yield id_of(key), value

    def may_hold(self, doc_id: int | None) -> bool:
        bits = np.frombuffer(self._at(self.bloom_at, self.bloom_n), np.uint8)
        spots = _spots(np.asarray([int.from_bytes(key_of(doc_id), "big")], np.uint64), 8 * len(bits))[0]
        return bool(np.all(bits[(spots >> np.uint64(3)).astype(np.int64)] >> (spots & np.uint64(7)).astype(np.uint8) & 1))

    def lookup(self, doc_id: int | None) -> list[bytes]:
        """Values of a key: none, one, or several where rows repeat it."""
        if not self.entries or not self.may_hold(doc_id):
            return []
        key = key_of(doc_id)
        i, out = max(0, bisect_right(self.first, key) - 1), []
        while i > 0 and self.first[i] == key:
            i -= 1
        for j in range(i, len(self.places)):
            if self.first[j] > key:
                break
            out += [v for k, v in self._block(j) if k == key]
        return out


def write_token_shards(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode every whole text and write shards in ascending id order; returns their manifest.

    Ranges of the id are dealt to partitions, each of which encodes and writes its own shards, so nothing but the
    texts is shuffled, once. Shards have names of their own for each attempt; only those in the manifest count, so a
    task that runs twice does no harm. Manifest: range, seq, uri, entries, tokens, start (tokens of all shards before).
    """
    spark = docs.sparkSession
    folder = new_path(spark, "sst")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = parts_of(docs)
    bounds = range_bounds(rows, "doc_id", parts)
    dealt = rows.withColumn("range", range_of(F.col("doc_id"), bounds)).repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))

    def write(batches):
        coder = encoder(tokenizer)
        end = np.asarray([end_id], coder.type).tobytes()
        system, root = _file_system(folder)
        system.create_dir(root, recursive=True)
        shard, at, seq, done = None, 0, 0, []

        def close():
            shard.finish()
            done.append((at, seq, uri, len(shard.keys), shard.tokens))

        for part in text_slices(batches, most=1 << 22):
            ids, cut = coder.encode(part.column(1))
            values = (ids[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:]))
            for doc_id, value, at in zip(part.column(0).to_pylist(), values, part.column(2).to_pylist()):
                if shard is None:
                    name = f"{at:06d}-{seq:04d}-{uuid.uuid4().hex}.sst"
                    uri, shard = f"{folder}/{name}", ShardWriter(system.open_output_stream(f"{root}/{name}"), coder.width)
                shard.add(doc_id, value + end)
                if shard.at >= shard_bytes:
                    close()
                    shard, seq = None, seq + 1
        if shard is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done) if done else [[]] * 5, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["range", "seq", "uri", "entries", "tokens"])

    manifest = settle(dealt.mapInArrow(write, "range int, seq int, uri string, entries long, tokens long"), "sst-manifest")
    before = Window.orderBy("range", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard of 64 MB
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")))


def read_token_shards(manifest: DataFrame) -> DataFrame:
    """Digest of each entry as read from the files: doc_id, start, n_tokens, ids_crc32; a block at a time is held."""

    def read(batches):
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard, rows = ShardReader(uri), []
                for doc_id, value in shard:
                    ids = np.frombuffer(value, f"<u{shard.width}")
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 8192:
                        yield _digests(rows)
                        rows = []
                yield _digests(rows)

    return manifest.select("uri", "start").repartition(max(1, parts_of(manifest))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
