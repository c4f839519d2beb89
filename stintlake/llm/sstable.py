"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their identifier. Keys are prefix-compressed within blocks, with a restart
point every few entries; blocks are compressed one by one. After the blocks come a sparse index (the last key and the
place of each block), a Bloom filter of all keys and a footer of fixed size. A lookup asks the filter, finds the block by
binary search in the index, and the entry by binary search over the block's restart points. A lookup in the table first
finds the shards by binary search in their first identifiers.

    shard  := block* index bloom footer
    block  := zlib(entry* restart* n_restarts)       entry := shared, rest, size (varints) key-rest value
    footer := index offset, index size, bloom offset, bloom size, documents, tokens, id width, magic

Writing deals rows by ranges of (doc_id, hash of the text), so a repeated id can span shards and no shard grows with it.
A task writes its shard under a fresh name and reports it; only reported shards belong to the table, so a task that runs
twice does no harm.

An id takes two bytes in a file, or four if the vocabulary is larger than two bytes can number; a writer refuses a width
that is too small for the vocabulary.

Defined results: a null text counts as empty (its end id alone); rows with a null id come first; rows with one id are
ordered by the hash of their text and all kept; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stintlake.llm.common import released, table
from stintlake.llm.word_bpe import word_bpe
from stintlake.session import new_path, written

FOOTER = struct.Struct("<7Q8s")
MAGIC = b"IDSHARD1"
BLOCK_BYTES, RESTART, BLOOM_BITS, BLOOM_HASHES, KEY_BYTES = 1 << 16, 16, 10, 7, 9


def key_of(doc_id: int | None) -> bytes:
    """Nine bytes in the order of the ids, null first."""
    return b"\0" * 9 if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def varint(n: int) -> bytes:
    if n < 128:
        return SMALL[n]
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


SMALL = [bytes([n]) for n in range(128)]


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (data[at] & 127) << shift
        at += 1
        if data[at - 1] < 128:
            return n, at
        shift += 7


def bloom_bits(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Writes one shard to a binary stream; keys must come in order. Keeps one block, the index and 9 bytes a key."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.index, self.keys, self.tokens = [], [], 0
        self._fresh()

    def _fresh(self) -> None:
        self.block, self.restarts, self.entries, self.last = bytearray(), [], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        """One document; value: its ids as little-endian integers of the shard's width."""
        block = self.block
        if self.entries % RESTART == 0:
            self.restarts.append(len(block))
            shared = 0
        else:  # the bytes above the highest bit in which both keys differ
            shared = KEY_BYTES - ((int.from_bytes(self.last, "big") ^ int.from_bytes(key, "big")).bit_length() + 7) // 8
        block += varint(shared)
        block += varint(KEY_BYTES - shared)
        block += varint(len(value))
        block += key[shared:]
        block += value
        self.entries, self.last = self.entries + 1, key
        self.keys.append(key)
        self.tokens += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            data = zlib.compress(bytes(self.block) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts)), 1)
            self.out.write(data)
            self.index.append((self.last, self.at, len(data), self.entries))
            self.at += len(data)
            self._fresh()

    def close(self) -> None:
        self._flush()
        index = b"".join(struct.pack("<9sQQQ", *x) for x in self.index)
        bits = max(64, -(-len(self.keys) * BLOOM_BITS // 8) * 8)
        bloom = np.zeros(bits, dtype=bool)
        for key in self.keys:
            bloom[bloom_bits(key, bits)] = True
        bloom = np.packbits(bloom).tobytes()
        self.out.write(index + bloom + FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), len(self.keys), self.tokens, self.width, MAGIC))
        self.out.close()


class Shard:
    """Reads a shard; ``source`` is a seekable binary file."""

    def __init__(self, source):
        self.source = source
        source.seek(source.size() - FOOTER.size)
        self.index_at, index_size, bloom_at, bloom_size, self.documents, self.tokens, self.width, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        source.seek(self.index_at)
        self.index = list(struct.iter_unpack("<9sQQQ", source.read(index_size)))
        self.last_keys = [x[0] for x in self.index]
        source.seek(bloom_at)
        self.bloom = source.read(bloom_size)

    def _block(self, n: int) -> tuple[bytes, tuple[int, ...]]:
        _, at, size, _ = self.index[n]
        self.source.seek(at)
        data = zlib.decompress(self.source.read(size))
        (count,) = struct.unpack_from("<I", data, len(data) - 4)
        end = len(data) - 4 * (count + 1)
        return data[:end], struct.unpack_from(f"<{count}I", data, end)

    def _entries(self, data: bytes, at: int) -> Iterator[tuple[bytes, np.ndarray]]:
        key = b""
        while at < len(data):
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, np.frombuffer(data, f"<u{self.width}", size // self.width, at)
            at += size

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for n in range(len(self.index)):
            for key, ids in self._entries(self._block(n)[0], 0):
                yield id_of(key), ids

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[b >> 3] >> (7 - (b & 7)) & 1 for b in bloom_bits(key, 8 * len(self.bloom)))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this identifier."""
        key, found = key_of(doc_id), []
        if not self.may_hold(key):
            return found
        for n in range(bisect_left(self.last_keys, key), len(self.index)):
            data, restarts = self._block(n)
            first = bisect_left(restarts, key, key=lambda at: next(self._entries(data, at))[0])
            for other, ids in self._entries(data, restarts[max(first - 1, 0)]):
                if other > key:
                    return found
                if other == key:
                    found.append(ids)
        return found


def open_shard(path: str) -> Shard:
    where, name = fs.FileSystem.from_uri(path)
    return Shard(where.open_input_file(name))


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str) -> DataFrame:
    """Writes the shards; a row for each: ``path, first_id, last_id, first_hash, documents, tokens, start`` (tokens before it).

    The rows are the files' listing: as many as tasks that wrote one.
    """
    names = ["path", "first_id", "last_id", "first_hash", "documents", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, writer = word_bpe(tokenizer_path), None
        width, encode, doc_id = bpe.width, bpe.encoder(bpe.width).encode, None
        end = end_id.to_bytes(width, "little")
        for batch in released(batches):
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, text, order in zip(*(c.to_pylist() for c in part.columns)):
                    if writer is None:
                        where, top = fs.FileSystem.from_uri(folder)
                        where.create_dir(top)
                        name, first = f"{uuid.uuid4().hex}.ids", (doc_id, order)
                        writer = ShardWriter(where.open_output_stream(f"{top}/{name}"), width)
                    writer.add(key_of(doc_id), encode(text or "") + end)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), *[pa.array([v], pa.int64()) for v in (first[0], doc_id, first[1], len(writer.keys), writer.tokens)]], names=names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("order"))
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "order").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "order")
    shards = written(dealt.mapInArrow(run, "path string, first_id long, last_id long, first_hash long, documents long, tokens long"), "shards")
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "first_hash").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def lookup(shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, ids`` of every document whose id is in wanted (doc_id, not null); ids of no document give no row.

    The listing of the shards, about 100 bytes a file, goes to all tasks. Rows are gathered by shard, so that each shard's
    filter and index are read once.
    """
    spark = wanted.sparkSession
    listing = [tuple(r) for r in shards.filter("last_id is not null").select(F.coalesce("first_id", F.lit(-(1 << 63))), "last_id", "path").collect()]
    listing.sort()
    shared = spark.sparkContext.broadcast(listing)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = shared.value
        firsts, lasts = [f[0] for f in files], [f[1] for f in files]
        for batch in released(batches):
            found = []
            for doc_id in batch.column(0).to_pylist():
                n = bisect_left(lasts, doc_id)  # a repeated id can span shards
                while n < len(files) and firsts[n] <= doc_id:
                    found.append((files[n][2], doc_id))
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in ((0, pa.string()), (1, pa.int64()))], names=["path", "doc_id"])

    def read(group: pa.Table) -> pa.Table:
        shard, out = open_shard(group["path"][0].as_py()), []
        for doc_id in group["doc_id"].to_pylist():
            out += [(doc_id, ids.tolist()) for ids in shard.get(doc_id)]
        return pa.table([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    ids = wanted.select(F.col("doc_id").cast("long")).dropna().distinct()
    return ids.mapInArrow(places, "path string, doc_id long").groupBy("path").applyInArrow(read, "doc_id long, ids array<long>")


def read_shards(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the shards, one task a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for doc_id, ids in open_shard(path):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = max(shards.count(), 1)
    return shards.select("path", "start").coalesce(1).repartition(tasks).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids with an end id each, written as shards and read back."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return read_shards(write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), 2, new_path(spark, "sstable")))
