"""Sorted-string-table shards of token ids.

A shard is one file of records, each followed by a newline byte:

    data blocks   entries: varint shared key bytes, varint further key bytes, varint number of ids, key bytes, ids
    index block   for each data block: varint key bytes, first key, varints offset, length, entries, ids
    Bloom block   varint number of hashes, then the bits
    footer        struct of offsets and lengths of index and Bloom block, documents, ids, bytes of an id, checksum, magic

Within a block keys are prefix-compressed; its first key is whole, so the sparse index allows a binary search. Keys sort
as bytes: integers as big-endian with the sign bit turned, null as the empty key. Files are written by Spark's text writer
(bytes as they are, its line end is the newline byte), so they go to any file system that Spark knows, are
committed by task and come out the same if an executor is lost; they are read by the binaryFile source.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlog.llm import common, tokens
from loomlog.plans import staging

END = 2
BLOCK_BYTES = 64 << 10
#: Bytes of text for which a shard is planned.
SHARD_TEXT = 64 << 20
#: Rows whose ids and sizes tell the driver where to cut: a thousandth of all, but no fewer and no more than these.
SAMPLE_ROWS = (20_000, 1_000_000)
BLOOM_BITS = 10
MAGIC = b"LOOMSST\x01"
_FOOTER = struct.Struct("<QQQQQQII8s")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = data[at]
        at += 1
        n |= (c & 127) << shift
        if c < 128:
            return n, at
        shift += 7


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _bits(key: bytes, hashes: int, size: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * b) % size for i in range(hashes)]


def narrow(ids: bytes, width: int) -> bytes:
    """Little-endian 32-bit numbers in ``width`` bytes each; raises if one does not fit."""
    if width == 4:
        return ids
    if width != 2:
        raise ValueError("an id has 2 or 4 bytes")
    numbers = np.frombuffer(ids, "<u4")
    if numbers.size and int(numbers.max()) >= 1 << 16:
        raise ValueError(f"id {int(numbers.max())} does not fit into 2 bytes")
    return numbers.astype("<u2").tobytes()


class ShardWriter:
    """Turns keys in rising order into the records of a shard; holds one block, the index and the keys' Bloom hashes."""

    def __init__(self, width: int, block_bytes: int = BLOCK_BYTES) -> None:
        self.width, self.block_bytes = width, block_bytes
        self.block, self.first, self.last = bytearray(), b"", None
        self.entries = self.block_ids = self.docs = self.ids = self.at = 0
        self.index, self.keys = bytearray(), []

    def add(self, key: bytes, ids: bytes) -> Iterator[bytes]:
        """ids: little-endian numbers of ``width`` bytes (see ``narrow``)."""
        if self.last is not None and key < self.last:
            raise ValueError("keys must not fall")
        if len(self.block) >= self.block_bytes:
            yield self._close()
        shared = 0
        if self.entries:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        n = len(ids) // self.width
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(n) + key[shared:] + ids
        if key != self.last:
            self.keys.append(key)
        self.last = key
        self.entries += 1
        self.block_ids += n

    def _close(self) -> bytes:
        block = bytes(self.block)
        self.index += _varint(len(self.first)) + self.first + b"".join(map(_varint, (self.at, len(block), self.entries, self.block_ids)))
        self.docs += self.entries
        self.ids += self.block_ids
        self.at += len(block) + 1
        self.block, self.entries, self.block_ids = bytearray(), 0, 0
        return block

    def finish(self) -> Iterator[bytes]:
        if self.entries:
            yield self._close()
        size = max(64, len(self.keys) * BLOOM_BITS + 7 & ~7)
        bits = bytearray(size // 8)
        for key in self.keys:
            for b in _bits(key, 7, size):
                bits[b >> 3] |= 1 << (b & 7)
        bloom = _varint(7) + bytes(bits)
        index = bytes(self.index)
        yield index
        yield bloom
        yield _FOOTER.pack(self.at, len(index), self.at + len(index) + 1, len(bloom), self.docs, self.ids, self.width, zlib.crc32(index), MAGIC)


class Shard:
    """Reads a shard held in memory."""

    def __init__(self, data) -> None:
        self.data = memoryview(data).cast("B")
        index, index_size, bloom, bloom_size, self.docs, self.ids, self.width, crc, magic = _FOOTER.unpack_from(self.data, len(self.data) - _FOOTER.size - 1)
        if magic != MAGIC:
            raise ValueError("not a shard")
        block = self.data[index : index + index_size]
        if zlib.crc32(block) != crc:
            raise ValueError("the index is damaged")
        self.blocks: list[tuple[bytes, int, int, int, int]] = []
        at = 0
        while at < index_size:
            n, at = _read_varint(block, at)
            key = bytes(block[at : at + n])
            at += n
            numbers = []
            for _ in range(4):
                x, at = _read_varint(block, at)
                numbers.append(x)
            self.blocks.append((key, *numbers))
        self.bloom = self.data[bloom : bloom + bloom_size]

    def entries(self, of: int | None = None) -> Iterator[tuple[bytes, bytes]]:
        """Keys and ids (as 32-bit numbers), of all blocks or of one."""
        for _, start, size, count, _ in self.blocks if of is None else [self.blocks[of]]:
            at, key = start, b""
            for _ in range(count):
                shared, at = _read_varint(self.data, at)
                more, at = _read_varint(self.data, at)
                n, at = _read_varint(self.data, at)
                key = key[:shared] + bytes(self.data[at : at + more])
                at += more
                ids = self.data[at : at + n * self.width]
                at += n * self.width
                yield key, bytes(ids) if self.width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
            if at != start + size:
                raise ValueError("a block is damaged")

    def may_hold(self, key: bytes) -> bool:
        hashes, at = _read_varint(self.bloom, 0)
        bits = self.bloom[at:]
        return all(bits[b >> 3] >> (b & 7) & 1 for b in _bits(key, hashes, len(bits) * 8))

    def lookup(self, key: bytes) -> list[bytes]:
        """The ids of every document with this key: Bloom filter, binary search in the index, then as few blocks as hold it."""
        if not self.blocks or not self.may_hold(key):
            return []
        low, high = 0, len(self.blocks)
        while low < high:  # the first block that begins at or after the key
            mid = (low + high) // 2
            if self.blocks[mid][0] < key:
                low = mid + 1
            else:
                high = mid
        found = []
        for i in range(max(0, low - 1), len(self.blocks)):
            if self.blocks[i][0] > key:
                break
            found += [ids for k, ids in self.entries(i) if k == key]
        return found


def _key(doc_id: int | None) -> int:
    """Ids in order, null first."""
    return -(1 << 63) - 1 if doc_id is None else doc_id


def cuts(rows: DataFrame, least: int, shard_text: int = SHARD_TEXT) -> list[int]:
    """Keys that cut ``rows(doc_id, text)`` into shards of about that many bytes of text, ``least`` of them at least; from a sample.

    A key that fills several shards comes several times.
    """
    n = rows.count()
    share = min(1.0, min(max(n / 1000, SAMPLE_ROWS[0]), SAMPLE_ROWS[1]) / max(1, n))
    found = rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")).sample(share, 5).toArrow()
    keys = sorted(map(_key, found.column("doc_id").to_pylist()))
    total = sum(found.column("size").to_pylist()) / share
    shards = max(least, int(-(-total // shard_text)))
    return [keys[len(keys) * i // shards] for i in range(1, shards)] if keys else []


def shard_of(cut: list[int], key: int, mixed: int) -> int:
    """The shard of a key: those up to the first cut go to shard 0. Where several cuts are equal, ``mixed`` (32 bits) spreads the rows."""
    low = bisect_left(cut, key)
    high = bisect_right(cut, key)
    return low if high - low < 2 else low + (mixed * (high - low + 1) >> 32)


def _encode(source, end: int, width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, cut = source.value
        encoder, last = tokens.WordEncoder.of(vocabulary), np.array([end], "<u4").tobytes()
        row = 0
        for batch in common.slices(batches, tokens.SLICE_BYTES):
            docs, parts, hashes, out = batch.column(0), [], [], []
            for doc, x in zip(docs.to_pylist(), encoder.encode(common.utf8(batch.column(1))), strict=True):
                ids = narrow(x + last, width)
                row += 1
                hashes.append(zlib.crc32(ids))
                parts.append(shard_of(cut, _key(doc), zlib.crc32(row.to_bytes(8, "little"), hashes[-1])))
                out.append(ids)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), docs, pa.array(hashes, pa.int64()), pa.array(out, pa.binary())], ["part", "doc_id", "h", "ids"])

    return run


def _write(width: int, block_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, any_rows = ShardWriter(width, block_bytes), False
        for batch in common.slices(batches):
            any_rows, out = True, []
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += writer.add(key_of(doc), ids)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(writer.finish()), pa.binary())], ["record"])

    return run


def write(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end: int = END, vocabulary: str | None = None, width: int | None = None, block_bytes: int = BLOCK_BYTES, shard_text: int = SHARD_TEXT) -> None:
    """Write shards in ascending order of ids; part numbers of the files follow the order of their keys.

    Texts are encoded where they are read; only ids are shuffled and sorted, ``width`` bytes each (2 or 4; by default 2 if that holds every
    id of the vocabulary). Null ids come first. Rows that share an id lie next to each other; a large number of them is split
    over shards, equal rows too, and goes by a hash of the text within a shard. A null or empty text has the end id
    alone; a text of any length is one entry. Other columns are not read. No documents give no files.
    """
    spark = docs.sparkSession
    common.ship(spark)
    vocabulary = vocabulary or tokens.vocabulary()
    if width is None:
        width = 2 if max(tokens.WordEncoder.of(vocabulary).size, end + 1) <= 1 << 16 else 4
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    cut = cuts(rows, common.ordered(spark), shard_text)
    source = spark.sparkContext.broadcast((vocabulary, cut))  # a vocabulary file: a few MB, fixed; a number for each shard
    ids = rows.mapInArrow(_encode(source, end, width), "part int, doc_id long, h long, ids binary")
    dealt = ids.repartitionById(len(cut) + 1, "part").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h").select("doc_id", "ids")
    records = dealt.mapInArrow(_write(width, block_bytes), "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if not content.as_buffer().size:
                continue
            rows, start = [], 0
            for i, (key, ids) in enumerate(Shard(content.as_buffer()).entries()):
                rows.append((part, i, id_of(key), start, len(ids) // 4, zlib.crc32(ids)))
                start += len(ids) // 4
            for i in range(0, len(rows), 10_000):
                columns = zip(*rows[i : i + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "pos", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """From the files: ``doc_id, start, n_tokens, ids_crc32`` of every document, repeated ids too. A task holds one shard; no files, no rows."""
    common.ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("part"), "content")
    rows = staging.stage(files.mapInArrow(_read, "part long, pos long, doc_id long, at long, n_tokens long, ids_crc32 long"), "sstable-rows")
    shards = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row for each file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(shards, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _lookup(keys: list[int | None]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                if content.as_buffer().size:
                    shard = Shard(content.as_buffer())
                    found = [(k, np.frombuffer(ids, "<u4").tolist()) for k in keys for ids in shard.lookup(key_of(k))]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return run


def lookup(spark: SparkSession, path: str, keys: list[int | None]) -> DataFrame:
    """The ids of the documents with the given ids (a few), shard by shard."""
    common.ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_lookup(list(keys)), "doc_id long, ids array<long>")


def op7_sstable(spark, sf_dir: str) -> DataFrame:
    """All documents written as shards and read back."""
    path = staging.new_path(spark, "sstable")
    write(common.table(spark, sf_dir, "documents"), path)
    return read_summary(spark, path)
