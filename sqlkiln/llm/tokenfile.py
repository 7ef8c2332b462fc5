"""Token ids in bit-packed shard files with block offsets.

A shard is: header, blocks, index, trailer, all little-endian.

* header: ``b"SKBITS01"``
* block: ``BLOCK`` ids (the last one fewer), each in ``width`` bits, id ``i`` at
  bits ``i * width ..`` of a stream of 64-bit words, padded to whole words
* index: int64 doc_id per document, uint64 first id per document plus the
  total, uint64 file offset per block plus the end
* trailer (48 bytes): documents, blocks, ids, index offset as uint64, ids per
  block and width as uint32, ``b"SKBITS01"``

``width`` is the least number of bits that holds every id of the vocabulary, so
a document's block and bit are found by arithmetic: 64 ids always fill ``width``
words, and numpy unpacks a block with 64 shifts.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from sqlkiln.session import ensure_checkpoint_dir

from .common import shuffle_partitions, stored
from .tokens import END_ID, document_ids, encoder

MAGIC = b"SKBITS01"
BLOCK = 1 << 16
TRAILER = struct.Struct("<QQQQII8s")
NO_ID = -(1 << 63)          # stands for a null doc_id in a file


def bit_width(vocab_size: int) -> int:
    """Least bits that hold ids below ``vocab_size`` (the end id included)."""
    return max(1, int(max(vocab_size - 1, END_ID)).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Ids, ``width`` bits each, as whole little-endian 64-bit words."""
    n = len(ids)
    rows = -(-n // 64)
    lanes = np.zeros((rows, 64), np.uint64)
    lanes.reshape(-1)[:n] = ids
    lanes = np.ascontiguousarray(lanes.T)
    words = np.zeros((width, rows), np.uint64)
    for i in range(64):
        at, shift = divmod(i * width, 64)
        words[at] |= lanes[i] << np.uint64(shift)
        if shift + width > 64:
            words[at + 1] |= lanes[i] >> np.uint64(64 - shift)
    used = -(-n * width // 64)
    return np.ascontiguousarray(words.T).reshape(-1)[:used].astype("<u8").tobytes()


def unpack_bits(raw: bytes, n: int, width: int) -> np.ndarray:
    """The first ``n`` ids of a block."""
    rows = -(-n // 64)
    words = np.zeros(rows * width, np.uint64)
    have = np.frombuffer(raw, "<u8")
    words[:len(have)] = have
    words = np.ascontiguousarray(words.reshape(rows, width).T)
    lanes = np.empty((64, rows), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        at, shift = divmod(i * width, 64)
        v = words[at] >> np.uint64(shift)
        if shift + width > 64:
            v = v | (words[at + 1] << np.uint64(64 - shift))
        lanes[i] = v & mask
    return np.ascontiguousarray(lanes.T).reshape(-1)[:n]


class ShardWriter:
    """Streams documents into one shard; holds a block and the index."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.doc_ids: list[int] = []
        self.firsts: list[int] = []
        self.offsets: list[int] = []
        self.total = 0
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        self.at = out.write(MAGIC) and len(MAGIC)

    def _flush(self, last: bool) -> None:
        if self.n_waiting < BLOCK and not (last and self.n_waiting):
            return
        ids = np.concatenate(self.waiting)
        end = len(ids) if last else len(ids) - len(ids) % BLOCK
        for a in range(0, end, BLOCK):
            raw = pack_bits(ids[a:min(a + BLOCK, end)], self.width)
            self.offsets.append(self.at)
            self.out.write(raw)
            self.at += len(raw)
        self.waiting, self.n_waiting = [ids[end:]], len(ids) - end

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(NO_ID if doc_id is None else doc_id)
        self.firsts.append(self.total)
        self.total += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self._flush(last=False)

    def close(self) -> None:
        self._flush(last=True)
        index = self.at
        self.out.write(np.array(self.doc_ids, "<i8").tobytes())
        self.out.write(np.array([*self.firsts, self.total], "<u8").tobytes())
        self.out.write(np.array([*self.offsets, index], "<u8").tobytes())
        self.out.write(TRAILER.pack(len(self.doc_ids), len(self.offsets), self.total, index, BLOCK, self.width, MAGIC))


class ShardReader:
    """Random access to a shard in a seekable file."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - TRAILER.size)
        docs, blocks, self.total, index, self.block, self.width, magic = TRAILER.unpack(file.read(TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a bit-packed shard")
        file.seek(index)
        raw = file.read(size - TRAILER.size - index)
        self.doc_ids = np.frombuffer(raw, "<i8", docs)
        self.firsts = np.frombuffer(raw, "<u8", docs + 1, 8 * docs).astype(np.int64)
        self.offsets = np.frombuffer(raw, "<u8", blocks + 1, 8 * (2 * docs + 1)).astype(np.int64)
        self._held: tuple[int, np.ndarray] = (-1, np.empty(0, np.uint32))

    def _block(self, k: int) -> np.ndarray:
        if self._held[0] != k:
            self.file.seek(int(self.offsets[k]))
            raw = self.file.read(int(self.offsets[k + 1] - self.offsets[k]))
            n = min(self.block, self.total - k * self.block)
            self._held = (k, unpack_bits(raw, n, self.width))
        return self._held[1]

    def document(self, i: int) -> np.ndarray:
        """Ids of the shard's ``i``-th document; reads only the blocks it touches."""
        a, b = int(self.firsts[i]), int(self.firsts[i + 1])
        parts = []
        while a < b:
            k, at = divmod(a, self.block)
            part = self._block(k)[at:at + b - a]
            parts.append(part)
            a += len(part)
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def open_shared(uri: str, mode: str):
    """A file of any file system that pyarrow knows, and its size when reading."""
    from pyarrow import fs
    uri = uri.replace("file:///", "/", 1) if uri.startswith("file:///") else uri.replace("file:/", "/", 1)
    system, path = fs.FileSystem.from_uri(uri)
    if mode == "w":
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(path, compression=None)
    return system.open_input_file(path), system.get_file_info(path).size


def write_shards(docs: DataFrame, tokenizer: str, folder: str | None = None, shards: int | None = None) -> DataFrame:
    """Write ``docs`` in ascending doc_id order; returns the manifest
    ``(shard, path, n_docs, n_tokens, base)``, ``base`` = ids in earlier shards.

    Rows are dealt by ranges of doc_id (ties by text) and each task streams its
    range into a file of its own name, so an attempt that is lost leaves a file
    no manifest names. Null texts are empty; null doc_ids come first.
    """
    spark = docs.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/sqlkiln-{uuid.uuid4().hex}/tokens"
    shards = shards or shuffle_partitions(spark)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        path = f"{folder}/{uuid.uuid4().hex}.bits"
        writer = out = None
        for pdf in batches:
            for doc_id, ids in zip(pdf["doc_id"], document_ids(pdf["text"], tokenizer)):
                if writer is None:
                    out = open_shared(path, "w")
                    writer = ShardWriter(out, bit_width(encoder(tokenizer).vocab_size))
                writer.add(None if pd.isna(doc_id) else int(doc_id), np.frombuffer(ids, np.uint32))
        if writer is not None:
            writer.close()
            out.close()
            yield pd.DataFrame({"shard": [TaskContext.get().partitionId()], "path": [path],
                                "n_docs": [len(writer.doc_ids)], "n_tokens": [writer.total]})

    ordered = (docs.select("doc_id", "text").repartitionByRange(shards, "doc_id")
               .sortWithinPartitions("doc_id", "text"))
    manifest = stored(ordered.mapInPandas(write, "shard int, path string, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)     # one row per shard
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_shards(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` per document, from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, base in zip(pdf["path"], pdf["base"]):
                file, size = open_shared(path, "r")
                with file:
                    shard = ShardReader(file, size)
                    for a in range(0, len(shard.doc_ids), 1024):
                        rows = range(a, min(a + 1024, len(shard.doc_ids)))
                        ids = [shard.document(i).astype("<u4") for i in rows]
                        out = pd.DataFrame({
                            "doc_id": pd.array([None if shard.doc_ids[i] == NO_ID else int(shard.doc_ids[i]) for i in rows], "Int64"),
                            "start": [base + int(shard.firsts[i]) for i in rows],
                            "n_tokens": [len(x) for x in ids],
                            "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids]})
                        if with_ids:
                            out["ids"] = [x.astype(np.int32) for x in ids]
                        yield out

    return manifest.select("path", "base").repartition(shuffle_partitions(manifest.sparkSession)).mapInPandas(read, schema)
