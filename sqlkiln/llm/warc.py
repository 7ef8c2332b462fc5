"""WARC archives of pages as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a skippable frame at the
end of each bundle is the seek table (the public seekable format: compressed and
plain size per frame, then frame count, descriptor and magic). A second
skippable frame before it maps every record id to its frame and its offset in
the plain frame, so one record costs one seek and one frame.

Payloads of at least ``MIN_REVISIT`` bytes that occur more than once are stored
once, with the smallest page_id; the other pages become revisit records that
name that record and the payload's digest and size.
"""

from __future__ import annotations

import struct
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sqlkiln.session import ensure_checkpoint_dir

from .common import shuffle_partitions, stored
from .tokenfile import NO_ID, open_shared

MIN_REVISIT = 100
FRAME_BYTES = 1 << 20          # plain bytes after which a frame is closed
# Fixed values of the Zstandard seekable format.
SKIPPABLE = 0x184D2A50
SEEK_MAGIC = 0x8F92EAB1
SEEK_FRAME = 0x184D2A5E
NAMESPACE = uuid.UUID("6f7a3f0e-52c9-4a7e-9c63-0d1f4a0c8e11")


def record_id(page_id: int) -> str:
    """The record's URN, a function of the page alone (so retries write the same)."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, str(page_id))}>"


def _header_value(value) -> str:
    """One line without control characters, as a WARC header needs."""
    return " ".join(str(value).split())


def build_record(page_id, url, payload: bytes, payload_bytes: int, digest: str, refers_to) -> bytes:
    """A response record, or a revisit (no block) when ``refers_to`` is given."""
    revisit = refers_to is not None
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-ID: {page_id}",
        f"X-Payload-Length: {payload_bytes}",
    ]
    if url is not None and _header_value(url):
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    lines += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_records(plain: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """``(offset, headers, block)`` of every record in a plain frame."""
    at = 0
    while at < len(plain):
        head_end = plain.index(b"\r\n\r\n", at)
        lines = plain[at:head_end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at offset {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        body = head_end + 4
        end = body + int(headers["Content-Length"])
        yield at, headers, plain[body:end]
        at = end + 4


class BundleWriter:
    """Streams records into frames; holds one frame and the index."""

    def __init__(self, out, level: int = 3):
        import zstandard
        self.out, self.zstd = out, zstandard.ZstdCompressor(level=level)
        self.frame = bytearray()
        self.frames: list[tuple[int, int]] = []
        self.index: list[tuple[int, int, int]] = []

    def add(self, page_id: int, record: bytes) -> None:
        self.index.append((page_id, len(self.frames), len(self.frame)))
        self.frame += record
        if len(self.frame) >= FRAME_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.frame:
            raw = self.zstd.compress(bytes(self.frame))
            self.out.write(raw)
            self.frames.append((len(raw), len(self.frame)))
            self.frame = bytearray()

    def close(self) -> None:
        self._flush()
        entries = b"".join(struct.pack("<qII", *e) for e in self.index)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries)) + entries)
        self.frames.append((8 + len(entries), 0))       # the index frame holds no content
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        self.out.write(struct.pack("<II", SEEK_FRAME, len(table) + 9) + table
                       + struct.pack("<IBI", len(self.frames), 0, SEEK_MAGIC))


class BundleReader:
    """Frames and records of a bundle by seek table and index."""

    def __init__(self, file, size: int):
        import zstandard
        self.file, self.zstd = file, zstandard.ZstdDecompressor()
        file.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table")
        file.seek(size - 9 - 8 * n)
        pairs = list(struct.iter_unpack("<II", file.read(8 * n)))
        self.starts, at = [], 0
        for packed, _ in pairs:
            self.starts.append(at)
            at += packed
        self.frames = pairs[:-1]
        file.seek(self.starts[-1] + 8)
        self.index = sorted(struct.iter_unpack("<qII", file.read(pairs[-1][0] - 8)))

    def plain(self, k: int) -> bytes:
        packed, size = self.frames[k]
        self.file.seek(self.starts[k])
        return self.zstd.decompress(self.file.read(packed), max_output_size=size)

    def record(self, page_id: int) -> tuple[dict[str, str], bytes]:
        """One record by its page: a binary search, a seek and one frame."""
        at = bisect_left(self.index, (page_id,))
        if at == len(self.index) or self.index[at][0] != page_id:
            raise KeyError(page_id)
        _, frame, offset = self.index[at]
        _, headers, block = next(parse_records(self.plain(frame)[offset:]))
        return headers, block


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html) into bundles;
    returns the manifest ``(path, n_records)``.

    Null html is an empty payload. Every row is a record: rows of one page_id
    with the least id's payload are all responses, and a null page_id is a
    response that nothing refers to. A lost attempt leaves a bundle that no
    manifest names.
    """
    spark = pages.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/sqlkiln-{uuid.uuid4().hex}/warc"
    html = F.coalesce("html", F.lit("")).cast("binary")
    full = (pages.select("page_id", "url", html.alias("payload"))
            .withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256)))
    big = full.select("page_id", "payload_bytes", "digest").where(F.col("payload_bytes") >= MIN_REVISIT)
    # Copies: few digests, each with its least page. The copies themselves are
    # joined as (page, digest) pairs, which skew handling can split.
    firsts = (big.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    revisits = big.join(firsts, "digest").where("page_id <> first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    records = (full.join(revisits, ["page_id", "digest"], "left")
               .withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload"))))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        writer = out = None
        for pdf in batches:
            if writer is None and len(pdf):
                out = open_shared(path, "w")
                writer = BundleWriter(out)
            for page_id, url, payload, n, digest, ref in pdf[["page_id", "url", "payload", "payload_bytes", "digest", "refers_to"]].itertuples(index=False):
                ref = None if pd.isna(ref) else int(ref)
                page_id = None if pd.isna(page_id) else int(page_id)
                writer.add(NO_ID if page_id is None else page_id, build_record(page_id, url, payload or b"", n, digest, ref))
        if writer is not None:
            writer.close()
            out.close()
            yield pd.DataFrame({"path": [path], "n_records": [len(writer.index)]})

    return stored(records.mapInPandas(write, "path string, n_records long"), "manifest")


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to, path, frame,
    offset[, payload])`` of every record, from the bundles' own bytes.

    A response's size and digest are taken from its payload and compared with
    its headers; a mismatch is an error.
    """
    schema = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
              "path string, frame int, offset long" + (", payload binary" if with_payload else ""))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        for pdf in batches:
            for path in pdf["path"]:
                file, size = open_shared(path, "r")
                with file:
                    bundle = BundleReader(file, size)
                    for k in range(len(bundle.frames)):
                        rows = []
                        for offset, head, block in parse_records(bundle.plain(k)):
                            kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
                            n = int(head["X-Payload-Length"])
                            if kind == "response" and (hashlib.sha256(block).hexdigest() != digest or len(block) != n):
                                raise ValueError(f"damaged record {head['WARC-Record-ID']}")
                            ref = head.get("X-Refers-To-Page-ID")
                            page = None if head["X-Page-ID"] == "None" else int(head["X-Page-ID"])
                            row = (page, n, digest, kind, None if ref is None else int(ref), path, k, offset)
                            rows.append(row + (block,) if with_payload else row)
                        out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
                                                          "path", "frame", "offset"] + ["payload"] * with_payload)
                        yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    return manifest.select("path").repartition(shuffle_partitions(manifest.sparkSession)).mapInPandas(read, schema)
