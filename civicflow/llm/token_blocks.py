"""Token-id files in patched frame-of-reference blocks.

The ids of all documents, in ascending ``doc_id`` order, are cut into blocks of
``BLOCK`` ids.  A block stores its minimum, the differences to it packed at the
width that holds a given share of them, and a list of exceptions (position,
difference) for the others.  A segment file is

    magic | block, block, ... | block starts u64 | doc ids i64 | null marks u8
    | token counts u64 | footer (docs, blocks, ids, block size) | magic

where a block is: minimum u32, count u16, exceptions u16, width u8, packed
bits, exception positions u16, exception differences u32.  Segments are written
by the tasks of a range partitioning through ``pyarrow.fs``, under a name of
the attempt's own, so that a repeated task never touches another's file; only
segments of the written manifest count.  The block starts allow reading any
range of ids.

Defined cases: a null or empty text is the end id alone; null ``doc_id`` comes
first; repeated rows and equal ids are each written, ordered by a hash of the
text; an empty table writes no segment and gives an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicflow.llm import tokens
from civicflow.llm.common import materialise, scratch_path, slices

END_ID = 2
BLOCK = 512
#: Share of a block's differences that fit the packed width.
SHARE = 0.95
MAGIC = b"PFR1"
_HEAD = struct.Struct("<IHHB")
_FOOT = struct.Struct("<QQQI4s")
#: Blocks that are packed or unpacked at a time.
CHUNK = 1024


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values below 2**width as rows of bytes, most significant bit first."""
    if not width:
        return np.zeros((len(values), 0), np.uint8)
    size = 2 if width <= 16 else 4
    bits = np.unpackbits(values.astype(f">u{size}").view(np.uint8).reshape(len(values), -1, size), axis=2)
    return np.packbits(bits[:, :, 8 * size - width:].reshape(len(values), -1), axis=1)


def _unpack_bits(packed: np.ndarray, width: int, count: int) -> np.ndarray:
    if not width:
        return np.zeros((len(packed), count), np.uint32)
    first = np.arange(count) * width
    size = (width + 14) // 8  # bytes that a value touches at most
    padded = np.pad(packed, ((0, 0), (0, size)))
    kind = np.uint32 if size <= 4 else np.uint64
    out = np.zeros((len(packed), count), kind)
    for k in range(size):
        out <<= kind(8)
        out |= padded.take(first // 8 + k, axis=1)
    out >>= (8 * size - width - first % 8).astype(kind)
    out &= kind((1 << width) - 1)
    return out.astype(np.uint32)


def encode_blocks(ids: np.ndarray, block: int = BLOCK, share: float = SHARE) -> list[bytes]:
    """The blocks of an array of ids; the last one may be shorter."""
    if len(ids) % block:
        whole = len(ids) - len(ids) % block
        return encode_blocks(ids[:whole], block, share) * bool(whole) + encode_blocks(ids[whole:], len(ids) - whole, share)
    x = ids.astype(np.uint32).reshape(-1, block)
    low = x.min(axis=1)
    rest = x - low[:, None]
    at = min(block - 1, int(share * block))
    typical = np.partition(rest, at, axis=1)[:, at]
    widths = np.where(typical, np.floor(np.log2(np.maximum(typical, 1))).astype(int) + 1, 0)
    out: list[bytes] = [b""] * len(x)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        over = rest[rows] >> np.uint32(width) if width < 32 else np.zeros_like(rest[rows])
        packed = _pack_bits(rest[rows] & np.uint32((1 << int(width)) - 1), int(width))
        for i, row in enumerate(rows):
            odd = np.flatnonzero(over[i])
            out[row] = (_HEAD.pack(int(low[row]), block, len(odd), int(width)) + packed[i].tobytes()
                        + odd.astype("<u2").tobytes() + rest[row][odd].astype("<u4").tobytes())
    return out


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at ``starts`` in ``data``, in order."""
    heads = [_HEAD.unpack_from(data, s) for s in starts]
    raw = np.frombuffer(data, np.uint8)
    counts = np.array([h[1] for h in heads], np.int64)
    out = np.empty(int(counts.sum()), np.uint32)
    at = np.cumsum(counts) - counts
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, (_, count, _, width) in enumerate(heads):
        kinds.setdefault((count, width), []).append(i)
    for (count, width), rows in kinds.items():
        size = (count * width + 7) // 8
        packed = np.stack([raw[starts[i] + _HEAD.size:starts[i] + _HEAD.size + size] for i in rows])
        values = _unpack_bits(packed, width, count)
        for j, i in enumerate(rows):
            low, _, odd, _ = heads[i]
            if odd:
                p = int(starts[i]) + _HEAD.size + size
                values[j, np.frombuffer(data, "<u2", odd, p)] = np.frombuffer(data, "<u4", odd, p + 2 * odd)
            out[at[i]:at[i] + count] = values[j] + np.uint32(low)
    return out


class SegmentWriter:
    """Appends ids to one segment file; holds at most ``CHUNK`` blocks of ids."""

    def __init__(self, sink, block: int = BLOCK, share: float = SHARE):
        self.sink, self.block, self.share = sink, block, share
        self.pending: list[bytes] = []
        self.bytes = self.ids = 0
        self.starts: list[int] = []
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []
        self.end = sink.write(MAGIC) or len(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.pending.append(ids)
        self.bytes += len(ids)
        if self.bytes >= 4 * self.block * CHUNK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        held = np.frombuffer(b"".join(self.pending), "<u4")
        n = len(held) if last else len(held) - len(held) % self.block
        for i in range(0, n, self.block * CHUNK):
            blocks = encode_blocks(held[i:min(n, i + self.block * CHUNK)], self.block, self.share)
            for b in blocks:
                self.starts.append(self.end)
                self.end += len(b)
            self.sink.write(b"".join(blocks))
        self.ids += n
        self.pending = [held[n:].tobytes()]
        self.bytes = len(self.pending[0])

    def close(self) -> None:
        self._flush(True)
        known = [0 if d is None else d for d in self.doc_ids]
        self.sink.write(np.array(self.starts, "<u8").tobytes() + np.array(known, "<i8").tobytes()
                        + np.array([d is None for d in self.doc_ids], "u1").tobytes()
                        + np.array(self.counts, "<u8").tobytes()
                        + _FOOT.pack(len(self.doc_ids), len(self.starts), self.ids, self.block, MAGIC))


class SegmentReader:
    """Reads one segment by its block index."""

    def __init__(self, source):
        self.source = source
        source.seek(source.size() - _FOOT.size)
        docs, blocks, self.ids, self.block, magic = _FOOT.unpack(source.read(_FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a token segment")
        self.index = source.size() - _FOOT.size - 8 * blocks - 17 * docs
        source.seek(self.index)
        tail = source.read(8 * blocks + 17 * docs)
        self.starts = np.frombuffer(tail, "<u8", blocks).astype(np.int64)
        known = np.frombuffer(tail, "<i8", docs, 8 * blocks)
        missing = np.frombuffer(tail, "u1", docs, 8 * blocks + 8 * docs)
        self.doc_ids = [None if m else int(d) for d, m in zip(known, missing, strict=True)]
        self.counts = np.frombuffer(tail, "<u8", docs, 8 * blocks + 9 * docs).astype(np.int64)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks first to last - 1."""
        begin = int(self.starts[first])
        end = int(self.starts[last]) if last < len(self.starts) else self.index
        self.source.seek(begin)
        return decode_blocks(self.source.read(end - begin), self.starts[first:last] - begin)

    def range(self, start: int, n: int) -> np.ndarray:
        """n ids from position ``start`` of the segment."""
        if not n:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (start + n - 1) // self.block + 1
        return self.blocks(first, last)[start - first * self.block:start - first * self.block + n]

    def documents(self) -> Iterator[tuple[int | None, Iterator[np.ndarray]]]:
        """Each document's id with its ids in pieces; take the pieces before the next document."""
        held, at = np.zeros(0, np.uint32), 0

        def pieces(n: int) -> Iterator[np.ndarray]:
            nonlocal held, at
            while n:
                if not len(held):
                    held = self.blocks(at, min(len(self.starts), at + CHUNK))
                    at += CHUNK
                part, held = held[:n], held[n:]
                n -= len(part)
                yield part

        for doc_id, n in zip(self.doc_ids, self.counts, strict=True):
            yield doc_id, pieces(int(n))


#: Names under which Hadoop knows the stores that ``pyarrow.fs`` has (hdfs and viewfs need libhdfs on the executors).
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "file": "file"}


def _store_uri(uri: str) -> str:
    """The folder's address for ``pyarrow.fs``; a scheme that it lacks is refused before anything is written."""
    if "://" not in uri and not uri.startswith("file:"):
        return f"file://{uri}"
    scheme, rest = uri.split(":", 1)
    if scheme not in SCHEMES:
        raise ValueError(f"token files can't be written to {scheme}: (known: {', '.join(sorted(SCHEMES))})")
    return f"{SCHEMES[scheme]}:{rest}"


def _file_system(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(_store_uri(uri))


def _write(folder: str, vocabulary: str, end_id: int, block: int, share: float):
    end = end_id.to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        task, writer, sink = TaskContext.get().partitionId(), None, None
        name = f"segment-{task:06d}-{uuid.uuid4().hex}.pfr"
        encoder = tokens.encoder(vocabulary)
        for batch in slices(batches):
            ids = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            for doc_id, own in zip(batch.column(0).to_pylist(), ids, strict=True):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    sink = fs.open_output_stream(f"{root}/{name}")
                    writer = SegmentWriter(sink, block, share)
                writer.add(doc_id, own + end)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int32()), "segment": [name],
                                              "n_docs": pa.array([len(writer.counts)], pa.int64()),
                                              "n_ids": pa.array([writer.ids], pa.int64()),
                                              "n_bytes": pa.array([writer.end], pa.int64())})

    return write


def write_token_files(docs: DataFrame, folder: str | None = None, vocabulary: str | None = None,
                      end_id: int = END_ID, block: int = BLOCK, share: float = SHARE) -> DataFrame:
    """Write the segments; the manifest (one row per segment, with the ids before it) is the result."""
    folder = folder or scratch_path(docs.sparkSession, "token-files")
    _store_uri(folder)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.xxhash64("text").alias("_key"), F.monotonically_increasing_id().alias("_row"))
    # rows of one id, or of one text, in very many places of the table are split, too
    order = [F.asc_nulls_first("doc_id"), F.asc("_key"), F.asc("_row")]
    manifest = materialise(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
            .mapInArrow(_write(folder, vocabulary or tokens.vocabulary(), end_id, block, share),
                        "task int, segment string, n_docs long, n_ids long, n_bytes long"), "manifest")
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # one row per segment
    return manifest.select(F.lit(folder).alias("folder"), "*", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("ids_before"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            fs, root = _file_system(row["folder"])
            with fs.open_input_file(f"{root}/{row['segment']}") as source:
                reader, start, out = SegmentReader(source), row["ids_before"], []
                for i, (doc_id, pieces) in enumerate(reader.documents()):
                    n, crc = int(reader.counts[i]), 0
                    for part in pieces:
                        crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                    out.append((doc_id, start, n, crc))
                    start += n
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)],
                                                 names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Decode every segment again: one row per document."""
    parts = max(1, manifest.count())
    return manifest.repartition(parts).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
