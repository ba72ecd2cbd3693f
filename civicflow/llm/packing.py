"""Sequence packing by power-of-two decomposition.

A document of n token ids is cut into full sequences of ``max_length`` ids and
the binary digits of the rest, longest first.  Every piece is a sequence of its
own whose length is a power of two, so that sequences need no padding and never
cross documents; sequences of equal length get consecutive numbers (one bucket
per length).

Defined cases: a null or empty text is the end id alone (one piece of length
1); a null ``doc_id`` is kept as it is; repeated rows are packed once each;
other columns of the input are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicflow.llm import tokens
from civicflow.llm.common import materialise, slices

END_ID = 1
MAX_LENGTH = 2048
#: Rows (one per task and length, of 20 bytes) up to which they are broadcast.
BROADCAST_ROWS = 1_000_000


def binary_pieces(n: int, max_length: int = MAX_LENGTH) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of n ids: whole sequences, then the rest's powers of two."""
    full, rest = divmod(n, max_length)
    pieces = [(i * max_length, max_length) for i in range(full)]
    start = full * max_length
    while rest:
        length = 1 << (rest.bit_length() - 1)
        pieces.append((start, length))
        start += length
        rest -= length
    return pieces


def _cut(vocabulary: str, max_length: int, end_id: int, with_ids: bool):
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = tokens.encoder(vocabulary), TaskContext.get().partitionId(), Counter()
        for batch in slices(batches):
            out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "local", "ids")}
            ids = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            for doc_id, own in zip(batch.column(0).to_pylist(), ids, strict=True):
                own = memoryview(own + end)
                n = len(own) // 4
                for start, length in binary_pieces(n, max_length):
                    piece = own[4 * start:4 * (start + length)]
                    for k, v in (("doc_id", doc_id), ("start", start), ("length", length),
                                 ("ids_crc32", zlib.crc32(piece)), ("doc_tokens", n), ("local", seen[length])):
                        out[k].append(v)
                    if with_ids:
                        out["ids"].append(bytes(piece))
                    seen[length] += 1
            rows = {k: pa.array(v, pa.int64()) for k, v in out.items() if k != "ids"}
            rows["task"] = pa.array([task] * len(out["start"]), pa.int32())
            if with_ids:
                rows["ids"] = pa.array(out["ids"], pa.binary())
            yield pa.RecordBatch.from_pydict(rows)

    return cut


def pack_documents(docs: DataFrame, vocabulary: str | None = None, max_length: int = MAX_LENGTH,
                   end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece, with its sequence and, if asked for, its ids (little-endian unsigned 32-bit).

    ``max_length`` must be a power of two.  The pieces are written once to the
    shared folder with their number inside (task, length); the numbers of
    whole buckets follow from the counts per (task, length).
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, local long, task int"
    pieces = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                  .mapInArrow(_cut(vocabulary or tokens.vocabulary(), max_length, end_id, with_ids),
                              schema + ", ids binary" * with_ids))
    pieces = materialise(pieces, "pieces")
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("tasks_before"))
    # one row per power of two
    longer = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    by_length = (counts.groupBy("length").agg(F.sum("n").alias("n"))
                       .select("length", F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("first")))
    firsts = materialise(by_task.join(F.broadcast(by_length), "length").select(
        "length", "task", (F.col("tasks_before") + F.col("first")).alias("first")), "firsts")
    if firsts.count() <= BROADCAST_ROWS:  # else the pieces are shuffled
        firsts = F.broadcast(firsts)
    return pieces.join(firsts, ["length", "task"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first") + F.col("local")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        *["ids"] * with_ids)
